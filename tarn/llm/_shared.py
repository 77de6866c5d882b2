"""Helpers shared by the operators: durable intermediate tables, global prefix sums and graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The session setting by which Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates: ``spark.checkpoint.dir`` of the session.

    A temporary folder is set only where that is unset in local mode, as in tests; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage without keeping anything on one executor, fixes every value that depends on task layout, and
    gives the planner the true size of what follows, so that it broadcasts only what is small.  The shuffle files of the
    step are deleted when it ends: they wouldn't be read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``durable`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("tarn-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, order: Sequence[Column], values: Sequence[str], name: str = "prefix") -> DataFrame:
    """Exclusive prefix sums of the long columns ``values`` over all rows in ``order``, without one global task.

    Rows are range-partitioned by ``order``; each partition's totals are summed in turn (a table with one row for each
    partition, so its broadcast is bounded by the partition count), and a window inside each partition adds the rest.
    Adds ``<value>_before`` (sum of the earlier rows) and ``<value>_total`` (of all rows), ``row_before`` and ``n_rows``.
    Rows equal in every ``order`` column are taken in any order, so give enough columns to make ties identical.
    NULL values count as 0.  An empty table gives an empty table.
    """
    rows = durable(df, name)  # dealing rows into ranges reads them twice, and what they are computed from only once this way
    ranged = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    forget(rows)
    amount = {v: F.coalesce(F.col(v).cast("long"), F.lit(0).cast("long")) for v in values}
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(x).alias(f"_sum_{v}") for v, x in amount.items()])
    every = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.sum("_rows").over(every).alias("n_rows"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_sum0_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(every).alias(f"{v}_total") for v in values],
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = ranged.withColumns({"_nth": F.row_number().over(inside)} | {f"_run_{v}": F.sum(x).over(inside) for v, x in amount.items()})
    return (
        run.join(F.broadcast(parts), "_part")
        .withColumns({"row_before": F.col("_rows0") + F.col("_nth") - 1} | {f"{v}_before": F.col(f"_sum0_{v}") + F.col(f"_run_{v}") - x for v, x in amount.items()})
        .drop("_part", "_nth", "_rows0", *[f"{p}_{v}" for v in values for p in ("_run", "_sum0")])
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: ``edges`` (a, b) to (node, root), root the least node reachable.

    Alternates large-star and small-star steps, each a grouped aggregation with a join, until the set of edges stays
    the same; only a count and a checksum reach the driver.  Every step is written to the shared folder.  Nodes without
    an edge do not appear.  Loops, repeated and reversed edges are allowed; edges with a NULL end are ignored.
    """
    now = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    was, is_now = None, state(now)
    while was != is_now and is_now[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = durable(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), name)
        was, is_now = is_now, state(after)
        forget(now)
        now = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
