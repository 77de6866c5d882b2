"""Run the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables and BENCH_CPUS the number of cores.
"""

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn import queries as core
from tarn.functions.expressions import col
from tarn.operators.maintenance import write_checkpoint
from tarn.operators.transaction import Transaction, create_table


def synthetic_log(spark, root, adds):
    """A table whose log alone exists: so many adds in one commit."""
    from pyspark.sql import types as T

    t = create_table(spark, root, T.StructType.fromDDL("id bigint, v string"))
    tx = Transaction(t.snapshot())
    tx.add_files([{"path": f"part-{i:08d}.parquet", "partitionValues": {}, "size": 1000 + i, "modificationTime": 1, "stats": json.dumps({"numRecords": 10, "nullCount": {"id": 0, "v": 0}, "minValues": {"id": i * 10}, "maxValues": {"id": i * 10 + 9}})} for i in range(adds)])
    tx.commit()
    return t


def many_commits(spark, root, commits, adds):
    """A table whose log has so many commits of so many adds each, written as they would be."""
    from pyspark.sql import types as T

    from tarn import fixed
    from tarn.sources import actions

    t = create_table(spark, root, T.StructType.fromDDL("id bigint, v string"))
    for c in range(commits):
        lines = [actions.line("commitInfo", timestamp=c, operation="WRITE")]
        for i in range(c * adds, (c + 1) * adds):
            stats = json.dumps({"numRecords": 10, "nullCount": {"id": 0, "v": 0}, "minValues": {"id": i * 10}, "maxValues": {"id": i * 10 + 9}})
            lines.append(actions.line("add", path=f"part-{i:08d}.parquet", partitionValues={}, size=1000 + i, modificationTime=1, dataChange=True, stats=stats))
        t.files.write(f"{fixed.LOG_DIR}/{c + 1:020d}.json", ("\n".join(lines) + "\n").encode())
    return t


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="tarn-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tarn-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{work}/shared").config("spark.sql.warehouse.dir", f"{work}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, f):
        f()  # the first run compiles code and warms the file cache
        began = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - began, 4)

    def drained(df):
        df.write.format("noop").mode("overwrite").save()

    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    t = core.new_table(spark, rows, files=16, by="l_orderkey")
    top = rows.agg(F.max("l_orderkey")).first()[0]
    timed("plain_parquet", lambda: drained(spark.read.parquet(f"{t.root}/data-*")))
    timed("table_scan", lambda: drained(t.snapshot().scan()))
    timed("table_scan_pruned", lambda: drained(t.snapshot().scan(["l_orderkey", "l_quantity"], col("l_orderkey") < top // 16)))
    timed("plain_filtered", lambda: drained(spark.read.parquet(f"{t.root}/data-*").where(F.col("l_orderkey") < top // 16).select("l_orderkey", "l_quantity")))
    timed("aggregates", lambda: drained(core.agg_min_max_sum_count(spark, d)))
    timed("dv_delete_and_scan", lambda: drained(core.after_dv_delete(spark, d)))
    for n in (100, 1_000, 10_000):
        log = synthetic_log(spark, f"{work}/log{n}", n)
        timed(f"snapshot_{n}_adds", lambda log=log: log.snapshot().protocol)
        timed(f"file_list_{n}_adds", lambda log=log: drained(log.snapshot().list_files(col("id") < 500)))
    write_checkpoint(log.snapshot())
    timed("file_list_10000_adds_checkpoint", lambda: drained(log.snapshot().list_files(col("id") < 500)))
    log = many_commits(spark, f"{work}/log1k", 1_000, 101)
    timed("snapshot_1000_commits", lambda: log.snapshot().protocol)
    timed("file_list_1000_commits_101000_adds", lambda: drained(log.snapshot().list_files(col("id") < 500)))
    write_checkpoint(log.snapshot())
    timed("file_list_101000_adds_checkpoint", lambda: drained(log.snapshot().list_files(col("id") < 500)))
    try:
        from tarn.llm import queries as llm
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("tarn.llm"):
            raise
    else:
        for name, f in llm.queries().items():
            began = time.perf_counter()
            drained(f(spark, d))
            times[name] = round(time.perf_counter() - began, 4)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
