"""Queries over the standard tables that exercise every operator, with the same results in SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import fixed
from tarn.functions.expressions import (
    And, Array, Cast, Coalesce, Compare, Divide, In, IntDivide, IsNull, Literal, MapToStruct, Not, Opaque, OpaquePredicate, Or, ParseJson, Struct, ToJson, UnknownPredicate, col, lit,
)
from tarn.operators.changes import ChangeFeed, commit_range, file_keys, incremental_scan, tracked_changes
from tarn.operators.maintenance import HISTOGRAM, advance_checksum, checkpoint_shape, histogram, measured, write_checkpoint, write_checksum
from tarn.operators.transaction import StagingCommitter, Transaction, create_table, publish
from tarn.plans import relational as R
from tarn.sources import actions
from tarn.sources.log import parse
from tarn.streaming.change_stream import stream_changes
from tarn.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tarn-")
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def new_table(spark: SparkSession, df: DataFrame, files: int = 3, by: str | None = None, **options) -> Table:
    """A table with the rows of ``df``, range-split into files by a column."""
    t = create_table(spark, scratch(spark), T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]), **options)
    Transaction(t.snapshot()).append(df.repartitionByRange(files, by) if by else df).commit()
    return t


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(*ORDERS.split(", "))


# Relational operators


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_parquet(spark, d):
    schema = read(spark, d, "nation").schema
    return R.scan_parquet(spark, [f"{d}/nation.parquet"], schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(spark, d):
    nation, path = read(spark, d, "nation"), scratch(spark)
    nation.write.json(path)
    return R.scan_json(spark, [path], nation.schema)


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, NULL), (NULL, 'c')) t(id, name)")
def values_inline(spark, d):
    return R.values(spark, T.StructType.fromDDL("id bigint, name string"), [(1, "a"), (2, None), (None, "c")])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS c FROM orders")
def project_struct(spark, d):
    made = Struct((("c", col("o_custkey")),), keep=col("o_orderstatus").eq("F"))
    out = R.project(orders(spark, d), [col("o_orderkey"), made], T.StructType.fromDDL("k bigint, s struct<c:bigint>"))
    return out.select("k", F.col("s.c").alias("c"))


@query("SELECT 1 AS first, o_orderkey + 1 AS o_orderkey, o_orderkey * 2 AS doubled, o_orderstatus, 'x' AS last FROM orders")
def project_patch(spark, d):
    patch = R.Patch().drop("o_custkey").drop("o_orderpriority").drop("not_there", if_exists=True).prepend("first", lit(1)).replace("o_orderkey", col("o_orderkey") + 1)
    return R.project_patch(orders(spark, d), patch.insert_after("o_orderkey", "doubled", col("o_orderkey") * 2).append("last", lit("x")))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, NULLIF(o_custkey % 5, 0) AS m, NULLIF(o_orderkey % 3, 0) AS n FROM orders) WHERE (m < 3 AND NOT (n = 1)) OR m IS NULL AND n = 2")
def filter_null_semantics(spark, d):
    rows = orders(spark, d).selectExpr("o_orderkey", "nullif(o_custkey % 5, 0) m", "nullif(o_orderkey % 3, 0) n")
    rule = ((col("m") < 3) & ~col("n").eq(1)) | (IsNull(col("m")) & col("n").eq(2))
    return R.filter_rows(rows, rule).select("o_orderkey")


@query("SELECT n_nationkey, n_name, 'kept' AS tag FROM nation")
def dynamic_scan(spark, d):
    schema = read(spark, d, "nation").select("n_nationkey", "n_name").schema
    named = spark.createDataFrame([("nation.parquet", "kept")], "path string, tag string")
    return R.dynamic_scan(spark, named, "path", d, schema, ["tag"])


@query("SELECT l_suppkey, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi, SUM(l_orderkey)::BIGINT AS total, COUNT(l_partkey) AS n, COUNT(*) AS n_all FROM lineitem GROUP BY l_suppkey")
def agg_min_max_sum_count(spark, d):
    rows = read(spark, d, "lineitem")
    return R.aggregate(rows, ["l_suppkey"], R.agg_min("l_orderkey").alias("lo"), R.agg_max("l_orderkey").alias("hi"), R.agg_sum("l_orderkey").alias("total"), R.agg_count("l_partkey").alias("n"), R.agg_count_star().alias("n_all"))


@query("SELECT k, COUNT(*) AS n FROM (SELECT NULLIF(o_orderkey % 4, 0) AS k FROM orders) GROUP BY k")
def agg_null_keys(spark, d):
    return R.aggregate(orders(spark, d).selectExpr("nullif(o_orderkey % 4, 0) k"), ["k"], R.agg_count_star().alias("n"))


@query("SELECT MIN(o_orderkey) AS lo, SUM(o_orderkey)::BIGINT AS total, COUNT(o_orderkey) AS n, COUNT(*) AS n_all FROM orders WHERE false")
def agg_ungrouped_empty(spark, d):
    return R.aggregate(orders(spark, d).where("false"), [], R.agg_min("o_orderkey").alias("lo"), R.agg_sum("o_orderkey").alias("total"), R.agg_count("o_orderkey").alias("n"), R.agg_count_star().alias("n_all"))


_NULLED = "(SELECT o_custkey % 7 AS g, NULLIF(o_orderstatus, 'O') AS v, NULLIF(o_orderkey % 3, 0) AS s, o_orderkey AS k FROM orders)"


@query(f"SELECT g, (SELECT x.v FROM {_NULLED} x WHERE x.k = m) AS v FROM (SELECT g, MAX(k) FILTER (s IS NOT NULL) AS m FROM {_NULLED} GROUP BY g)")
def agg_max_non_null_by(spark, d):
    rows = orders(spark, d).selectExpr("o_custkey % 7 g", "nullif(o_orderstatus, 'O') v", "nullif(o_orderkey % 3, 0) s", "o_orderkey k")
    return R.aggregate(rows, ["g"], R.max_non_null_by("v", "s", "k").alias("v"))


@query(f"SELECT g, (SELECT x.v FROM {_NULLED} x WHERE x.k = m) AS v FROM (SELECT g, MIN(k) FILTER (s IS NOT NULL) AS m FROM {_NULLED} GROUP BY g)")
def agg_min_non_null_by(spark, d):
    rows = orders(spark, d).selectExpr("o_custkey % 7 g", "nullif(o_orderstatus, 'O') v", "nullif(o_orderkey % 3, 0) s", "o_orderkey k")
    return R.aggregate(rows, ["g"], R.min_non_null_by("v", "s", "k").alias("v"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, d):
    return R.semi_join(read(spark, d, "customer").select("c_custkey", "c_name"), orders(spark, d), [("c_custkey", "o_custkey")])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return R.anti_join(read(spark, d, "customer").select("c_custkey", "c_name"), orders(spark, d), [("c_custkey", "o_custkey")])


@query("WITH p AS (SELECT o_orderkey, NULLIF(o_custkey % 10, 0) AS k FROM orders), b AS (SELECT NULLIF(n_nationkey % 5, 0) AS k FROM nation) SELECT o_orderkey FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM p.k)")
def anti_join_null_keys(spark, d):
    p, b = orders(spark, d).selectExpr("o_orderkey", "nullif(o_custkey % 10, 0) k"), read(spark, d, "nation").selectExpr("cast(nullif(n_nationkey % 5, 0) as bigint) k")
    return R.anti_join(p, b, ["k"]).select("o_orderkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(spark, d):
    region = read(spark, d, "region").selectExpr("r_name name")
    return R.union_all(read(spark, d, "nation").selectExpr("n_name name"), region, region)


# Expressions


@query("SELECT o_orderkey, (o_orderkey - 7000) // 7 AS q FROM orders WHERE (o_orderkey - 7000) % 7 = 0 OR o_orderkey >= 7000")
def int_divide(spark, d):
    rows = orders(spark, d).where("(o_orderkey - 7000) % 7 = 0 or o_orderkey >= 7000")
    return rows.select("o_orderkey", IntDivide(col("o_orderkey") - 7000, lit(7)).to_column().alias("q"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE '1.5' END AS q FROM orders")
def float_divide_ieee(spark, d):
    rows = orders(spark, d).selectExpr("o_orderkey", "double(case o_orderkey % 4 when 0 then 0 when 1 then 2 when 2 then -2 else 3 end) a", "double(case when o_orderkey % 4 < 3 then 0 else 2 end) b")
    return rows.select("o_orderkey", Divide(col("a"), col("b")).to_column().cast("string").alias("q"))


@query("SELECT o_orderkey, COALESCE(NULLIF(o_custkey % 3, 0), NULLIF(o_orderkey % 2, 0), -1) AS c, [o_orderkey, o_custkey][2] AS second FROM orders")
def coalesce_and_array(spark, d):
    rows = orders(spark, d).selectExpr("*", "nullif(o_custkey % 3, 0) a", "nullif(o_orderkey % 2, 0) b")
    second = Array((col("o_orderkey"), col("o_custkey"))).to_column()[1]
    return rows.select("o_orderkey", Coalesce((col("a"), col("b"), lit(-1, "bigint"))).to_column().alias("c"), second.alias("second"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS INTEGER) AS n FROM part")
def cast_try(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", "case when p_size % 2 = 0 then p_name else string(p_size) end t")
    return rows.select("p_partkey", Cast(col("t"), "int").to_column().alias("n"))


@query("SELECT o_orderkey, COALESCE(m IN (1, 2), false) AS x, m IS NOT NULL AND m NOT IN (1, 2) OR m IS NULL AS y, m IS DISTINCT FROM 1 AS z FROM (SELECT o_orderkey, NULLIF(o_custkey % 4, 0) AS m FROM orders)")
def in_and_distinct(spark, d):
    rows = orders(spark, d).selectExpr("o_orderkey", "nullif(o_custkey % 4, 0) m")
    member = In(col("m"), (1, 2, None))
    return rows.select("o_orderkey", member.to_column().alias("x"), Not(member).to_column().alias("y"), col("m").distinct_from(1).to_column().alias("z"))


@query("SELECT o_orderkey, true AS a, false AS o FROM orders")
def empty_junctions(spark, d):
    return orders(spark, d).select("o_orderkey", And(()).to_column().alias("a"), Or(()).to_column().alias("o"))


@query("SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 5 = 0 THEN '{broken' WHEN event_id % 7 = 0 THEN '' ELSE '{\"k\": ' || event_id || '}' END::VARCHAR, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def parse_json(spark, d):
    rows = read(spark, d, "events").select("event_id", F.expr("case when event_id % 5 = 0 then '{broken' when event_id % 7 = 0 then '' else concat('{\"k\": ', event_id, '}') end").alias("t"))
    return rows.select("event_id", ParseJson(col("t"), "k bigint").to_column()["k"].alias("k"))


@query("SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"b\":\"' || lower(hex(n_name)) || '\",\"t\":\"1995-01-02T03:04:05.678Z\"}' AS j FROM nation")
def to_json(spark, d):
    rows = read(spark, d, "nation").selectExpr("n_nationkey", "struct(n_nationkey k, binary(n_name) b, timestamp'1995-01-02 03:04:05.678999' t) s")
    return rows.select("n_nationkey", ToJson(col("s"), rows.schema["s"].dataType).to_column().alias("j"))


@query("SELECT o_orderkey, o_custkey AS a, '' AS b, NULL::INTEGER AS c, NULL::DATE AS e FROM orders")
def map_to_struct(spark, d):
    rows = orders(spark, d).selectExpr("o_orderkey", "map('a', string(o_custkey), 'b', '', 'c', '') m")
    made = MapToStruct(col("m"), T.StructType.fromDDL("a bigint, b string, c int, e date")).to_column()
    return rows.select("o_orderkey", made.alias("s")).select("o_orderkey", "s.*")


# Scans


@query(f"SELECT {ORDERS} FROM orders")
def table_scan(spark, d):
    return new_table(spark, orders(spark, d), by="o_orderkey").snapshot().scan()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey < 100")
def table_scan_pruned(spark, d):
    return new_table(spark, orders(spark, d), by="o_orderkey").snapshot().scan(predicate=col("o_orderkey") < 100)


@query("SELECT 1::BIGINT AS kept, 4::BIGINT AS everything")
def files_pruned(spark, d):
    s = new_table(spark, orders(spark, d), files=4, by="o_orderkey").snapshot()
    return s.list_files(col("o_orderkey") < 100).agg(F.count(F.lit(1)).alias("kept")).withColumn("everything", F.lit(s.list_files().count()).cast("bigint"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 50")
def partition_pruned(spark, d):
    t = new_table(spark, orders(spark, d), partition_by=["o_orderpriority"])
    rule = col("o_orderpriority").eq("1-URGENT") & (col("o_orderkey") > 50)
    return t.snapshot().scan(["o_orderkey", "o_orderpriority"], rule)


@query("SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority IN ('1-URGENT')")
def partition_null(spark, d):
    t = new_table(spark, orders(spark, d).selectExpr("o_orderkey", "nullif(o_orderpriority, '5-LOW') p"), partition_by=["p"])
    return t.snapshot().scan(predicate=IsNull(col("p")) | In(col("p"), ("1-URGENT", None)))


@query("SELECT o_custkey, o_orderkey FROM orders")
def projection(spark, d):
    return new_table(spark, orders(spark, d), by="o_orderkey").snapshot().scan(["O_CUSTKEY", "o_orderkey"])


@query("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-01 00:00:10' AND NOT (user_id >= 50) OR event_id = 3")
def scan_timestamps(spark, d):
    import datetime as dt

    t = new_table(spark, read(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), by="ts")
    rule = (Compare(">", col("ts"), Literal(dt.datetime(2024, 1, 1, 0, 0, 10), "timestamp_ntz")) & ~(col("user_id") >= 50)) | col("event_id").eq(3)
    return t.snapshot().scan(["event_id", "event_type"], rule)


def _versions(spark: SparkSession, d: str, **properties) -> Table:
    """Five appends by key modulo 5, so that version v has the keys with modulo below v."""
    rows = orders(spark, d)
    t = create_table(spark, scratch(spark), rows.schema, properties=properties)
    for k in range(5):
        Transaction(t.snapshot()).append(rows.where(f"o_orderkey % 5 = {k}"), files_hint=2).commit()
    return t


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 5 < 3")
def time_travel_version(spark, d):
    return _versions(spark, d).snapshot(3).scan()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 5 < 2")
def time_travel_timestamp(spark, d):
    t = _versions(spark, d, **{fixed.P_ICT: "true"})
    return t.snapshot(t.version_at(dict(t.history())[2])).scan()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 5 <> 1")
def after_remove(spark, d):
    t = _versions(spark, d)
    gone = t.snapshot(2).list_files().join(t.snapshot(1).list_files().select("path"), "path", "left_anti")
    Transaction(t.snapshot(), operation="DELETE").remove_files(gone.select(*t.snapshot().list_files().columns)).commit()
    return t.snapshot().scan()


_DV = {fixed.P_DV: "true"}


def _deleted(spark: SparkSession, d: str, **properties) -> Table:
    t = new_table(spark, orders(spark, d), by="o_orderkey", properties=_DV | properties)
    Transaction(t.snapshot(), operation="DELETE").delete_where((col("o_orderkey") < 500) & col("o_orderstatus").eq("F")).commit()
    Transaction(t.snapshot(), operation="DELETE").delete_where(col("o_custkey").eq(7)).commit()
    return t


@query(f"SELECT {ORDERS} FROM orders WHERE NOT (o_orderkey < 500 AND o_orderstatus = 'F') AND o_custkey <> 7")
def after_dv_delete(spark, d):
    return _deleted(spark, d).snapshot().scan()


@query(f"SELECT {ORDERS} FROM orders WHERE NOT (o_orderkey < 500 AND o_orderstatus = 'F') AND o_custkey <> 7")
def checkpoint_read(spark, d):
    t = _deleted(spark, d)
    write_checkpoint(t.snapshot())
    Transaction(t.snapshot()).append(orders(spark, d).where("false")).commit()
    return t.snapshot().scan()


@query(f"SELECT {ORDERS} FROM orders WHERE NOT (o_orderkey < 500 AND o_orderstatus = 'F') AND o_custkey <> 7 AND o_orderkey > 300")
def checkpoint_v2_sidecars(spark, d):
    t = _deleted(spark, d, **{fixed.P_CHECKPOINT_POLICY: "v2", fixed.P_STATS_STRUCT: "true"})
    write_checkpoint(t.snapshot(), sidecars=True, sidecar_rows=2)
    return t.snapshot().scan(predicate=col("o_orderkey") > 300)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def column_mapped_scan(spark, d):
    t = new_table(spark, read(spark, d, "nation").select("n_nationkey", "n_name"), by="n_nationkey", properties={fixed.P_MAPPING: "name"})
    return t.snapshot().scan(predicate=col("N_NATIONKEY") >= 5)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def column_mapped_by_id(spark, d):
    t = new_table(spark, read(spark, d, "nation").select("n_nationkey", "n_name"), by="n_nationkey", properties={fixed.P_MAPPING: "id"})
    return t.snapshot().scan(predicate=col("n_nationkey") < 5)


@query("SELECT p_partkey, p_size::BIGINT AS p_size FROM part")
def widened_scan(spark, d):
    """Files with narrower integers than the schema has by now."""
    rows = read(spark, d, "part").select("p_partkey", "p_size")
    path = scratch(spark)
    t = create_table(spark, path, T.StructType.fromDDL("p_partkey bigint, p_size bigint"))
    rows.coalesce(1).write.parquet(f"{path}/old")
    tx = Transaction(t.snapshot())
    tx.add_files([{"path": f.path.split(f"{t.root}/")[-1], "partitionValues": {}, "size": f.size, "modificationTime": f.modified} for f in t.files.list(f"{t.root}/old") if f.name.endswith(".parquet")]).commit()
    return t.snapshot().scan()


@query("SELECT COUNT(*) AS n, COUNT(*) AS ids, 0::BIGINT AS lo, COUNT(*) - 1 AS hi FROM orders")
def row_ids_unique(spark, d):
    t = new_table(spark, orders(spark, d), by="o_orderkey", properties={fixed.P_ROW_TRACKING: "true"})
    return t.snapshot().scan(["o_orderkey"], row_id="id").agg(F.count("id").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'new' END AS note FROM orders")
def add_column(spark, d):
    rows = orders(spark, d).select("o_orderkey")
    t = new_table(spark, rows.where("o_orderkey % 2 = 0"))
    Transaction(t.snapshot()).add_column("note", T.StringType()).commit()
    Transaction(t.snapshot()).append(rows.where("o_orderkey % 2 = 1").withColumn("note", F.lit("new"))).commit()
    return t.snapshot().scan()


@query("SELECT o_orderkey, 'none' AS note FROM orders")
def column_defaults(spark, d):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("note", T.StringType(), True, {fixed.CURRENT_DEFAULT: "'none'"})])
    t = create_table(spark, scratch(spark), schema)
    Transaction(t.snapshot()).append(orders(spark, d).select("o_orderkey")).commit()
    return t.snapshot().scan()


# Changes


_CDF = {fixed.P_CDF: "true", fixed.P_DV: "true"}


@query(f"SELECT {ORDERS}, 'insert' AS _change_type, 1::BIGINT + o_orderkey % 5 AS _commit_version FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3")
def change_feed_inserts(spark, d):
    return ChangeFeed(_versions(spark, d, **_CDF), 2, 4).scan().drop("_commit_timestamp")


@query(f"SELECT {ORDERS}, 'delete' AS _change_type, 2::BIGINT AS _commit_version FROM orders WHERE o_orderkey < 500 AND o_orderstatus = 'F' UNION ALL SELECT {ORDERS}, 'delete', 3 FROM orders WHERE NOT (o_orderkey < 500 AND o_orderstatus = 'F') AND o_custkey = 7")
def change_feed_dv_delete(spark, d):
    return ChangeFeed(_deleted(spark, d, **_CDF), 2).scan().drop("_commit_timestamp")


@query("SELECT 6::BIGINT AS adds, 0::BIGINT AS removes")
def incremental_files(spark, d):
    got = incremental_scan(_versions(spark, d), 2, 5)
    return got.adds.agg(F.count(F.lit(1)).alias("adds")).withColumn("removes", F.lit(got.removes.count()).cast("bigint"))


@query("SELECT 0::BIGINT AS new, 0::BIGINT AS known, 2::BIGINT AS gone")
def incremental_against_base(spark, d):
    t = _versions(spark, d)
    Transaction(t.snapshot()).remove_files(t.snapshot(1).list_files()).commit()
    new, known, gone = incremental_scan(t, 5).against(file_keys(t.snapshot(5)))
    return spark.createDataFrame([(new.count(), known.count(), gone.count())], "new bigint, known bigint, gone bigint")


@query("SELECT * FROM (VALUES (5::BIGINT, 'WRITE'), (4::BIGINT, 'WRITE'), (3::BIGINT, 'WRITE'), (2::BIGINT, 'WRITE'), (1::BIGINT, 'WRITE'), (0::BIGINT, 'CREATE TABLE')) t(version, operation)")
def commit_history(spark, d):
    return commit_range(_versions(spark, d), 0, kinds=("commitInfo",), descending=True).select("version", F.col("commitInfo.operation").alias("operation"))


@query("SELECT 10::BIGINT AS every, 10::BIGINT AS net")
def tracked_file_changes(spark, d):
    t = _versions(spark, d, **{fixed.P_ROW_TRACKING: "true"})
    every = tracked_changes(t, 1).count()
    return tracked_changes(t, 1, net=True).agg(F.count(F.lit(1)).alias("net")).withColumn("every", F.lit(every).cast("bigint"))


# Maintenance


@query("SELECT 3::BIGINT AS files, COUNT(*) AS row_count FROM orders")
def file_stats(spark, d):
    s = new_table(spark, orders(spark, d), by="o_orderkey").snapshot()
    stats = s.list_files(stats="struct")
    return stats.agg(F.count(F.lit(1)).alias("files"), F.sum("stats_parsed.numRecords").alias("row_count"))


@query("SELECT 10::BIGINT AS files, true AS same")
def checksum_advanced(spark, d):
    t = _versions(spark, d)
    write_checksum(t.snapshot(3))
    s = t.snapshot()
    got = advance_checksum(s)
    return spark.createDataFrame([(got["numFiles"], got["tableSizeBytes"] == s.list_files().agg(F.sum("size")).first()[0])], "files bigint, same boolean")


@query("SELECT 95 AS bins, 10::BIGINT AS files")
def file_size_hist(spark, d):
    h = histogram(_versions(spark, d).snapshot().list_files())
    return spark.createDataFrame([(len(HISTOGRAM), sum(h["fileCounts"]))], "bins int, files bigint")


# Further operators


@query("SELECT n_nationkey, 'nations' AS origin, 7::BIGINT AS batch FROM nation UNION ALL SELECT r_regionkey, 'regions', 8 FROM region")
def scan_parquet_constants(spark, d):
    kinds = T.StructType.fromDDL("origin string, batch bigint")
    nations, regions = f"{d}/nation.parquet", f"{d}/region.parquet"
    one = R.scan_parquet(spark, [nations], read(spark, d, "nation").select("n_nationkey").schema, {nations: {"origin": "nations", "batch": 7}}, kinds)
    two = R.scan_parquet(spark, [regions], read(spark, d, "region").select("r_regionkey").schema, {regions: {"origin": "regions", "batch": 8}}, kinds)
    return R.union_all(one, two.withColumnRenamed("r_regionkey", "n_nationkey"))


@query("SELECT checkpoints, 1::BIGINT AS files, (SELECT COUNT(*) FROM orders) AS row_count FROM (VALUES ('none'), ('one'), ('two')) t(checkpoints)")
def checkpoint_struct_only_pruned(spark, d):
    """Files kept by a predicate, and rows by statistics, before and after checkpoints that hold statistics as a struct only."""
    t = new_table(spark, orders(spark, d), files=4, by="o_orderkey", properties={fixed.P_STATS_STRUCT: "true", fixed.P_STATS_JSON: "false"})
    out = []

    def look(name):
        s = t.snapshot()
        out.append((name, s.list_files(col("o_orderkey") < 3).count(), s.list_files(stats="struct").agg(F.sum("stats_parsed.numRecords")).first()[0]))

    look("none")
    for name in ("one", "two"):
        write_checkpoint(t.snapshot())
        look(name)
        Transaction(t.snapshot()).set_app("a", len(out)).commit()
    return spark.createDataFrame(out, "checkpoints string, files bigint, row_count bigint")


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 5 <> 0")
def compacted_log(spark, d):
    """A compacted file stands for versions 1 to 6, the last of which removes what the first added."""
    t = _versions(spark, d)
    Transaction(t.snapshot()).remove_files(t.snapshot(1).list_files()).commit()
    lines = [x for v in range(1, 7) for x in t.files.read(f"{fixed.LOG_DIR}/{v:020d}.json").decode().splitlines()]
    gone = {json.loads(x)["remove"]["path"] for x in lines if x.startswith('{"remove"')}
    kept = [x for x in lines if not x.startswith('{"add"') or json.loads(x)["add"]["path"] not in gone]  # the newest action of each file
    t.files.write(f"{fixed.LOG_DIR}/{1:020d}.{6:020d}.compacted.json", ("\n".join(kept) + "\n").encode())
    s = t.snapshot()
    return s.scan() if len(s.log.cover()) == 2 else s.scan().limit(0)


@query(f"SELECT 'tail' AS seen, {ORDERS} FROM orders WHERE o_orderkey % 5 < 2 UNION ALL SELECT 'published', {ORDERS} FROM orders WHERE o_orderkey % 5 < 2")
def staged_commits(spark, d):
    """A commit that a catalog has ratified is seen through the log's tail, and by all once it is published."""
    rows, staged = orders(spark, d), []
    t = create_table(spark, scratch(spark), rows.schema)
    Transaction(t.snapshot()).append(rows.where("o_orderkey % 5 = 0")).commit()
    Transaction(t.snapshot(), committer=StagingCommitter(lambda version, path: staged.append(path) or True)).append(rows.where("o_orderkey % 5 = 1")).commit()
    tail = t.snapshot(log_tail=[parse(f) for f in t.files.list(f"{fixed.LOG_DIR}/{fixed.STAGED_DIR}")]).scan()
    tail = tail.select(F.lit("tail").alias("seen"), *ORDERS.split(", "))
    publish(t.files, 2, staged[0])
    return tail.unionByName(t.snapshot().scan().select(F.lit("published").alias("seen"), *ORDERS.split(", ")))


@query("SELECT 'app' AS app, 7::BIGINT AS version, 'two' AS mine, NULL::VARCHAR AS other")
def application_versions_and_domains(spark, d):
    t = new_table(spark, orders(spark, d), by="o_orderkey", properties={fixed.FEATURE_PREFIX + "domainMetadata": "supported"})
    Transaction(t.snapshot()).set_app("app", 6).set_domain("mine", "one").set_domain("other", "x").commit()
    Transaction(t.snapshot()).set_app("app", 7).set_domain("mine", "two").commit()
    Transaction(t.snapshot()).remove_domain("other").commit()
    s = t.snapshot()
    return spark.createDataFrame([("app", s.app_version("app"), s.domain("mine"), s.domain("other"))], "app string, version bigint, mine string, other string")


@query("SELECT 2::BIGINT AS resumed, 2::BIGINT AS whole, true AS refreshed")
def file_list_resumed(spark, d):
    t = _versions(spark, d)
    old = t.snapshot(3)
    known = old.list_files()
    Transaction(t.snapshot()).remove_files(known).commit()
    s = old.refreshed()
    rule = "o_orderkey < 100"
    resumed, whole = s.list_files_from(known, 3, rule).count(), s.list_files(rule).count()
    return spark.createDataFrame([(resumed // 2, whole // 2, s.version == 6 and s.refreshed() is s)], "resumed bigint, whole bigint, refreshed boolean")


@query(f"SELECT {ORDERS}, 1::BIGINT AS files FROM orders WHERE o_orderkey < 5")
def opaque_skipping(spark, d):
    """A predicate of the host engine with a rule of its own over statistics; unknown predicates skip nothing."""
    s = new_table(spark, orders(spark, d), by="o_orderkey").snapshot()
    rule = OpaquePredicate(lambda: F.col("o_orderkey") < 5, lambda stats: stats.minimum(("o_orderkey",)) < 5)
    files = s.list_files(And((rule, UnknownPredicate("later")))).count()
    return s.scan(predicate=rule).withColumn("files", F.lit(files).cast("bigint"))


@query("SELECT o_orderkey, o_orderkey * 2 AS doubled, o_custkey > 10 AS big FROM orders")
def opaque_and_boolean_expressions(spark, d):
    rows = orders(spark, d)
    kind = rows.schema["o_orderkey"].dataType
    schema = T.StructType([T.StructField("o_orderkey", kind), T.StructField("doubled", kind), T.StructField("big", T.BooleanType())])
    return R.project(rows, [col("o_orderkey"), Opaque(lambda: F.col("o_orderkey") * F.lit(2).cast(kind)), col("o_custkey") > 10], schema)


@query(f"SELECT {ORDERS}, '[[\"o_orderkey\"]]' AS layout FROM orders")
def clustered_table(spark, d):
    rows = orders(spark, d)
    t = create_table(spark, scratch(spark), rows.schema, cluster_by=["o_orderkey"])
    Transaction(t.snapshot()).append(rows).commit()
    s = t.snapshot()
    layout = json.dumps(json.loads(s.domain(fixed.CLUSTERING_DOMAIN, internal=True))["clusteringColumns"])
    return s.scan().withColumn("layout", F.lit(layout))


@query("SELECT 'manifest' AS kind, true AS parsed, 2::BIGINT AS events, true AS timed")
def checkpoint_shape_and_events(spark, d):
    t, events = _deleted(spark, d, **{fixed.P_CHECKPOINT_POLICY: "v2", fixed.P_STATS_STRUCT: "true"}), []
    measured("checkpoint", events.append, lambda: write_checkpoint(t.snapshot(), sidecars=True, sidecar_rows=2))
    shape = measured("shape", events.append, lambda: checkpoint_shape(t.snapshot()))
    return spark.createDataFrame([(shape["kind"], shape["parsed_stats"], len(events), all(e.seconds > 0 for e in events))], "kind string, parsed boolean, events bigint, timed boolean")


@query(f"SELECT {ORDERS}, 'update_postimage' AS _change_type, 2::BIGINT AS _commit_version FROM orders WHERE o_orderkey < 100")
def change_feed_change_files(spark, d):
    """A commit with change files is told by them alone, whatever it adds and removes."""
    t = new_table(spark, orders(spark, d), by="o_orderkey", properties=_CDF)
    orders(spark, d).where("o_orderkey < 100").withColumn("_change_type", F.lit("update_postimage")).coalesce(1).write.parquet(f"{t.root}/_change_data/one")
    file = next(f for f in t.files.list("_change_data/one") if f.name.endswith(".parquet"))
    known = t.snapshot().list_files().first().asDict(True)
    lines = [actions.line("cdc", path=f"_change_data/one/{file.name}", partitionValues={}, size=file.size, dataChange=False), actions.line("remove", path=known["path"], deletionTimestamp=1, dataChange=True)]
    t.files.write(f"{fixed.LOG_DIR}/{2:020d}.json", ("\n".join(lines) + "\n").encode())
    return ChangeFeed(t, 2).scan().drop("_commit_timestamp")


@query("SELECT event_id, event_type, 'insert' AS _change_type FROM events WHERE event_id % 4 < 2")
def change_stream(spark, d):
    """Two commits handled by a stream that stops when it has seen all there is."""
    rows = read(spark, d, "events").select("event_id", "event_type")
    t = create_table(spark, scratch(spark), rows.schema, properties=_CDF)
    for k in range(2):
        Transaction(t.snapshot()).append(rows.where(f"event_id % 4 = {k}")).commit()
    out = scratch(spark)
    stream_changes(spark, t.root, lambda changes, _: changes.select("event_id", "event_type", "_change_type").write.mode("append").parquet(out), scratch(spark), since=1).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1993-01-01' AND o_totalprice < 100000")
def typed_skipping(spark, d):
    """Predicates over dates and doubles, by text, with the statistics of each type."""
    rows = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"), "o_orderkey")
    s = new_table(spark, rows, files=6, by="day").snapshot()
    return s.scan(predicate="day < DATE '1993-01-01' AND price < 100000")


@query("SELECT o_orderkey, o_orderstatus, true AS placed, true AS in_file FROM orders")
def metadata_columns(spark, d):
    s = new_table(spark, orders(spark, d), by="o_orderkey").snapshot()
    got = s.scan(["o_orderkey", "o_orderstatus"], row_index="at", file_path="path")
    return got.select("o_orderkey", "o_orderstatus", (F.col("at") >= 0).alias("placed"), F.col("path").endswith(".parquet").alias("in_file"))


@query(f"SELECT {ORDERS}, NULL::VARCHAR AS note FROM orders UNION ALL SELECT 0, NULL, NULL, NULL, 'x'")
def nullable_and_added_columns(spark, d):
    rows = orders(spark, d)
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != "o_custkey") for f in rows.schema.fields])
    t = create_table(spark, scratch(spark), schema)
    Transaction(t.snapshot()).append(rows).commit()
    Transaction(t.snapshot()).set_nullable("o_custkey").commit()
    Transaction(t.snapshot()).add_column("note", T.StringType()).commit()
    Transaction(t.snapshot()).append(spark.range(1).select(F.col("id").cast(rows.schema["o_orderkey"].dataType).alias("o_orderkey"), F.lit("x").alias("note"))).commit()
    return t.snapshot().scan()
