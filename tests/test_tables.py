"""Truth tables and invariants of the table layer."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import fixed
from tarn.functions import deletion_vectors as dv
from tarn.functions.expressions import And, Compare, In, IsNull, Literal, Not, Or, OpaquePredicate, UnknownPredicate, always_false, col, lit
from tarn.operators.changes import ChangeFeed, incremental_scan
from tarn.operators.maintenance import HISTOGRAM, bin_of, checkpoint_shape, reconciled, write_checkpoint, write_checksum
from tarn.operators.transaction import Transaction, create_table, partition_text
from tarn.plans import relational as R
from tarn.sources.files import FileMeta, Files
from tarn.sources.log import LogFile, LogSegment, TableError, complete_checkpoints, earliest_versions, parse, segment
from tarn.streaming.change_stream import stream_changes
from tarn.table import Table, cancellable


# Deletion vectors


def test_z85_and_paths():
    # A published textual path and its file.
    d = {"storageType": "u", "pathOrInlineDv": "ab^-aqEH.-t@S}K{vb[*k^", "offset": 4, "sizeInBytes": 40, "cardinality": 6}
    assert dv.file_of(d) == "ab/deletion_vector_d2c639aa-8816-431a-aaf6-d3fe2512ff61.bin"
    assert dv.file_of({**d, "pathOrInlineDv": "vBn[lx{q8@P<9BNH/isA"}) == "deletion_vector_61d16c75-6994-46b7-a15b-8b538852e50e.bin"
    text, name = dv.new_path("x")
    assert dv.file_of({"storageType": "u", "pathOrInlineDv": text}) == name


@pytest.mark.parametrize("rows", [[], [0], [3, 4, 7, 11, 18, 29], list(range(70_000)), [5, 2**16, 2**32, 2**32 + 9, 2**40], list(range(0, 200_000, 3))])
def test_bitmaps_round_trip(rows):
    rows = np.array(rows, np.uint64)
    assert (dv.decode_bitmap(dv.encode_bitmap(rows)) == rows).all()
    d = dv.inline(rows)
    assert (dv.decode_bitmap(dv.z85_decode(d["pathOrInlineDv"])[: d["sizeInBytes"]]) == rows).all()
    data, entries = dv.write_file([rows, np.array([1], np.uint64)])
    for want, e in zip([rows, [1]], entries, strict=True):
        assert (dv.read_file_entry(data, e["offset"], e["sizeInBytes"]) == want).all() and e["cardinality"] == len(want)
    with pytest.raises(ValueError):
        dv.read_file_entry(data[:-1] + bytes([data[-1] ^ 1]), entries[1]["offset"], entries[1]["sizeInBytes"])


def test_run_containers():
    import struct

    one = struct.pack("<H", 12347) + struct.pack("<H", 0) + bytes([1]) + struct.pack("<HH", 2, 6) + struct.pack("<H", 2) + struct.pack("<HHHH", 5, 3, 100, 2)
    payload = struct.pack("<i", fixed.DV_MAGIC) + struct.pack("<QI", 1, 0) + one
    assert dv.decode_bitmap(payload).tolist() == [2 * 65536 + x for x in (5, 6, 7, 8, 100, 101, 102)]


# The log


def meta(name, size=1):
    return FileMeta(f"file:/t/{fixed.LOG_DIR}/{name}", 0, size)


def test_names():
    v = "0" * 19
    assert parse(meta(f"{v}7.json")).kind == "commit" and parse(meta("7.json")) is None
    assert parse(meta(f"{v}7.checkpoint.parquet")).kind == "classic"
    assert parse(meta(f"{v}7.checkpoint.0000000003.0000000002.parquet")) is None
    c = parse(meta(f"{v}2.{v}5.compacted.json"))
    assert (c.kind, c.low, c.version) == ("compacted", 2, 5)
    assert parse(meta(f"{v}7.{'a' * 8}-aaaa-aaaa-aaaa-{'a' * 12}.json")) is None  # staged commits are in their own folder
    part = lambda i: LogFile("multi", 3, meta("x"), part=i, parts=2)
    assert complete_checkpoints([part(1)]) == {}
    classic, named = LogFile("classic", 3, meta("c")), LogFile("uuid", 3, meta("u"))
    assert complete_checkpoints([classic, part(1), part(2)])[3] == [part(1), part(2)]
    assert complete_checkpoints([classic, named, part(1), part(2)])[3] == [named]
    assert complete_checkpoints([LogFile("classic", 3, meta("c", 0))]) == {}


def test_cover():
    commits = [LogFile("commit", v, meta(str(v))) for v in range(10)]
    packs = [LogFile("compacted", hi, meta(f"{lo}-{hi}"), low=lo) for lo, hi in ((1, 3), (1, 5), (4, 9), (6, 8))]
    got = LogSegment(9, commits=commits, compacted=packs).cover()
    assert [(c.low if c.kind == "compacted" else c.version, c.version) for c in got] == [(0, 0), (1, 5), (6, 8), (9, 9)]


def small(spark, tmp_path, rows=40, **options):
    schema = T.StructType.fromDDL("id bigint, name string, part int")
    t = create_table(spark, str(tmp_path / "t"), schema, **options)
    df = spark.range(rows).selectExpr("id", "concat('n', id) name", "int(id % 4) part")
    Transaction(t.snapshot()).append(df.repartitionByRange(2, "id")).commit()
    return t, df


def test_gaps_and_hints(spark, tmp_path):
    t, df = small(spark, tmp_path)
    for _ in range(3):
        Transaction(t.snapshot()).append(df.limit(1)).commit()
    log = tmp_path / "t" / fixed.LOG_DIR
    assert t.snapshot().version == 4 and t.snapshot(2).scan().count() == 41
    with pytest.raises(TableError):
        t.snapshot(9)
    os.rename(log / f"{2:020d}.json", log / "gone")
    with pytest.raises(TableError):
        t.snapshot()
    assert t.snapshot(1).version == 1
    os.rename(log / "gone", log / f"{2:020d}.json")
    (log / "_last_checkpoint").write_text('{"version": 3, "size": 1}')
    with pytest.raises(TableError):
        t.snapshot()
    (log / "_last_checkpoint").write_text("junk")
    assert write_checkpoint(t.snapshot(3)) and not write_checkpoint(t.snapshot(3))
    for v in range(3):
        os.remove(log / f"{v:020d}.json")
    assert t.snapshot().scan().count() == 43 and earliest_versions(t.files) == (3, 3)
    with pytest.raises(TableError):
        t.snapshot(1)
    with pytest.raises(TableError):
        Table(spark, str(tmp_path / "none")).snapshot()


def test_compacted_and_staged_commits(spark, tmp_path):
    t, df = small(spark, tmp_path)
    Transaction(t.snapshot()).append(df.limit(2)).commit()
    Transaction(t.snapshot()).remove_files(t.snapshot(1).list_files()).commit()
    log = tmp_path / "t" / fixed.LOG_DIR
    whole = sorted(map(tuple, t.snapshot().scan().collect()))
    lines = [x for v in (1, 2) for x in (log / f"{v:020d}.json").read_text().splitlines()]
    (log / f"{1:020d}.{2:020d}.compacted.json").write_text("\n".join(lines) + "\n")
    s = t.snapshot()
    assert len(s.log.cover()) == 3 and sorted(map(tuple, s.scan().collect())) == whole and len(whole) == 2
    staged = log / "_staged_commits"
    staged.mkdir()
    os.rename(log / f"{3:020d}.json", staged / f"{3:020d}.{'0' * 8}-0000-0000-0000-{'0' * 12}.json")
    assert t.snapshot().version == 2
    tail = [parse(f) for f in t.files.list(f"{fixed.LOG_DIR}/{fixed.STAGED_DIR}")]
    assert sorted(map(tuple, t.snapshot(log_tail=tail).scan().collect())) == whole
    with pytest.raises(TableError):
        t.snapshot(3, log_tail=tail, max_version=2)


# Skipping


def random_predicate(rng, depth=2):
    if depth and rng.random() < 0.5:
        parts = tuple(random_predicate(rng, depth - 1) for _ in range(rng.randint(0, 3)))
        return rng.choice([And, Or])(parts)
    if rng.random() < 0.2:
        return Not(random_predicate(rng, max(depth - 1, 0)))
    name = rng.choice(["a", "s", "f", "p", "t"])
    value = {"a": rng.choice([-5, 0, 7, 30, 99, None]), "s": rng.choice(["", "k", "z" * 40, None]), "f": rng.choice([0.5, -1.0, 3.25, None]), "p": rng.choice(["x", "y", "q", None]), "t": rng.choice([dt.datetime(2020, 1, 1, 0, 0, 0, 1500), dt.datetime(2020, 1, 1, 0, 0, 0, 2000), None])}[name]
    kind = {"t": "timestamp_ntz", "a": "bigint", "s": "string", "f": "double", "p": "string"}[name]
    value = Literal(value, kind)
    r = rng.random()
    if r < 0.15:
        return IsNull(col(name))
    if r < 0.25 and name != "t":
        return In(col(name), (value.value, None))
    sides = (col(name), value) if rng.random() < 0.7 else (value, col(name))
    return Compare(rng.choice(["<", "<=", ">", ">=", "=", "!=", "distinct"]), *sides)


def test_skipping_never_changes_results(spark, tmp_path):
    rng = random.Random(1)
    schema = T.StructType.fromDDL("a bigint, s string, f double, p string, t timestamp_ntz")
    t = create_table(spark, str(tmp_path / "t"), schema, partition_by=["p"])
    every = []
    for k in range(6):
        rows = [(None if k == 0 or rng.random() < 0.2 else rng.randint(k * 10, k * 10 + 9), rng.choice([None, "", "k", "z" * 40 + "q", "é" * 33]), rng.choice([None, float("nan"), 0.5, 9.0 * k]), rng.choice([None, "x", "y"]), dt.datetime(2020, 1, 1, 0, 0, 0, 1000 * k + 700)) for _ in range(8)]
        every += rows
        Transaction(t.snapshot()).append(spark.createDataFrame(rows, schema), files_hint=1).commit()
    s = t.snapshot()
    plain = spark.createDataFrame(every, schema).persist()
    total, kept = s.list_files().count(), 0
    for i in range(40):
        p = random_predicate(rng)
        want = sorted(str(tuple(r)) for r in plain.where(p.to_column()).collect())
        assert sorted(str(tuple(r)) for r in s.scan(predicate=p).collect()) == want, p
        kept += s.list_files(p).count() if i < 15 else 0
    assert kept < 15 * total * 0.8


def test_skipping_rules(spark, tmp_path):
    t, _ = small(spark, tmp_path)
    s = t.snapshot()
    n = lambda p: s.list_files(p).count()
    assert n(col("id") < 20) == 1 and n(lit(20) > col("id")) == 1 and n(Not(col("id") >= 20)) == 1
    assert n(col("id").eq(25)) == 1 and n(col("id").is_null()) == 0 and n(col("id").is_not_null()) == 2
    assert n(col("id").eq(None)) == 0 and n(col("id").distinct_from(None)) == 2
    assert n(And((col("id") < 20, UnknownPredicate("x")))) == 1 and n(Or((col("id") < 20, UnknownPredicate("x")))) == 2
    assert n(OpaquePredicate(lambda: F.col("id") < 5, lambda st: st.minimum(("id",)) < 5)) == 1
    assert n(In(col("id"), (1, 2))) == 2 and n(Compare("<", col("id"), col("part"))) == 2
    with pytest.raises(TableError):
        n(col("nothing") < 1)
    with pytest.raises(ValueError):
        s.scan(predicate=UnknownPredicate("x"))
    assert always_false(And((col("id") < 1, Compare(">", lit(1), lit(2))))) and not always_false(Or(()) | (col("id") < 1))
    assert n(Compare("=", lit(1), lit(2))) == 0


def test_string_statistics(spark, tmp_path):
    schema = T.StructType.fromDDL("s string")
    t = create_table(spark, str(tmp_path / "t"), schema)
    top = "\U0010ffff"
    for text in ["a" * 31, "b" * 40, "c" * 32 + "é", top * 33 + "x", top * 70, "é" * 20]:
        Transaction(t.snapshot()).append(spark.createDataFrame([(text,)], schema), files_hint=1).commit()
    got = {(json.loads(r[0])["minValues"]["s"], json.loads(r[0]).get("maxValues", {}).get("s")) for r in t.snapshot().list_files().select("stats").collect()}
    assert got == {("a" * 31, "a" * 31), ("b" * 32, "b" * 32 + "\x7f"), ("c" * 32, "c" * 32 + top), (top * 32, top * 33 + "\x7f"), (top * 32, None), ("é" * 20, "é" * 20)}


def test_partition_text(spark):
    row = spark.sql("select 1.0e7d d, -0.0d z, timestamp'2020-01-02 03:04:05.5' t, '' e, date'2020-01-02' x").select(*[partition_text(F.col(c), k).alias(c) for c, k in (("d", T.DoubleType()), ("z", T.DoubleType()), ("t", T.TimestampType()), ("e", T.StringType()), ("x", T.DateType()))]).first()
    assert tuple(row) == ("1.0E7", "-0.0", "2020-01-02T03:04:05.500000Z", None, "2020-01-02")


# Writing


def test_conflicts_and_rules(spark, tmp_path):
    t, df = small(spark, tmp_path, properties={fixed.P_APPEND_ONLY: "true"})
    a, b = Transaction(t.snapshot()), Transaction(t.snapshot())
    assert a.append(df.limit(1)).set_app("app", 5).commit().kind == "committed"
    assert b.append(df.limit(1)).commit().kind == "conflict"
    assert t.snapshot().app_version("app") == 5 and t.snapshot().app_version("other") is None
    with pytest.raises(TableError):
        Transaction(t.snapshot()).remove_files(t.snapshot().list_files()).commit()
    assert Transaction(t.snapshot(), data_change=False).remove_files(t.snapshot().list_files()).commit().kind == "committed"
    with pytest.raises(TableError):
        Transaction(t.snapshot(), blind_append=True).commit()
    tx = Transaction(t.snapshot()).set_app("x", 1)
    with pytest.raises(TableError):
        tx.set_app("x", 2)
    with pytest.raises(TableError):
        tx.set_domain(fixed.SYSTEM_DOMAIN_PREFIX + "x", "{}")
    with pytest.raises(TableError):
        create_table(spark, t.root, T.StructType.fromDDL("id int"))
    with pytest.raises(TableError):
        Transaction(t.snapshot()).add_files([{"path": "x"}])


def test_features_fail_closed(spark, tmp_path):
    t, _ = small(spark, tmp_path)
    lines = [json.dumps({"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["timeMachine"], "writerFeatures": ["timeMachine"]}})]
    (tmp_path / "t" / fixed.LOG_DIR / f"{2:020d}.json").write_text("\n".join(lines) + "\n")
    with pytest.raises(TableError):
        t.snapshot().scan()
    with pytest.raises(TableError):
        Transaction(t.snapshot())


def test_domains_checkpoints_and_expiry(spark, tmp_path):
    t, df = small(spark, tmp_path, cluster_by=["id"], properties={fixed.FEATURE_PREFIX + "v2Checkpoint": "supported", fixed.P_STATS_STRUCT: "true", fixed.P_STATS_JSON: "false"})
    assert json.loads(t.snapshot().domain(fixed.CLUSTERING_DOMAIN, internal=True)) == {"clusteringColumns": [["id"]]}
    Transaction(t.snapshot()).set_domain("mine", "one").commit()
    Transaction(t.snapshot()).set_domain("mine", "two").set_domain("other", "x").commit()
    Transaction(t.snapshot()).remove_domain("other").remove_files(t.snapshot().list_files().limit(1)).commit()
    s = t.snapshot()
    assert (s.domain("mine"), s.domain("other")) == ("two", None)
    rows = reconciled(s).collect()
    assert {r.domainMetadata.domain for r in rows if r.domainMetadata} == {"mine", fixed.CLUSTERING_DOMAIN} and sum(r.remove is not None for r in rows) == 1
    late = reconciled(s, 2**50).collect()
    assert not any(r.remove for r in late) and sum(r.add is not None for r in late) == 1
    before = sorted(map(tuple, s.scan().collect()))
    assert write_checkpoint(s, sidecars=True)
    s = t.snapshot()
    assert checkpoint_shape(s) == {"kind": "manifest", "parsed_stats": True} and s.domain("mine") == "two"
    assert sorted(map(tuple, s.scan().collect())) == before
    hint = json.loads((tmp_path / "t" / fixed.LOG_DIR / "_last_checkpoint").read_text())
    assert hint["version"] == s.version and hint["numOfAddFiles"] == 1


def test_checksum_serves_protocol_and_falls_back(spark, tmp_path):
    t, _ = small(spark, tmp_path)
    assert write_checksum(t.snapshot()) and not write_checksum(t.snapshot())
    s = t.snapshot()
    assert s.log.crc and s.schema.names == ["id", "name", "part"] and s.file_stats()["numFiles"] == 2
    (tmp_path / "t" / fixed.LOG_DIR / f"{1:020d}.crc").write_text("junk")
    assert t.snapshot().schema.names == ["id", "name", "part"] and t.snapshot().file_stats()["numFiles"] == 2
    assert bin_of(0) == 0 and bin_of(8191) == 0 and bin_of(8192) == 1 and bin_of(2**50) == len(HISTOGRAM) - 1 == 94


def test_odd_names(spark, tmp_path):
    t, _ = small(spark, tmp_path / "dir with space%é", partition_by=["name"], rows=3, properties={fixed.P_DV: "true"})
    rows = spark.createDataFrame([(9, "a b/c=%é:{x}", 1), (10, None, 1)], "id bigint, name string, part int")
    Transaction(t.snapshot()).append(rows).commit()
    Transaction(t.snapshot()).delete_where(col("id").eq(1)).commit()
    got = {r.id: r.name for r in t.snapshot().scan().collect()}
    assert got == {0: "n0", 2: "n2", 9: "a b/c=%é:{x}", 10: None}


def test_nested_mapping(spark, tmp_path):
    schema = T.StructType.fromDDL("id bigint, s struct<a: int, b: struct<c: string>>, l array<struct<x: int>>, m map<string, struct<y: int>>")
    t = create_table(spark, str(tmp_path / "t"), schema, properties={fixed.P_MAPPING: "name"})
    rows = spark.sql("select 1L id, struct(5 a, struct('q' c) b) s, array(struct(7 x)) l, map('k', struct(8 y)) m union all select 2L, null, null, null")
    Transaction(t.snapshot()).append(rows).commit()
    got = t.snapshot().scan(predicate=col("s.a").eq(5)).collect()
    assert len(got) == 1 and got[0].s.b.c == "q" and got[0].l[0].x == 7 and got[0].m["k"].y == 8
    assert t.snapshot().scan().where("s is null").count() == 1


# Changes


def test_change_feed_rules(spark, tmp_path):
    t, df = small(spark, tmp_path)
    with pytest.raises(TableError):
        ChangeFeed(t, 0)
    with pytest.raises(TableError):
        ChangeFeed(t, 5)
    assert incremental_scan(t, 7) is None
    t2, df = small(spark, tmp_path / "b", properties={fixed.P_CDF: "true", fixed.P_DV: "true"})
    with pytest.raises(TableError):
        Transaction(t2.snapshot()).append(df).remove_files(t2.snapshot().list_files()).commit()
    Transaction(t2.snapshot(), data_change=False).remove_files(t2.snapshot().list_files().limit(1)).commit()
    assert ChangeFeed(t2, 2).scan().count() == 0


def test_change_stream(spark, tmp_path):
    t, df = small(spark, tmp_path, properties={fixed.P_CDF: "true"})
    seen = []
    run = lambda: stream_changes(spark, t.root, lambda rows, _: seen.extend(rows.select("id", "_change_type").collect()), str(tmp_path / "cp"), since=1).awaitTermination()
    run()
    assert len(seen) == 40
    Transaction(t.snapshot()).append(df.where("id < 3")).commit()
    run()
    assert sorted(r.id for r in seen[40:]) == [0, 1, 2] and {r[1] for r in seen} == {"insert"}


# Relational rules


def test_plan_errors(spark):
    df = spark.range(2)
    with pytest.raises(R.PlanError):
        R.project(df, [col("id")], T.StructType.fromDDL("id int"))
    with pytest.raises(R.PlanError):
        R.project(df, [col("id")], T.StructType.fromDDL("a bigint, b bigint"))
    with pytest.raises(R.PlanError):
        R.union_all(df, df.withColumn("x", F.lit(1)))
    with pytest.raises(R.PlanError):
        R.values(spark, T.StructType.fromDDL("a int"), [(1, 2)])
    with pytest.raises(R.PlanError):
        R.project_patch(df, R.Patch().drop("x"))


def test_missing_required_column(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "f"))
    with pytest.raises(R.PlanError):
        R.scan_parquet(spark, [str(tmp_path / "f")], T.StructType([T.StructField("x", T.IntegerType(), False)]))
    got = R.scan_parquet(spark, [str(tmp_path / "f")], T.StructType.fromDDL("x int, id bigint"), row_index="i")
    assert sorted(map(tuple, got.collect()))[0][0] is None and got.columns == ["x", "id", "i"]


def test_put_if_absent(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.put_if_absent("a/b.json", b"1") and not files.put_if_absent("a/b.json", b"2")
    assert files.read("a/b.json") == b"1" and [f.name for f in files.list("a")] == ["b.json"]
    with pytest.raises(TableError):
        segment(files)


def test_resumed_lists_and_text_predicates(spark, tmp_path):
    t, df = small(spark, tmp_path)
    known = t.snapshot(1).list_files()
    Transaction(t.snapshot()).append(df.where("id < 5")).commit()
    Transaction(t.snapshot()).remove_files(known.limit(1)).commit()
    s = t.snapshot()
    paths = lambda f: sorted(r.path for r in f.select("path").collect())
    assert paths(s.list_files_from(known, 1)) == paths(s.list_files())
    assert paths(s.list_files_from(known, 1, "id >= 30")) == paths(s.list_files(col("id") >= 30))
    assert s.scan(predicate="id BETWEEN 1 AND 3").count() == s.scan().where("id between 1 and 3").count()
    with cancellable(spark, "g") as cancel:
        assert spark.range(5).count() == 5
        cancel()


def test_sum_takes_longs_only(spark):
    df = spark.createDataFrame([(1.7, 1, 2), (1.9, 2, 3)], "d double, i int, n bigint")
    assert R.aggregate(df, [], R.agg_sum("n").alias("s")).first().s == 5
    for c in ("d", "i"):
        with pytest.raises(Exception, match="long|MISMATCH"):
            R.aggregate(df, [], R.agg_sum(c).alias("s")).collect()


def test_constants_belong_to_files(spark, tmp_path):
    df = spark.range(3).coalesce(1)
    for name in ("a b", "c"):
        df.write.parquet(str(tmp_path / name))
    files = [str(next((tmp_path / n).glob("*.parquet"))) for n in ("a b", "c")]
    kinds = T.StructType.fromDDL("k string")
    rows = R.scan_parquet(spark, files, df.schema, {f: {"k": f[-30:]} for f in files}, kinds).collect()
    assert sorted((r.id, r.k) for r in rows) == sorted((i, f[-30:]) for i in range(3) for f in files)
    with pytest.raises(R.PlanError):
        R.scan_parquet(spark, files, df.schema, {files[0]: {"k": "x"}}, kinds)


def test_reading_by_id_leaves_the_session_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.parquet.fieldId.read.enabled")
    t, df = small(spark, tmp_path, properties={fixed.P_MAPPING: "id"})
    assert t.snapshot().scan().count() == 40 and spark.conf.get("spark.sql.parquet.fieldId.read.enabled") == before


def test_statistics_outlive_struct_only_checkpoints(spark, tmp_path):
    t, df = small(spark, tmp_path, properties={fixed.P_STATS_STRUCT: "true", fixed.P_STATS_JSON: "false"})
    kept, rows = t.snapshot().list_files(col("id") < 20).count(), sorted(r.stats for r in t.snapshot().list_files().collect())
    for _ in range(2):
        assert write_checkpoint(t.snapshot()) and checkpoint_shape(t.snapshot())["parsed_stats"]
        s = t.snapshot()
        assert s.list_files(col("id") < 20).count() == kept == 1
        assert [json.loads(x)["numRecords"] for x in sorted(r.stats for r in s.list_files().collect())] == [json.loads(x)["numRecords"] for x in rows]
        assert s.scan(predicate=col("id") < 20).count() == df.where("id < 20").count()
        Transaction(s).set_app("x", s.version).commit()


def test_times_are_searched(spark, tmp_path):
    t, df = small(spark, tmp_path, properties={fixed.P_ICT: "true"})
    for _ in range(4):
        Transaction(t.snapshot()).append(df.limit(1)).commit()
    times = t.history()
    reads, read = [], t.files.read
    t.files.read = lambda path: reads.append(path) or read(path)
    for v, at in times:
        assert t.version_at(at) == v == t.version_from(at) and t.version_at(at + 0) == v
    assert t.version_from(times[2][1] + 1) == 3 and t.version_at(times[-1][1] + 10**6) == times[-1][0]
    with pytest.raises(TableError):
        t.version_at(times[0][1] - 1)
    with pytest.raises(TableError):
        t.version_from(times[-1][1] + 1)


def test_no_commit_without_an_atomic_write(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.scheme = "s3a"
    with pytest.raises(OSError):
        files.put_if_absent("x", b"1")
    assert not (tmp_path / "x").exists()


def test_staged_files_are_validated(spark, tmp_path):
    t, df = small(spark, tmp_path, cluster_by=["id"])
    file = {"path": "x.parquet", "size": 1, "modificationTime": 1, "partitionValues": {}}
    stats = lambda **more: json.dumps({"numRecords": 2, "nullCount": {"id": 0}, "minValues": {"id": 1}, "maxValues": {"id": 2}, **more})
    for bad in ({}, {"path": "", "stats": stats()}, {"size": -1, "stats": stats()}, {"stats": stats(minValues={})}, {"stats": stats(nullCount={})}, {"partitionValues": {"p": "1"}, "stats": stats()}):
        with pytest.raises(TableError):
            Transaction(t.snapshot()).add_files([file | bad])
    good = file | {"stats": stats()}
    Transaction(t.snapshot()).add_files([good, good | {"path": "y", "stats": json.dumps({"numRecords": 2, "nullCount": {"id": 2}})}])
    with pytest.raises(TableError):
        Transaction(t.snapshot()).add_files([good, good]).commit()
