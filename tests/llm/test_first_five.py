"""Brute-force tests of top-k search, sharding, mixing, exact deduplication and SimHash."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import simhash
from tarn.llm._shared import components
from tarn.llm.exact_dedup import exact_dedup
from tarn.llm.exact_topk import exact_topk
from tarn.llm.mixing import in_training_order, mix_sources, position
from tarn.llm.sharding import shard_by_bytes, text_size
from tarn.llm.simhash import fingerprint, fingerprint_links, golay_keys, simhash_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "x", "b"), (4, "x", "b"), (5, "été \U0001f600 " * 50_000, "b"), (None, "one two three", "c"), (7, "X", "a")]


# Top-k search


def brute_topk(rows, k, every):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in q:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in q if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e5])
def test_topk_matches_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = exact_topk(df, k=5, query_every=50, query_block=3, shard_rows=37)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5, 50)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, score int, ids string"  # names that clash
    assert exact_topk(spark.createDataFrame([], schema)).collect() == []
    assert exact_topk(spark.createDataFrame([(0, [1.0], 1, "x")], schema)).collect() == []
    got = exact_topk(spark.createDataFrame([(0, [1.0, 2.0], 1, "x"), (1, [], 1, "x"), (2, [1.0], 1, "x"), (2, [1.0], 1, "x")], schema))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 65536), (0, 2, 2, 65536), (0, 3, 1, 0)]
    twice = exact_topk(spark.createDataFrame([(0, [1.0], 1, "x"), (0, [1.0], 1, "x"), (3, [1.0], 1, "x")], schema))
    assert sorted(map(tuple, twice.collect())) == [(0, 1, 3, 65536)] * 2


def test_topk_sends_no_blocks_by_the_driver(spark):
    """Copies of the query blocks, one for each group of shards, aren't broadcast."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 5).cast("array<float>").alias("embedding"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = exact_topk(df.repartition(2), k=2, query_every=500, shard_rows=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
        assert got.count() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# Sharding


def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.choice([0, 5, 40, 900]), "s") for i in range(500)]
    df = docs_of(spark, rows).repartition(6).select("doc_id", text_size(F.col("text")).alias("size"))
    got = sorted(map(tuple, shard_by_bytes(df, 16, "size", ["doc_id", "size"]).select("doc_id", "size", "shard", "slot").collect()))
    total, before, slots = sum(len(t) + 1 for _, t, _ in rows), 0, defaultdict(int)
    for (i, size, shard, slot), (j, t, _) in zip(got, rows, strict=True):
        assert (i, size) == (j, len(t) + 1)
        assert shard == min(15, (2 * before + size) * 16 // (2 * total))
        assert slot == slots[shard]
        slots[shard] += 1
        before += size
    sums = [sum(s for _, s, x, _ in got if x == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * 901


def test_shards_edges(spark):
    df = docs_of(spark, ODD).select("doc_id", text_size(F.col("text")).alias("size"), F.lit(9).alias("shard"), F.lit(1).alias("n_rows"))
    got = shard_by_bytes(df, 4, "size", ["doc_id", "size"])
    assert got.count() == len(ODD) and got.columns.count("shard") == 1
    assert {r.shard for r in got.collect()} <= set(range(4))
    assert shard_by_bytes(df.limit(0), 4, "size", ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        shard_by_bytes(df, 0, "size", ["doc_id"])


# Mixing


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    count = {"a": 400, "b": 20, "c": 5, "": 60, "\U00010000": 60, None: 50}
    rows, i = [], 0
    for s, n in count.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * rng.randint(1, 30)), s))
            i += 1
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water_fill(sizes)
    got = mix_sources(docs_of(spark, rows).repartition(5), keep=("source",)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-5)
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 31
    again = mix_sources(docs_of(spark, rows[::-1]).repartition(3), keep=("source",)).collect()
    assert sorted(again, key=lambda r: r.doc_id) == sorted(got, key=lambda r: r.doc_id)


def test_curriculum_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    mixed = mix_sources(docs_of(spark, rows), keep=("source",))
    early = {r[0]: r[1] for r in mixed.select("source", F.explode("positions").alias("p")).where("p < 0.5").groupBy("source").count().collect()}
    whole = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum("copies")).collect()}
    # Rank 0 rises from half to one and a half of its mean weight: 3/8 of it comes in the first half; rank 1 falls.
    assert early["a"] / whole["a"] == pytest.approx(3 / 8, abs=0.01)
    assert early["b"] / whole["b"] == pytest.approx(5 / 8, abs=0.01)
    order = [r.position for r in in_training_order(mixed).select("position").collect()]
    assert order == sorted(order) and len(order) == sum(whole.values())


def test_position_inverts_the_integral(spark):
    pieces = "array(struct(0d as t0, 0.5d as t1, 2d as w0, 0d as w1, 0d as a0), struct(0.5d as t0, 1d as t1, 0d as w0, 4d as w1, 0.5d as a0))"
    got = spark.range(11).select((F.col("id") / 10).alias("u"), position(F.col("id") / 10, F.expr(pieces), F.lit(1.5)).alias("t")).collect()
    for u, t in got:
        area = 2 * t - 2 * t * t if t <= 0.5 else 0.5 + 4 * (t - 0.5) ** 2
        assert area == pytest.approx(1.5 * u, abs=1e-9)


def test_mix_edges(spark):
    assert mix_sources(docs_of(spark, [])).collect() == []
    got = mix_sources(docs_of(spark, [(1, None, None), (2, "", "x"), (2, "", "x")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3
    assert mix_sources(docs_of(spark, ODD)).count() == len(ODD)
    assert mix_sources(docs_of(spark, ODD).withColumns({"size": F.lit(1), "target": F.lit("x"), "_key": F.lit(0)})).count() == len(ODD)


# Exact deduplication


def brute_dedup(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t, _ in rows:
        g = groups[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hello World", "hello world", "HELLO WORLDÉ", "hello worldé", "", None, f"own {i}"]), "s") for i in range(300)] + ODD
    df = docs_of(spark, rows).repartition(5).withColumns({"kept": F.lit(1), "digest": F.lit("x"), "_norm": F.lit("y")})
    # A digest of three values collides all the time; full content still decides.
    got = exact_dedup(df, digest=lambda c: F.pmod(F.crc32(c), F.lit(3))) if weak else exact_dedup(df)
    out = [(r.doc_id, r.keep_id, r.group_size, r.kept, None if weak else bytes(r.digest).hex()) for r in got.collect()]
    want = [(*x[:4], None) if weak else x for x in brute_dedup(rows)]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert exact_dedup(df.limit(0)).collect() == []


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition(monkeypatch):
    rng = random.Random(5)
    texts = [t for _, t, _ in ODD if t is None or len(t) < 1000] + [" ".join(rng.choice(["Ab", "c d", "É", "x"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)  # cut into small blocks
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hash_is_that_of_the_engine(spark):
    assert spark.sql("select xxhash64('one two three')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_golay_keys_cover_one_error():
    x = np.random.default_rng(6).integers(0, 1 << 23, 4000).astype(np.uint32)
    _, rows, keys = golay_keys(x)
    has = set(zip(rows.tolist(), keys.tolist(), strict=True))
    assert set(np.bincount(rows, minlength=len(x))) <= {1, 6}
    for flip in [0, *(1 << b for b in range(23))]:
        own = golay_keys(x ^ np.uint32(flip))[0]
        assert all((i, k) in has for i, k in enumerate(own.tolist()))


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    every = set(base.tolist()) | {0, 2**64 - 1}
    for x in base.tolist():
        for n in range(1, 6):
            y = x
            for b in rng.choice(64, n, replace=False).tolist():
                y ^= 1 << b
            every.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(every)]
    got = {tuple(r) for r in fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    a = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i, j in np.argwhere(near) if i < j}
    assert got == want and len(want) > 300


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(70)] + [(200, 200), (3, None)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    pairs = [(a, b) for a, b in pairs if b is not None and a != b]
    assert got == union(pairs, {x for p in pairs for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_groups(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(300)]
        for k in range(5):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(300)] = rng.choice(vocab)
            rows.append((n, " ".join(w), "s"))
            n += 1
    rows += [(i + 1000 if i else None, t, s) for i, t, s in ODD]
    got = simhash_groups(docs_of(spark, rows).repartition(5).withColumns({"fp": F.lit(1), "root": F.lit(2)})).collect()
    prints = [(i, plain_fingerprint(t) if t is None or len(t) < 9000 else fingerprint(t)) for i, t, _ in rows]
    fps = {f for _, f in prints}
    root = union([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in prints), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash_groups(docs_of(spark, [])).collect() == []


def test_crc_is_unsigned(spark):
    assert spark.sql("select crc32('hello')").first()[0] == zlib.crc32(b"hello")
