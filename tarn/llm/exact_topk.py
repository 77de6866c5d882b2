"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm._shared import durable

QUERY_BLOCK, SHARD_ROWS, FAN_IN = 1024, 4096, 8


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x) of every component, taken as double.

    Rows with a NULL id, a NULL vector or a component that is NULL, NaN or infinite take no part.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as a matrix; shorter ones are filled with zeros."""
    lists = [np.asarray(x, dtype=np.float64) for x in column.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _packed(block_rows: int):
    """Rows (id, v) of a task as blocks: (ids, values, width), both little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                b = whole.slice(at, block_rows)
                m = _matrix(b.column(1))
                exact = m.astype("<f8")
                small = m.size == 0 or np.abs(m).max() < 2**15
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]), pa.array([(m.astype("<i2") if small else exact).tobytes()]), pa.array([m.shape[1]], pa.int32())],
                    names=["ids", "vals", "width"],
                )

    return run


BLOCK_SCHEMA = "ids binary, vals binary, width int"


def _unpacked(ids: bytes, vals: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    kind = "<i2" if len(vals) == 2 * len(i) * width else "<f8"
    return i, np.frombuffer(vals, kind).reshape(len(i), width)


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by the fastest arithmetic that holds them; beyond 64 bits they stop at its ends."""
    width = min(q.shape[1], s.shape[1])
    q, s = q[:, :width], s[:, :width]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(s).max(initial=0)) * max(width, 1)
    if most < 2**24:
        return (q.astype(np.float32) @ s.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    got = np.dot(whole(q), whole(s).T)
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def exact_topk(
    vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """For each vector whose id is divisible by ``query_every``, the ``k`` highest integer inner products with all others.

    Queries and vectors are packed into blocks of bounded size.  Every query block meets every shard block once, as a
    tile: one matrix product in which each query selects its k best.  The lists of a query block are then merged in a
    tree, ``FAN_IN`` lists at a time, so no task holds more than a few lists however many shards there are.  What moves
    is packed blocks, and the two sides grow with the grid of tiles, as any exact search must.

    Returns query_id, rank (int, from 1), vec_id, score (long).
    Vectors of unequal length are compared over the shorter length, as if filled with zeros; empty vectors score 0.  A
    query is a row, so repeated query rows get a list each; rows that share the query's id are no candidates of it,
    all other repeated rows are candidates each.  Scores beyond 64 bits stop at the ends of that range.  A table
    without queries or without candidates gives no rows.
    """
    rows = quantised(vectors, id_col, vector_col)
    spark = rows.sparkSession
    # Blocks are dealt by hash; of queries and vectors the driver sees only the counts.
    n_asked, n_rows = rows.agg(F.count_if(F.col("id") % query_every == 0), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-n_asked // query_block))
    dealt = rows.where(F.col("id") % query_every == 0).repartition(n_blocks, F.xxhash64("id", "v"))
    dealt = dealt.mapInArrow(_packed(query_block), BLOCK_SCHEMA)
    dealt = durable(dealt.select(F.xxhash64("ids", "vals").alias("block"), *[F.col(c).alias("q_" + c) for c in ("ids", "vals", "width")]), "topk")
    # Query blocks are copied once for each group of shards, so there are no more groups than blocks of vectors.
    n_groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // shard_rows)))
    shards = rows.mapInArrow(_packed(shard_rows), BLOCK_SCHEMA).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int"))
    asked = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    # Both sides are shuffled: the planner takes the copies for as small as the blocks and would broadcast them by the driver.
    tiles = asked.join(shards.hint("merge"), "group")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                block, q_ids, q_vals, q_width, ids, vals, width, group = (b.column(c)[x].as_py() for c in range(8))
                qi, q = _unpacked(q_ids, q_vals, q_width)
                si, s = _unpacked(ids, vals, width)
                if not len(qi) or not len(si):
                    continue
                got, who, place, score = _products(q, s), [], [], []
                for r in range(len(qi)):
                    ok = np.flatnonzero(si != qi[r])
                    at = ok[_best(got[r][ok], si[ok], k)]
                    who += [np.full(len(at), r)]
                    place.append(si[at])
                    score.append(got[r][at])
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), block)), pa.array(who.astype(np.int32)), pa.array(qi[who]), pa.array(np.concatenate(place)), pa.array(np.concatenate(score)), pa.array(np.full(len(who), group, np.int32))],
                    names=["block", "nth", "query_id", "vec_id", "score", "group"],
                )

    schema = "block long, nth int, query_id long, vec_id long, score long, group int"
    lists = tiles.select("block", "q_ids", "q_vals", "q_width", "ids", "vals", "width", "group").mapInArrow(scored, schema)
    best = W.partitionBy("block", "nth", "query_id", "group").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    while True:  # a level of the tree: the lists of FAN_IN groups become one
        n_groups = -(-n_groups // FAN_IN)
        lists = lists.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int") if n_groups > 1 else F.lit(0))
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if n_groups == 1:
            return lists.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
