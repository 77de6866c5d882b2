"""Contiguous, byte-balanced sharding by global prefix sums [native]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import running_total


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a NULL text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(rows: DataFrame, n_shards: int, size: str, order: Sequence[str]) -> DataFrame:
    """Cut ``rows``, in ``order``, into ``n_shards`` contiguous shards whose sums of ``size`` are near equal.

    A row belongs to the shard in which the middle of its byte range falls, so each cut is off its target by half a
    row at most.  Only the columns given are moved: pass slim rows (keys and sizes), not texts, where texts need not
    be written in shard order.

    Adds ``shard`` (int, from 0) and ``slot`` (long, the row's place in its shard, gapless from 0).
    NULL order keys come first; a NULL size counts as 0 and if all sizes are 0 every row goes to shard 0.  Rows equal
    in every order column are interchangeable.  A row larger than a target can leave neighbouring shards empty.  An
    empty table gives an empty table.  Columns of other names are kept; ``row_before``, ``n_rows``, ``shard``,
    ``slot``, ``<size>_before``, ``<size>_total`` and names that begin with ``_`` are replaced where the input has them.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    clash = {"row_before", "n_rows", "shard", "slot", f"{size}_before", f"{size}_total"} - {size, *order}
    rows = rows.drop(*[c for c in rows.columns if c in clash or c.startswith("_") and c not in {size, *order}])
    summed = running_total(rows, [F.col(c).asc_nulls_first() for c in order], [size], "shard")
    amount = F.coalesce(F.col(size).cast("long"), F.lit(0))
    twice = (F.lit(2) * F.col(f"{size}_before") + amount).cast("decimal(38,0)")
    at = F.floor(twice * n_shards / F.greatest(F.lit(2) * F.col(f"{size}_total"), F.lit(1)))
    placed = summed.withColumn("shard", F.least(at, F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row_before").alias("_first"))
    return (
        placed.join(F.broadcast(first), "shard")  # one row for each shard
        .withColumn("slot", F.col("row_before") - F.col("_first"))
        .drop(f"{size}_before", f"{size}_total", "row_before", "n_rows", "_first")
    )
