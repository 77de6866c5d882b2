"""Exact deduplication by skew-safe combining over full content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import durable

#: The only letters that normalisation changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    """The SHA-256 digest as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, n_salts: int = 16
) -> DataFrame:
    """Group documents whose normalised texts are identical; the largest id of each group stays.

    Three combining stages, each of which compares full content because the text itself is a grouping key:
    each task combines its own rows (partial aggregation), then salted digest groups are merged, so that a text that a
    third of all rows share meets in ``n_salts`` tasks after local combining, then the salt winners are combined.  The
    winners are slim rows; documents find theirs by digest alone where the last stage saw one text for that digest,
    which is a proof and not a guess, and by digest and full text for the digests (none, with SHA-256) that collide.

    Returns one row per document: id, keep_id, group_size (long), kept (boolean), digest.
    NULL texts count as empty, and empty texts form a group.  Rows that repeat both id and text are one document seen
    again: they get the same verdict.  A NULL id never stays unless its whole group has NULL ids, where none stays.
    Empty tables give an empty table; other columns are ignored.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    rows = rows.select("_id", "_norm", digest(F.col("_norm")).alias("_digest"))
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % n_salts)
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    classes = salted.groupBy("_digest", "_norm").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    won = durable(classes.drop("_norm"), "dedup")
    clashing = durable(won.groupBy("_digest").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_digest"), "dedup")
    slim = rows.select("_id", "_digest")
    if clashing.isEmpty():
        joined = slim.join(won, "_digest", "left")
    else:
        some = rows.join(clashing, "_digest", "left_semi")
        apart = some.groupBy("_digest", "_norm").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        joined = (
            slim.join(clashing, "_digest", "left_anti")
            .join(won, "_digest", "left")
            .unionByName(some.join(apart, ["_digest", "_norm"]).drop("_norm"))
        )
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long"),
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("_digest").alias("digest"),
    )
