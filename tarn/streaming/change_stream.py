"""A stream of changes: new commits of a table drive Structured Streaming, and each batch gets their change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn import fixed
from tarn.operators.changes import ChangeFeed
from tarn.sources import actions
from tarn.table import Table


def stream_changes(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, since: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Call ``handle(changes, batch)`` with the change feed of every range of new versions from ``since`` on.

    The commit files are the source, so the stream's own checkpoint remembers which versions have been handled, and a
    batch that is tried again gets the same versions.
    """
    table = Table(spark, root)
    log = f"{table.root}/{fixed.LOG_DIR}"
    commits = spark.readStream.schema(actions.schema("commitInfo")).option("pathGlobFilter", "[0-9]" * 20 + ".json").json(log)
    versions = commits.select(F.substring("_metadata.file_name", 1, 20).cast("long").alias("version"))

    def batch(rows: DataFrame, number: int) -> None:
        low, high = rows.where(F.col("version") >= since).agg(F.min("version"), F.max("version")).first()
        if low is not None:
            handle(ChangeFeed(table, low, high).scan(), number)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
