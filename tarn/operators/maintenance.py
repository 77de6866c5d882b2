"""Checkpoints, checksums and the metrics of tables."""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn import fixed
from tarn.sources import actions
from tarn.sources.log import TableError, last_checkpoint_hint
from tarn.table import Snapshot, file_key, parsed_partition, read_commits

#: Fixed value: how many file actions a sidecar takes, about.
SIDECAR_ROWS = 50_000
KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
#: The lower ends of the bins of file sizes.
HISTOGRAM = [
    0, *[8 * KB << i for i in range(10)], *range(8 * MB, 41 * MB, 4 * MB), *range(48 * MB, 121 * MB, 8 * MB), *range(124 * MB, 145 * MB, 4 * MB),
    *range(160 * MB, 577 * MB, 16 * MB), *range(640 * MB, 1409 * MB, 64 * MB), *range(1536 * MB, 2049 * MB, 128 * MB), *range(2304 * MB, 4097 * MB, 256 * MB),
    *[8 * GB << i for i in range(6)],
]


def reconciled(s: Snapshot, now_ms: int | None = None) -> DataFrame:
    """The actions that a checkpoint keeps: newest protocol and metadata, newest transaction of each application, newest
    state of each domain, newest action of each file; without removed domains, expired removes and expired transactions,
    which still hide what is older than they are."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    kinds = ("protocol", "metaData", "txn", "domainMetadata", "add", "remove")
    rows = s.commits(*kinds)
    old = s.checkpoint(*kinds)
    if old is not None:
        rows = rows.unionByName(old.withColumn("version", F.lit(s.log.checkpoint_version).cast("long")))
    files = F.coalesce(file_key("add"), file_key("remove"))
    key = F.struct(
        F.when(F.col("protocol").isNotNull(), "p").when(F.col("metaData").isNotNull(), "m").when(F.col("txn").isNotNull(), "t").when(F.col("domainMetadata").isNotNull(), "d").when(files.isNotNull(), "f").alias("kind"),
        F.coalesce(F.col("txn.appId"), F.col("domainMetadata.domain")).alias("name"),
        files.alias("file"),
    )
    newest = rows.withColumn("_key", key).where("_key.kind is not null").groupBy("_key")
    newest = newest.agg(F.max_by(F.struct(*kinds), F.struct("version", F.col("add").isNotNull())).alias("_w")).select("_w.*")
    keep = F.lit(now - s.metadata.interval_ms(fixed.P_TOMBSTONES, 7))
    newest = newest.where(F.col("remove").isNull() | (F.coalesce(F.col("remove.deletionTimestamp"), F.lit(0)) > keep))
    newest = newest.where(F.col("domainMetadata").isNull() | ~F.col("domainMetadata.removed"))
    limit = s.metadata.interval_ms(fixed.P_TXN_RETENTION, None)
    if limit is not None:
        newest = newest.where(F.col("txn").isNull() | F.col("txn.lastUpdated").isNull() | (F.col("txn.lastUpdated") > now - limit))
    return newest


def _shaped(s: Snapshot, rows: DataFrame) -> DataFrame:
    """Statistics as JSON, as a struct or both, as the table's properties ask; files in a checkpoint change no data."""
    as_json = s.metadata.configuration.get(fixed.P_STATS_JSON, "true") == "true"
    as_struct = s.metadata.configuration.get(fixed.P_STATS_STRUCT, "false") == "true"
    add = F.col("add").withField("dataChange", F.lit(False))
    if as_struct:
        add = add.withField("stats_parsed", F.from_json(F.col("add.stats"), s.stats_schema(), fixed.STATS_READ_FORMATS))
        parts = [parsed_partition(F.element_at(F.col("add.partitionValues"), F.lit(s.physical[(c,)][0])), s.schema[c].dataType).alias(s.physical[(c,)][0]) for c in s.metadata.partition_columns]
        if parts:
            add = add.withField("partitionValues_parsed", F.struct(*parts))
    if not as_json:
        add = add.dropFields("stats")
    return rows.withColumn("add", F.when(F.col("add").isNotNull(), add)).withColumn("remove", F.when(F.col("remove").isNotNull(), F.col("remove").withField("dataChange", F.lit(False))))


def write_checkpoint(s: Snapshot, sidecars: bool = False, sidecar_rows: int = SIDECAR_ROWS, now_ms: int | None = None) -> bool:
    """Write the snapshot's checkpoint and the hint; False if there is one at this version.

    Tables with the feature for it get the second form: with ``sidecars`` file actions go to as many sidecar files as
    their number asks for, written in parallel, and the checkpoint lists them.
    """
    name = f"{fixed.LOG_DIR}/{s.version:020d}.checkpoint.parquet"
    if s.log.checkpoint_version == s.version or s.files.exists(name):
        return False
    second = s.protocol.has("v2Checkpoint")
    if sidecars and not second:
        raise TableError("sidecars need the feature v2Checkpoint")
    rows = _shaped(s, reconciled(s, now_ms)).persist()
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count("add").alias("adds"), F.count(F.when(F.col("add").isNotNull() | F.col("remove").isNotNull(), 1)).alias("files")).first()
    temp = f"{s.root}/{fixed.LOG_DIR}/.checkpoint-{uuid.uuid4().hex}"
    try:
        top = rows
        listed: list[tuple] = []
        if sidecars:
            both = rows.where("add is not null or remove is not null").select("add", "remove")
            both.repartition(max(1, -(-count.files // sidecar_rows))).write.parquet(f"{temp}/side")
            for f in s.files.list(f"{temp}/side"):
                if f.name.endswith(".parquet"):
                    new = f"{uuid.uuid4()}.parquet"
                    s.files.fs.mkdirs(s.files._path(f"{fixed.LOG_DIR}/{fixed.SIDECAR_DIR}"))
                    s.files.rename(f.path, f"{fixed.LOG_DIR}/{fixed.SIDECAR_DIR}/{new}")
                    listed.append((new, f.size, f.modified, None))
            top = rows.where("add is null and remove is null")
        if second:
            more = actions.schema("checkpointMetadata", "sidecar")
            extra = s.spark.createDataFrame([((s.version, None), None), *[(None, x) for x in listed]], more)
            top = top.unionByName(extra, allowMissingColumns=True)
        top.coalesce(1).write.parquet(f"{temp}/top")
        part = next(f for f in s.files.list(f"{temp}/top") if f.name.endswith(".parquet"))
        if s.files.exists(name):
            return False
        s.files.rename(part.path, name)
    finally:
        rows.unpersist()
        s.files.delete(temp)
    hint = last_checkpoint_hint(s.files)
    if hint is None or hint["version"] <= s.version:
        fields = {"version": s.version, "size": count.n + len(listed) + second, "sizeInBytes": s.files.size(name), "numOfAddFiles": count.adds}
        s.files.write(f"{fixed.LOG_DIR}/{fixed.LAST_CHECKPOINT}", json.dumps(fields).encode())
    return True


def checkpoint_shape(s: Snapshot) -> dict:
    """What a checkpoint is: a list of sidecars or the files themselves, and whether it has parsed statistics."""
    if not s.log.checkpoint:
        return {"kind": None}
    columns = s._checkpoint_schema.names
    parsed = False
    if s.log.checkpoint[0].meta.name.endswith("parquet"):
        add = s.spark.read.parquet(s.log.checkpoint[0].meta.path).schema
        parsed = "add" in add.names and "stats_parsed" in add["add"].dataType.names
    manifest = "sidecar" in columns and s.checkpoint("sidecar").where("sidecar is not null").limit(1).count() > 0
    return {"kind": "manifest" if manifest else "leaf", "parsed_stats": parsed}


def histogram(sizes: DataFrame, column: str = "size") -> dict:
    """Files and bytes in each bin of file sizes, by one grouped aggregation with a bin number made by arithmetic."""
    at = F.lit(0)
    for low in HISTOGRAM[1:]:
        at = at + (F.col(column) >= low).cast("int")
    rows = sizes.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("b")).collect()
    counts, total = [0] * len(HISTOGRAM), [0] * len(HISTOGRAM)
    for r in rows:
        counts[r.bin], total[r.bin] = r.n, r.b
    return {"sortedBinBoundaries": HISTOGRAM, "fileCounts": counts, "totalBytes": total}


def bin_of(size: int) -> int:
    return bisect_right(HISTOGRAM, size) - 1


def checksum_fields(s: Snapshot) -> dict:
    """The checksum of a version, from its live files and newest actions."""
    live = s.live_files().select("size").persist()
    try:
        total = live.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        sizes = histogram(live)
    finally:
        live.unpersist()
    rest = reconciled(s, 0).where("txn is not null or domainMetadata is not null").select("txn", "domainMetadata").collect()
    out = {
        "tableSizeBytes": total.b, "numFiles": total.n, "numMetadata": 1, "numProtocol": 1, "metadata": s.metadata.fields(), "protocol": s.protocol.fields(),
        "setTransactions": [r.txn.asDict() for r in rest if r.txn], "domainMetadata": [r.domainMetadata.asDict() for r in rest if r.domainMetadata], "fileSizeHistogram": sizes,
    }
    if s.metadata.flag(fixed.P_ICT):
        out["inCommitTimestampOpt"] = s.timestamp()
    return out


def write_checksum(s: Snapshot) -> bool:
    """Write the version's checksum; False if there is one."""
    return s.files.put_if_absent(f"{fixed.LOG_DIR}/{s.version:020d}.crc", json.dumps(checksum_fields(s)).encode())


def advance_checksum(s: Snapshot) -> dict | None:
    """The checksum of a version from the last one before it and the commits since: no file list is read.

    None where that can't be told, as when a remove doesn't say how large its file was.
    """
    known = s.checksum()
    if known is None or known.get("numFiles") is None or known.get("fileSizeHistogram") is None:
        return None
    if s.log.crc.version == s.version:
        return known
    since = [c for c in s.log.commits if c.version > s.log.crc.version]
    if [c.version for c in since] != list(range(s.log.crc.version + 1, s.version + 1)):
        return None
    rows = read_commits(s.spark, since, "add", "remove").where("add is not null or remove is not null")
    if rows.where("remove is not null and remove.size is null").limit(1).count():
        return None
    sizes = rows.select(F.coalesce("add.size", "remove.size").alias("size"), F.when(F.col("add").isNotNull(), 1).otherwise(-1).alias("sign"))
    counts, total = list(known["fileSizeHistogram"]["fileCounts"]), list(known["fileSizeHistogram"]["totalBytes"])
    at = F.lit(0)
    for low in HISTOGRAM[1:]:
        at = at + (F.col("size") >= low).cast("int")
    files, size = known["numFiles"], known["tableSizeBytes"]
    for r in sizes.groupBy(at.alias("bin")).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("size")).alias("b")).collect():
        counts[r.bin] += r.n
        total[r.bin] += r.b
        files, size = files + r.n, size + r.b
    return {**known, "numFiles": files, "tableSizeBytes": size, "metadata": s.metadata.fields(), "protocol": s.protocol.fields(), "fileSizeHistogram": {"sortedBinBoundaries": HISTOGRAM, "fileCounts": counts, "totalBytes": total}}


# Metrics


@dataclass(frozen=True)
class Event:
    """Something that an operation reports: its name, how long it took and what it counted."""

    name: str
    seconds: float
    counts: dict


def measured(name: str, report: Callable[[Event], None], body: Callable, **counts):
    """Run ``body`` and report an event for it, also if it fails."""
    began = time.perf_counter()
    try:
        return body()
    finally:
        report(Event(name, time.perf_counter() - began, counts))


def to_dict(event: Event) -> dict:
    return asdict(event)


