"""Tables: snapshots, file lists and scans.

The log is data: its commits and checkpoint are read as DataFrames and reconciled by a grouped aggregation and an
anti-join.  What reaches the driver is the listing, one protocol and metadata row, and, when a scan is planned, the list of files that survive
pruning.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import fixed
from tarn.functions import deletion_vectors as dv
from tarn.functions.expressions import OpaquePredicate, Predicate, Stats, always_false, parsed_partition, quoted, skipping_filter
from tarn.functions.parser import parse_predicate
from tarn.sources import actions
from tarn.sources.files import Files, absolute, spark_uri
from tarn.sources.log import LogFile, LogSegment, TableError, list_log, segment

#: Side tables above this many rows are joined by shuffle; below, they are broadcast.
BROADCAST_ROWS = 200_000
#: Commits of so many bytes in all are read as one partition.
SMALL_LOG = 32 << 20
#: So many commits of so many bytes in all are searched for protocol and metadata without a job.
FEW_COMMITS, FEW_BYTES = 16, 8 << 20
NO_STATS = (T.BooleanType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)


def leaves(schema: T.StructType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.StructField]]:
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, (*at, f.name))
        else:
            out.append(((*at, f.name), f))
    return out


def parse_schema(text: str) -> T.StructType:
    """A stored schema; geometry and geography columns, which Spark stores as binary here, keep their name in metadata."""

    def loose(x):
        if isinstance(x, str) and re.match(r"(geometry|geography)\b", x):
            return "binary"
        if isinstance(x, dict):
            return {k: loose(v) if k in ("type", "elementType", "keyType", "valueType", "fields") else v for k, v in x.items()}
        return [loose(v) for v in x] if isinstance(x, list) else x

    return T.StructType.fromJson(loose(json.loads(text)))


@dataclass(frozen=True)
class Protocol:
    reader: int
    writer: int
    reader_features: tuple[str, ...] = ()
    writer_features: tuple[str, ...] = ()

    def check(self, operation: str) -> None:
        """Raise unless this engine may scan, read changes of or write such a table; unknown features fail."""
        if not 1 <= self.reader <= 3:
            raise TableError(f"reader version {self.reader} isn't supported")
        for f in self.reader_features if self.reader == 3 else ():
            if operation not in fixed.READER_FEATURES.get(f, ()):
                raise TableError(f"reader feature {f} isn't supported for {operation}")
        if operation == "write":
            if not 1 <= self.writer <= 7:
                raise TableError(f"writer version {self.writer} isn't supported")
            for f in self.writer_features if self.writer == 7 else ():
                if not fixed.WRITER_FEATURES.get(f, "write" in fixed.READER_FEATURES.get(f, ())):
                    raise TableError(f"writer feature {f} isn't supported")

    def has(self, feature: str) -> bool:
        return feature in self.reader_features or feature in self.writer_features

    def fields(self) -> dict:
        out = {"minReaderVersion": self.reader, "minWriterVersion": self.writer}
        if self.reader == 3:
            out["readerFeatures"] = sorted(self.reader_features)
        if self.writer == 7:
            out["writerFeatures"] = sorted(self.writer_features)
        return out


@dataclass(frozen=True)
class Metadata:
    id: str
    schema_string: str
    partition_columns: tuple[str, ...]
    configuration: dict[str, str]
    name: str | None = None
    description: str | None = None
    created: int | None = None

    @cached_property
    def schema(self) -> T.StructType:
        return parse_schema(self.schema_string)

    def flag(self, key: str) -> bool:
        return self.configuration.get(key, "false").lower() == "true"

    def interval_ms(self, key: str, default_days: int | None) -> int | None:
        """A retention such as 'interval 7 days' in milliseconds."""
        text = self.configuration.get(key)
        if text is None:
            return None if default_days is None else default_days * 86_400_000
        units = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
        got = re.findall(r"(-?\d+)\s*(week|day|hour|minute|second|millisecond)s?", text.lower())
        if not got:
            raise TableError(f"{key} isn't an interval: {text}")
        return sum(int(n) * units[u] for n, u in got)

    def fields(self) -> dict:
        return {
            "id": self.id, "name": self.name, "description": self.description, "format": {"provider": "parquet", "options": {}}, "schemaString": self.schema_string,
            "partitionColumns": list(self.partition_columns), "createdTime": self.created, "configuration": self.configuration,
        }


class FileStats(Stats):
    """Statistics columns of a file list: ``_stats`` parsed from the log, partition values as exact values."""

    def __init__(self, snapshot: Snapshot):
        self.s = snapshot

    def _find(self, path) -> tuple[tuple[str, ...], T.StructField] | None:
        return self.s.resolve(path)

    def exact(self, path) -> Column | None:
        found = self._find(path)
        if len(path) == 1 and found[1].name in self.s.metadata.partition_columns:
            return parsed_partition(F.element_at(F.col("partitionValues"), F.lit(found[0][0])), found[1].dataType)
        return None

    def _of(self, part: str, path) -> Column | None:
        found = self._find(path)
        if found[0] not in self.s.indexed or part != "nullCount" and isinstance(found[1].dataType, NO_STATS):
            return None
        return F.col(quoted(["_stats", part, *found[0]]))

    def minimum(self, path):
        return self._of("minValues", path)

    def maximum(self, path):
        return self._of("maxValues", path)

    def nulls(self, path):
        found = self._find(path)
        return F.col(quoted(["_stats", "nullCount", *found[0]])) if found[0] in self.s.indexed else None

    def rows(self):
        return F.col("_stats.numRecords")

    def kind(self, path):
        return self._find(path)[1].dataType


def logical_to_physical(schema: T.StructType, mode: str) -> dict[tuple[str, ...], tuple[str, ...]]:
    def name(f: T.StructField) -> str:
        return f.metadata.get(fixed.MAPPING_NAME, f.name) if mode != "none" else f.name

    out: dict = {}

    def go(s: T.StructType, logical: tuple, physical: tuple) -> None:
        for f in s.fields:
            at, to = (*logical, f.name), (*physical, name(f))
            out[at] = to
            if isinstance(f.dataType, T.StructType):
                go(f.dataType, at, to)

    go(schema, (), ())
    return out


def physical_type(kind: T.DataType, mode: str) -> T.DataType:
    """A type as files hold it: physical names, and field ids in id mode."""
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            meta = {"parquet.field.id": f.metadata[fixed.MAPPING_ID]} if mode == "id" and fixed.MAPPING_ID in f.metadata else {}
            fields.append(T.StructField(f.metadata.get(fixed.MAPPING_NAME, f.name) if mode != "none" else f.name, physical_type(f.dataType, mode), True, meta))
        return T.StructType(fields)
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(physical_type(kind.elementType, mode), True)
    if isinstance(kind, T.MapType):
        return T.MapType(physical_type(kind.keyType, mode), physical_type(kind.valueType, mode), True)
    return kind


def to_logical(c: Column, kind: T.DataType, mode: str) -> Column:
    """Rename the fields inside a column from physical to logical."""
    if mode == "none" or not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return c
    if isinstance(kind, T.StructType):
        parts = [to_logical(c[f.metadata.get(fixed.MAPPING_NAME, f.name)], f.dataType, mode).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: to_logical(x, kind.elementType, mode))
    return F.transform_values(c, lambda _, x: to_logical(x, kind.valueType, mode))


def conformed(c: Column, have: T.StructType, want: T.StructType) -> Column:
    """A struct with the fields of ``want`` from one with those of ``have``: missing fields are NULL, others are cast."""
    fields = []
    for f in want.fields:
        if f.name not in have.names:
            fields.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            fields.append(conformed(c[f.name], have[f.name].dataType, f.dataType).alias(f.name))
        else:
            fields.append((c[f.name] if have[f.name].dataType == f.dataType else c[f.name].cast(f.dataType)).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields))


#: A file's identity: its path and its deletion vector.
def file_key(action: str) -> Column:
    d = F.col(f"{action}.deletionVector")
    vector = F.when(d.isNotNull(), F.struct(d["storageType"].alias("storageType"), d["pathOrInlineDv"].alias("pathOrInlineDv"), d["offset"].alias("offset")))
    return F.when(F.col(f"{action}.path").isNotNull(), F.struct(F.col(f"{action}.path").alias("path"), vector.alias("dv")))


def _parsed(predicate: Predicate | str | None) -> Predicate | None:
    return parse_predicate(predicate) if isinstance(predicate, str) else predicate


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs that are started inside belong to ``group``; the function that this yields cancels them from any thread."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(group)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


class Snapshot:
    """A table at one version."""

    def __init__(self, spark: SparkSession, root: str, log: LogSegment | None = None, files: Files | None = None):
        self.spark, self.files = spark, files or Files(spark, root)
        self.root = self.files.root
        self.log = log if log is not None else segment(self.files)
        self.version = self.log.version

    # The log as data

    def commits(self, *kinds: str) -> DataFrame:
        """Actions of the commits after the checkpoint, with ``version``."""
        return read_commits(self.spark, self.log.cover(), *kinds)

    def _top_schema(self, path: str) -> T.StructType:
        return self.spark.read.parquet(path).schema if path.endswith("parquet") else actions.schema()

    @cached_property
    def _checkpoint_schema(self) -> T.StructType:
        return self._top_schema(self.log.checkpoint[0].meta.path)

    def checkpoint(self, *kinds: str, parsed: bool = False) -> DataFrame | None:
        """Actions of the checkpoint, its sidecars included; None without a checkpoint.

        Statistics that a checkpoint holds only as a struct come as JSON too.  With ``parsed`` adds keep that struct, as
        ``stats_parsed`` of the table's ``stats_schema``, NULL where the checkpoint has only JSON.
        """
        if not self.log.checkpoint:
            return None
        kinds = kinds or tuple(actions.KINDS)
        want = actions.schema(*kinds)
        if parsed:
            struct = T.StructField("stats_parsed", self.stats_schema())
            want = T.StructType([T.StructField("add", T.StructType([*f.dataType.fields, struct])) if f.name == "add" else f for f in want.fields])
        paths = [f.meta.path for f in self.log.checkpoint]

        def load(files: list[str], there: T.StructType) -> DataFrame:
            here = [k for k in kinds if k in there.names]
            if not here:
                return self.spark.createDataFrame([], want)
            held = there["add"].dataType["stats_parsed"] if "add" in here and "stats_parsed" in there["add"].dataType.names else None
            schema = actions.schema(*here)
            if held is not None:
                schema = T.StructType([T.StructField("add", T.StructType([*f.dataType.fields, held])) if f.name == "add" else f for f in schema.fields])
            read = self.spark.read.schema(schema)
            df = read.json(files) if files[0].endswith(".json") else read.parquet(*files)
            if held is not None:
                add = F.col("add").withField("stats", F.coalesce("add.stats", F.to_json("add.stats_parsed", fixed.STATS_FORMATS)))
                add = add.withField("stats_parsed", conformed(F.col("add.stats_parsed"), held.dataType, struct.dataType)) if parsed else add.dropFields("stats_parsed")
                df = df.withColumn("add", F.when(F.col("add").isNotNull(), add))
            elif parsed and "add" in here:
                df = df.withColumn("add", F.when(F.col("add").isNotNull(), F.col("add").withField("stats_parsed", F.lit(None).cast(struct.dataType))))
            return df.select(*[F.col(k) if k in here else F.lit(None).cast(want[k].dataType).alias(k) for k in kinds])

        df = load(paths, self._checkpoint_schema)
        if "sidecar" in self._checkpoint_schema.names and {"add", "remove"} & set(kinds):
            listed = load_sidecars(self.spark, paths)
            if listed:
                names = [s if "/" in s else f"{self.root}/{fixed.LOG_DIR}/{fixed.SIDECAR_DIR}/{s}" for s in listed]
                df = df.unionByName(load(names, self._top_schema(names[0])))
        return df

    @cached_property
    def _protocol_metadata(self) -> tuple[Protocol, Metadata]:
        known = self.checksum()
        if known and self.log.crc.version == self.version:
            p, m = known.get("protocol"), known.get("metadata")
            if p and m:
                return _protocol(p), _metadata(m)
        if not self.log.checkpoint and len(self.log.commits) <= FEW_COMMITS and sum(f.meta.size for f in self.log.commits) <= FEW_BYTES:
            found = self._protocol_metadata_here()
            if found:
                return found
        at = F.lit(self.log.checkpoint_version if self.log.checkpoint else -1).cast("long")
        rows = self.commits("protocol", "metaData")
        old = self.checkpoint("protocol", "metaData")
        if old is not None:
            rows = rows.unionByName(old.withColumn("version", at))
        got = rows.agg(
            F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("p"),
            F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("m"),
        ).first()
        if got.p is None or got.m is None:
            raise TableError("the log has no protocol or no metadata")
        return _protocol(got.p.asDict(True)), _metadata(got.m.asDict(True))

    def _protocol_metadata_here(self) -> tuple[Protocol, Metadata] | None:
        """Both from a few small commits, read without a job, the newest first; None unless both are found."""
        found: dict = {}
        for f in sorted(self.log.commits, key=lambda f: -f.version):
            for text in reversed(self.files.read(f.meta.path).decode().splitlines()):
                if '"protocol"' in text or '"metaData"' in text:
                    action = json.loads(text)
                    for kind in {"protocol", "metaData"} & action.keys() - found.keys():
                        found[kind] = action[kind]
            if len(found) == 2:
                return _protocol(found["protocol"]), _metadata(found["metaData"])
        return None

    @property
    def protocol(self) -> Protocol:
        return self._protocol_metadata[0]

    @property
    def metadata(self) -> Metadata:
        return self._protocol_metadata[1]

    @property
    def schema(self) -> T.StructType:
        return self.metadata.schema

    @cached_property
    def mapping_mode(self) -> str:
        active = self.protocol.reader == 2 or self.protocol.reader == 3 and "columnMapping" in self.protocol.reader_features
        return self.metadata.configuration.get(fixed.P_MAPPING, "none") if active else "none"

    @cached_property
    def physical(self) -> dict[tuple[str, ...], tuple[str, ...]]:
        return logical_to_physical(self.schema, self.mapping_mode)

    def resolve(self, path) -> tuple[tuple[str, ...], T.StructField]:
        """Physical path and field of a logical path, whatever its case; an error if there is none."""
        kind, out = self.schema, []
        for part in path:
            found = [f for f in kind.fields if f.name.lower() == part.lower()] if isinstance(kind, T.StructType) else []
            if not found:
                raise TableError(f"no column {'.'.join(path)}")
            out.append(found[0].name)
            kind = found[0].dataType
        return self.physical[tuple(out)], found[0]

    @cached_property
    def indexed(self) -> set[tuple[str, ...]]:
        """Physical leaves that have statistics."""
        named = self.metadata.configuration.get(fixed.P_STATS_COLUMNS)
        every = [(p, f) for p, f in leaves(self.schema) if not (len(p) == 1 and p[0] in self.metadata.partition_columns)]
        if named is not None:
            chosen = [tuple(x.strip().strip("`").lower().split(".")) for x in named.split(",")]
            every = [(p, f) for p, f in every if any(tuple(x.lower() for x in p)[: len(c)] == c for c in chosen)]
        else:
            n = int(self.metadata.configuration.get(fixed.P_INDEXED, fixed.DEFAULT_INDEXED_COLUMNS))
            every = every if n < 0 else every[:n]
        return {self.physical[p] for p, _ in every}

    def stats_schema(self, only: set[tuple[str, ...]] | None = None) -> T.StructType:
        """The schema of statistics for the leaves ``only`` (physical), or for all that are indexed."""

        def of(kind: T.StructType, at: tuple, counts: bool) -> T.StructType:
            out = []
            for f in kind.fields:
                here = (*at, f.name)
                if isinstance(f.dataType, T.StructType):
                    inner = of(f.dataType, here, counts)
                    if inner.fields:
                        out.append(T.StructField(f.name, inner))
                elif here in self.indexed and (only is None or here in only):
                    if counts:
                        out.append(T.StructField(f.name, T.LongType()))
                    elif not isinstance(f.dataType, NO_STATS):
                        out.append(T.StructField(f.name, f.dataType))
            return T.StructType(out)

        physical = physical_type(self.schema, self.mapping_mode)
        counts, limits = of(physical, (), True), of(physical, (), False)
        parts = [T.StructField("numRecords", T.LongType())]
        if counts.fields:
            parts.append(T.StructField("nullCount", counts))
        if limits.fields:
            parts += [T.StructField("minValues", limits), T.StructField("maxValues", limits)]
        return T.StructType([*parts, T.StructField("tightBounds", T.BooleanType())])

    # File lists

    def live_files(self, keep: Callable | None = None) -> DataFrame:
        """The table's files, one row each, with the fields of ``add``.

        The newest action of each file key in the commits wins; the checkpoint's files follow unless a commit speaks of
        them.  ``keep``, a filter over adds, is applied before anything is shuffled; removes always stay.
        """
        old = self.checkpoint("add", parsed=keep is not None)
        old = None if old is None else old.where("add is not null").select("add.*")
        commits = self.log.cover()
        if not commits and old is not None:  # nothing after the checkpoint to hold against it
            return keep(old) if keep else old
        rows = self.commits("add", "remove")
        if sum(f.meta.size for f in commits) <= SMALL_LOG:
            rows = rows.coalesce(1)  # a short log is grouped where it is read, without a shuffle
        return self._reconciled(rows, old, keep)

    @staticmethod
    def _reconciled(rows: DataFrame, old: DataFrame | None, keep: Callable | None) -> DataFrame:
        rows = rows.where("add is not null or remove is not null").withColumn("_key", F.coalesce(file_key("add"), file_key("remove")))
        new = rows.groupBy("_key").agg(F.max_by("add", F.struct("version", F.col("add").isNotNull())).alias("add"))
        live = new.where("add is not null").select("add.*")
        live = keep(live) if keep else live
        if old is None:
            return live
        old = keep(old) if keep else old
        spoken = new.select("_key")
        old = old.withColumn("add", F.struct(*[F.col(c) for c in old.columns])).withColumn("_key", file_key("add"))
        old = old.join(spoken, old["_key"].eqNullSafe(spoken["_key"]), "left_anti").drop("_key", "add")
        return live.unionByName(old)

    def _pruning(self, predicate: Predicate | None) -> Callable | None:
        if predicate is None:
            return None
        for path in predicate.references():
            self.resolve(path)
        own = any(isinstance(x, OpaquePredicate) for x in predicate.walk())  # may look at any column's statistics
        schema = self.stats_schema(None if own else {self.resolve(p)[0] for p in predicate.references()})
        rule = None

        def keep(adds: DataFrame) -> DataFrame:
            nonlocal rule
            rule = skipping_filter(predicate, FileStats(self)) if rule is None else rule
            stats = F.from_json("stats", schema, fixed.STATS_READ_FORMATS)
            if "stats_parsed" in adds.columns:  # the struct of a checkpoint needs no parsing
                stats = F.when(F.col("stats_parsed").isNotNull(), conformed(F.col("stats_parsed"), self.stats_schema(), schema)).otherwise(stats)
            return adds.withColumn("_stats", stats).where(~rule.eqNullSafe(F.lit(False))).drop("_stats", "stats_parsed")

        return keep

    def list_files(self, predicate: Predicate | str | None = None, stats: str | None = "json", partition_struct: bool = False) -> DataFrame:
        """The files that may hold rows for the predicate: every such file and possibly more.

        ``stats``: "json", "struct" (``stats_parsed``), a list of columns, or None.  ``partition_struct`` adds typed ``partitionValues_parsed``.
        """
        self.protocol.check("scan")
        predicate = _parsed(predicate)
        if predicate is not None and always_false(predicate):
            return self.spark.createDataFrame([], T.StructType(actions.schema("add")["add"].dataType.fields))
        df = self.live_files(self._pruning(predicate))
        if partition_struct:
            parts = [(self.resolve((c,))[0][0], c, self.schema[c].dataType) for c in self.metadata.partition_columns]
            df = df.withColumn("partitionValues_parsed", F.struct(*[parsed_partition(F.element_at("partitionValues", F.lit(p)), k).alias(c) for p, c, k in parts]) if parts else F.lit(None))
        if isinstance(stats, (list, tuple)) or stats == "struct":
            only = {self.resolve(tuple(c.split(".")))[0] for c in stats} if not isinstance(stats, str) else None
            df = df.withColumn("stats_parsed", F.from_json("stats", self.stats_schema(only), fixed.STATS_READ_FORMATS))
        return df if stats == "json" else df.drop("stats")

    def list_files_from(self, known: DataFrame, base: int, predicate: Predicate | str | None = None) -> DataFrame:
        """The file list from that of an earlier version: only the commits after ``base`` are read.

        ``known`` must have been listed for a predicate that isn't stricter than this one, which isn't checked.  Where
        the log no longer has those commits the whole list is made.
        """
        after = [c for c in self.log.commits if c.version > base]
        if base > self.version or [c.version for c in after] != list(range(base + 1, self.version + 1)):
            return self.list_files(predicate)
        columns = actions.schema("add")["add"].dataType.names
        return self._reconciled(read_commits(self.spark, after, "add", "remove"), known.select(*columns), self._pruning(_parsed(predicate)))

    # Rows

    def scan(self, columns: list[str] | None = None, predicate: Predicate | str | None = None, row_id: str | None = None, row_index: str | None = None, file_path: str | None = None) -> DataFrame:
        """The table's rows: the columns asked for, and only rows for which the predicate is TRUE.

        Files are pruned by partition values and statistics before any is opened; the predicate is then applied to
        rows, where Spark pushes it into the Parquet reader.  ``row_id``, ``row_index`` and ``file_path`` name metadata columns to add.
        """
        predicate = _parsed(predicate)
        files = self.list_files(predicate, stats=None).select("path", "partitionValues", "deletionVector", "baseRowId").collect()
        return read_files(self, files, columns, predicate, row_id, row_index, file_path)

    # Points

    def app_version(self, app_id: str) -> int | None:
        """The last transaction version that an application committed; None if there is none or it has expired."""
        found = self._newest("txn", F.col("txn.appId") == app_id)
        if found is None:
            return None
        keep = self.metadata.interval_ms(fixed.P_TXN_RETENTION, None)
        if keep is not None and found.lastUpdated is not None and found.lastUpdated <= _now() - keep:
            return None
        return found.version

    def domain(self, name: str, internal: bool = False) -> str | None:
        """A domain's configuration; domains of the format itself only with ``internal``."""
        if name.startswith(fixed.SYSTEM_DOMAIN_PREFIX) and not internal:
            raise TableError(f"{name} belongs to the format")
        found = self._newest("domainMetadata", F.col("domainMetadata.domain") == name)
        return None if found is None or found.removed else found.configuration

    def _newest(self, kind: str, which: Column):
        rows = self.commits(kind).where(which)
        old = self.checkpoint(kind)
        if old is not None:
            rows = rows.unionByName(old.where(which).withColumn("version", F.lit(self.log.checkpoint_version).cast("long")))
        return rows.agg(F.max_by(kind, "version").alias("x")).first().x

    def checksum(self) -> dict | None:
        """The checksum file's content, None if there is none that can be read."""
        if self.log.crc is None:
            return None
        try:
            got = json.loads(self.files.read(self.log.crc.meta.path))
            return got if isinstance(got, dict) and "metadata" in got and "protocol" in got else None
        except ValueError:
            return None

    def file_stats(self) -> dict:
        """Number and bytes of live files."""
        known = self.checksum()
        if known and self.log.crc.version == self.version and known.get("numFiles") is not None:
            return {"numFiles": known["numFiles"], "tableSizeBytes": known["tableSizeBytes"]}
        got = self.live_files().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        return {"numFiles": got.n, "tableSizeBytes": got.b}

    def timestamp(self) -> int:
        """In-commit time where enabled, else the commit file's time, in milliseconds."""
        return commit_time(self.files, self.version, self.metadata.flag(fixed.P_ICT), self.log)

    def refreshed(self, version: int | None = None) -> Snapshot:
        """This snapshot if nothing is newer, else a new one."""
        log = segment(self.files, version)
        return self if log.version == self.version and log.checkpoint_version == self.log.checkpoint_version else Snapshot(self.spark, self.root, log, self.files)


def read_commits(spark: SparkSession, files: list[LogFile], *kinds: str) -> DataFrame:
    """Actions of commit files with the long column ``version``."""
    schema = actions.schema(*kinds)
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    if any(f.meta.size == 0 for f in files):
        raise TableError("a commit is empty")
    name = F.col("_metadata.file_name")
    version = F.when(name.rlike(r"^\d{20}\.\d{20}\."), F.substring(name, 22, 20)).otherwise(F.substring(name, 1, 20)).cast("long")
    return spark.read.schema(schema).json([f.meta.path for f in files]).withColumn("version", version)


def load_sidecars(spark: SparkSession, manifest: list[str]) -> list[str]:
    read = spark.read.schema(actions.schema("sidecar"))
    df = read.json(manifest) if manifest[0].endswith(".json") else read.parquet(*manifest)
    return [r[0] for r in df.where("sidecar is not null").select("sidecar.path").collect()]


def _protocol(p: dict) -> Protocol:
    return Protocol(p["minReaderVersion"], p["minWriterVersion"], tuple(p.get("readerFeatures") or ()), tuple(p.get("writerFeatures") or ()))


def _metadata(m: dict) -> Metadata:
    return Metadata(m["id"], m["schemaString"], tuple(m.get("partitionColumns") or ()), dict(m.get("configuration") or {}), m.get("name"), m.get("description"), m.get("createdTime"))


def _now() -> int:
    import time

    return int(time.time() * 1000)


def commit_time(files: Files, version: int, in_commit: bool, log: LogSegment | None = None) -> int:
    meta = next((f.meta for f in (log.commits if log else []) if f.version == version), None)
    if meta is None:
        meta = next((f.meta for f in list_log(files) if f.kind == "commit" and f.version == version), None)
    if meta is None:
        raise TableError(f"version {version} has no commit file")
    if in_commit:
        info = json.loads(files.read(meta.path).split(b"\n", 1)[0]).get("commitInfo", {})
        if "inCommitTimestamp" in info:
            return info["inCommitTimestamp"]
    return meta.modified


def by_field_id(reader: DataFrameReader) -> DataFrameReader:
    """A reader that takes Parquet columns by their ids; the session keeps its settings."""
    return reader.option("spark.sql.parquet.fieldId.read.enabled", "true").option("spark.sql.parquet.fieldId.read.ignoreMissing", "true")


def _glob_safe(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def deleted_rows(spark: SparkSession, root: str, descriptors: list[tuple[str, dict]]) -> DataFrame:
    """(_file, _row) of all rows that the deletion vectors of files mark.  Vectors are decoded by executors."""
    slim = T.StructType.fromDDL("file string, source string, text string, at int, size int")
    rows = [(uri, (absolute(root, quote(f)) if (f := dv.file_of(d)) and d["storageType"] == "u" else f), d["pathOrInlineDv"], d["offset"], d["sizeInBytes"]) for uri, d in descriptors]
    listed = spark.createDataFrame(rows, slim).repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
    sources = sorted({r[1] for r in rows if r[1]})

    def explode(batches):
        for b in batches:
            for file, text, at, size, content in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                found = dv.decode_bitmap(dv.z85_decode(text)[:size]) if content is None else dv.read_file_entry(content, at, size)
                for start in range(0, max(len(found), 1), 100_000):
                    part = found[start : start + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array(part)], names=["_file", "_row"])

    if sources:
        content = spark.read.format("binaryFile").load([_glob_safe(s) for s in sources]).select(F.regexp_replace("path", "^file:/+", "file:/").alias("_path"), "content")
        listed = listed.withColumn("_path", F.when(F.col("source").startswith("/"), F.concat(F.lit("file:"), "source")).otherwise(F.regexp_replace("source", "^file:/+", "file:/"))).join(content, "_path", "left")
    else:
        listed = listed.withColumn("content", F.lit(None).cast("binary"))
    return listed.select("file", "text", "at", "size", "content").mapInArrow(explode, "_file string, _row long")


def read_files(s: Snapshot, files: list, columns: list[str] | None = None, predicate: Predicate | None = None, row_id: str | None = None, row_index: str | None = None, file_path: str | None = None, constants: dict[str, list] | None = None, physical_extra: list[T.StructField] = ()) -> DataFrame:
    """Rows of the given file actions as the snapshot's schema has them.

    ``constants`` are further per-file columns (name to values in the order of ``files``).
    """
    mode, partitions = s.mapping_mode, set(s.metadata.partition_columns)
    wanted = s.schema.names if columns is None else [s.resolve((c,))[1].name for c in columns]
    needed = list(dict.fromkeys([*wanted, *[s.resolve(p[:1])[1].name for p in (predicate.references() if predicate else ())]]))
    data = [c for c in needed if c not in partitions and not isinstance(s.schema[c].dataType, T.NullType)]
    physical = physical_type(T.StructType([s.schema[c] for c in data]), mode)
    extra = {**(constants or {})}
    names = [*wanted, *[n for n in (row_id, row_index, file_path) if n], *[f.name for f in physical_extra], *extra]
    if not files:
        kinds = {row_id: "long", row_index: "long", file_path: "string"}
        empty = s.spark.createDataFrame([], T.StructType([s.schema[c] for c in wanted]))
        for n in names[len(wanted) :]:
            empty = empty.withColumn(n, F.lit(None).cast(kinds.get(n, "string")))
        return empty
    paths = [absolute(s.root, f["path"]) for f in files]
    row_ids = s.metadata.configuration.get(fixed.P_ROW_ID_COLUMN) if row_id else None
    if row_id and not s.metadata.flag(fixed.P_ROW_TRACKING):
        raise TableError("row ids need row tracking")
    read_schema = T.StructType([*physical.fields, *([T.StructField(row_ids, T.LongType())] if row_ids else []), *physical_extra])
    reader = by_field_id(s.spark.read) if mode == "id" else s.spark.read
    df = reader.schema(read_schema).parquet(*dict.fromkeys(_glob_safe(p) for p in paths))
    with_vectors = [(spark_uri(p), f["deletionVector"]) for p, f in zip(paths, files, strict=True) if f["deletionVector"] is not None]
    shown = [c for c in needed if c in partitions]
    facts = bool(shown or row_id or extra)
    df = df.select("*", *[c for c in ([F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file")] if facts or with_vectors or file_path else []) + ([F.col("_metadata.row_index").alias("_row")] if with_vectors or row_id or row_index else [])])
    if with_vectors:
        gone = deleted_rows(s.spark, s.root, with_vectors)
        count = sum(d["cardinality"] for _, d in with_vectors)
        df = df.join(F.broadcast(gone) if count <= BROADCAST_ROWS else gone, ["_file", "_row"], "left_anti")
    if facts:
        kinds = [T.StructField("_file", T.StringType()), *[T.StructField(f"_p{i}", T.StringType()) for i in range(len(shown))], T.StructField("_base", T.LongType())]
        kinds += [T.StructField(f"_x{i}", T.LongType() if all(isinstance(x, int) for x in v) else T.StringType()) for i, v in enumerate(extra.values())]
        physical_names = [s.resolve((c,))[0][0] for c in shown]
        rows = [
            (spark_uri(p), *[(f["partitionValues"] or {}).get(n) for n in physical_names], f["baseRowId"] if row_id else None, *[v[i] for v in extra.values()])
            for i, (p, f) in enumerate(zip(paths, files, strict=True))
        ]
        facts_df = s.spark.createDataFrame(rows, T.StructType(kinds))
        df = df.join(F.broadcast(facts_df) if len(rows) <= BROADCAST_ROWS else facts_df, "_file")
    out = []
    for c in needed:
        kind = s.schema[c].dataType
        if c in partitions:
            out.append(parsed_partition(F.col(f"_p{shown.index(c)}"), kind).alias(c))
        elif isinstance(kind, T.NullType):
            out.append(F.lit(None).alias(c))
        else:
            out.append(to_logical(F.col(quoted([s.resolve((c,))[0][0]])), kind, mode).alias(c))
    if row_id:
        fresh = F.col("_base") + F.col("_row")
        out.append((F.coalesce(F.col(quoted([row_ids])), fresh) if row_ids else fresh).alias(row_id))
    if row_index:
        out.append(F.col("_row").alias(row_index))
    if file_path:
        out.append(F.col("_file").alias(file_path))
    out += [F.col(quoted([f.name])) for f in physical_extra]
    out += [F.col(f"_x{i}").alias(n) for i, n in enumerate(extra)]
    df = df.select(*out)
    if predicate is not None:
        df = df.where(predicate.to_column())
    return df.select(*[F.col(quoted([n])) for n in names])


class Table:
    """A table by its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root

    def snapshot(self, version: int | None = None, log_tail: list[LogFile] = (), max_version: int | None = None) -> Snapshot:
        return Snapshot(self.spark, self.root, segment(self.files, version, log_tail, max_version=max_version), self.files)

    def history(self) -> list[tuple[int, int]]:
        """(version, time in ms) of every commit file, oldest first.

        Versions from the enablement of in-commit time on have that time; older ones their file's time, made
        increasing where files are out of order.
        """
        commits = sorted((f for f in list_log(self.files) if f.kind == "commit"), key=lambda f: f.version)
        conf = self.snapshot().metadata
        start = int(conf.configuration.get(fixed.P_ICT_VERSION, 0)) if conf.flag(fixed.P_ICT) else None
        times: list[tuple[int, int]] = []
        if start is not None and any(f.version >= start for f in commits):
            rows = read_commits(self.spark, [f for f in commits if f.version >= start], "commitInfo").where("commitInfo.inCommitTimestamp is not null")
            in_commit = {r[0]: r[1] for r in rows.select("version", "commitInfo.inCommitTimestamp").collect()}
        else:
            in_commit = {}
        for f in commits:
            t = in_commit.get(f.version, f.meta.modified)
            times.append((f.version, max(t, times[-1][1] + 1) if times and f.version not in in_commit else t))
        return times

    def _search(self, timestamp_ms: int, from_right: bool) -> tuple[list[int], int]:
        """All versions and how many are before the time, or not after it (``from_right``), without reading every commit.

        Times rise with versions, so in-commit times are looked up by halving: one small read for each step.
        """
        commits = sorted((f for f in list_log(self.files) if f.kind == "commit"), key=lambda f: f.version)
        conf = self.snapshot().metadata
        start = int(conf.configuration.get(fixed.P_ICT_VERSION, 0)) if conf.flag(fixed.P_ICT) else None
        by_file: list[int] = []
        for f in commits:
            by_file.append(max(f.meta.modified, by_file[-1] + 1) if by_file else f.meta.modified)

        def time(i: int) -> int:
            if start is None or commits[i].version < start:
                return by_file[i]
            info = json.loads(self.files.read(commits[i].meta.path).split(b"\n", 1)[0]).get("commitInfo", {})
            return info.get("inCommitTimestamp", by_file[i])

        # Times by file and in-commit times each rise; the border between them is one more comparison.
        border = len(commits) if start is None else next((i for i, f in enumerate(commits) if f.version >= start), len(commits))
        look = bisect_right if from_right else bisect_left
        if border < len(commits) and (time(border) <= timestamp_ms if from_right else time(border) < timestamp_ms):
            at = look(range(len(commits)), timestamp_ms, lo=border, key=time)
        else:
            at = look(by_file, timestamp_ms, hi=border)
        return [f.version for f in commits], at

    def version_at(self, timestamp_ms: int) -> int:
        """The last version committed at the time or before it."""
        versions, n = self._search(timestamp_ms, True)
        if not n:
            raise TableError("the time is before the first commit")
        return versions[n - 1]

    def version_from(self, timestamp_ms: int) -> int:
        """The first version committed at the time or after it."""
        versions, n = self._search(timestamp_ms, False)
        if n == len(versions):
            raise TableError("the time is after the last commit")
        return versions[n]

    def versions_between(self, start_ms: int, end_ms: int | None = None) -> tuple[int, int | None]:
        first = self.version_from(start_ms)
        last = None if end_ms is None else self.version_at(end_ms)
        if last is not None and last < first:
            raise TableError("no commit lies in the range")
        return first, last


