"""What happened between versions: change feed, incremental file lists, commit ranges and net changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import fixed
from tarn.functions.expressions import Predicate
from tarn.sources import actions
from tarn.sources.log import LogFile, TableError, list_log
from tarn.sources.files import absolute, spark_uri
from tarn.table import Snapshot, Table, _metadata, _protocol, deleted_rows, file_key, read_commits, read_files

CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIME = "_change_type", "_commit_version", "_commit_timestamp"


def _commit_files(table: Table, start: int, end: int | None) -> list[LogFile]:
    found = {f.version: f for f in list_log(table.files) if f.kind == "commit"}
    end = max(found, default=-1) if end is None else end
    if start < 0 or start > end:
        raise TableError(f"no such range: {start} to {end}")
    if missing := [v for v in range(start, end + 1) if v not in found]:
        raise TableError(f"version {missing[0]} has no commit file")
    return [found[v] for v in range(start, end + 1)]


def commit_range(table: Table, start: int, end: int | None = None, kinds: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """Raw actions of the chosen kinds, with ``version`` and ``timestamp`` (ms), in commit order."""
    files = _commit_files(table, start, end)
    rows = read_commits(table.spark, files, *dict.fromkeys([*kinds, "protocol", "commitInfo"]) if kinds else ())
    for r in rows.where("protocol is not null").select("protocol").collect():
        _protocol(r[0].asDict(True)).check("scan")
    time = table.spark.createDataFrame([(f.version, f.meta.modified) for f in files], "version long, _t long")
    in_commit = rows.where("commitInfo.inCommitTimestamp is not null").select("version", F.col("commitInfo.inCommitTimestamp").alias("_i"))
    times = time.join(in_commit, "version", "left").select("version", F.coalesce("_i", "_t").alias("timestamp"))
    kinds = kinds or tuple(actions.KINDS)
    some = None
    for k in kinds:
        some = F.col(k).isNotNull() if some is None else some | F.col(k).isNotNull()
    out = rows.where(some).select("version", *kinds).join(F.broadcast(times), "version")  # one row for each commit
    return out.orderBy(F.col("version").desc() if descending else F.col("version").asc())


@dataclass
class ChangeFeed:
    """Row-level changes of the versions ``start`` to ``end``, both included.

    The change feed must be enabled, and the schema the same, throughout.
    """

    table: Table
    start: int
    end: int | None = None

    def __post_init__(self):
        self.files = _commit_files(self.table, self.start, self.end)
        self.end = self.files[-1].version
        self.snapshot = self.table.snapshot(self.end)
        first = self.table.snapshot(self.start)
        for s in (first, self.snapshot):
            s.protocol.check("cdf")
            if not s.metadata.flag(fixed.P_CDF):
                raise TableError(f"the change feed isn't enabled at version {s.version}")
        rows = read_commits(self.table.spark, self.files, "metaData", "protocol")
        for r in rows.where("metaData is not null or protocol is not null").collect():
            if r.metaData is not None:
                m = _metadata(r.metaData.asDict(True))
                if not m.flag(fixed.P_CDF):
                    raise TableError(f"the change feed isn't enabled at version {r.version}")
                if m.schema != self.snapshot.schema:
                    raise TableError(f"the schema is another at version {r.version}")
            if r.protocol is not None:
                _protocol(r.protocol.asDict(True)).check("cdf")
        if first.schema != self.snapshot.schema:
            raise TableError(f"the schema is another at version {self.start}")

    def file_changes(self) -> DataFrame:
        """The file actions that tell the changes: version, kind, and the fields of the file.

        A commit with change files is told by those alone; else by its adds and removes that change data, where a
        remove and an add of one path are a change of deletion vectors.
        """
        rows = read_commits(self.table.spark, self.files, "add", "remove", "cdc")
        has = rows.groupBy("version").agg(F.max(F.col("cdc").isNotNull()).alias("_cdc"))
        rows = rows.join(F.broadcast(has), "version")  # one row for each commit
        cdc = rows.where("cdc is not null").select("version", F.lit("cdc").alias("kind"), "cdc.path", "cdc.partitionValues", F.lit(None).cast("string").alias("stats"), F.lit(None).cast(actions.schema("add")["add"].dataType["deletionVector"].dataType).alias("deletionVector"))
        plain = rows.where("not _cdc")
        add = plain.where("add.dataChange").select("version", F.lit("add").alias("kind"), *[f"add.{c}" for c in ("path", "partitionValues", "stats", "deletionVector")])
        remove = plain.where("remove.dataChange").select("version", F.lit("remove").alias("kind"), *[f"remove.{c}" for c in ("path", "partitionValues", "stats", "deletionVector")])
        return cdc.unionByName(add).unionByName(remove)

    def scan(self, columns: list[str] | None = None, predicate: Predicate | None = None) -> DataFrame:
        """The changed rows with ``_change_type``, ``_commit_version`` and ``_commit_timestamp``."""
        s, spark = self.snapshot, self.table.spark
        found = self.file_changes().collect()  # the files of the range, which the driver must name to read
        times = {f.version: f.meta.modified for f in self.files}
        if s.metadata.flag(fixed.P_ICT):
            rows = read_commits(spark, self.files, "commitInfo").where("commitInfo.inCommitTimestamp is not null")
            times |= {r[0]: r[1] for r in rows.select("version", "commitInfo.inCommitTimestamp").collect()}
        by = {}
        for r in found:
            by.setdefault((r.version, r.path), {})[r.kind] = r
        groups: dict[str, list] = {"insert": [], "delete": [], "cdc": []}
        pairs = []
        for (version, _), kinds in sorted(by.items()):
            if "cdc" in kinds:
                groups["cdc"].append((version, kinds["cdc"], kinds["cdc"].deletionVector))
            elif len(kinds) == 2:
                pairs.append((version, kinds["add"], kinds["remove"]))
            elif "add" in kinds:
                groups["insert"].append((version, kinds["add"], kinds["add"].deletionVector))
            else:
                groups["delete"].append((version, kinds["remove"], kinds["remove"].deletionVector))

        names = s.schema.names if columns is None else [s.resolve((c,))[1].name for c in columns]
        parts = []
        for kind, rows in groups.items():
            if rows:
                extra = [T.StructField(CHANGE_TYPE, T.StringType())] if kind == "cdc" else []
                df = self._read(rows, names, predicate, extra)
                df = df if kind == "cdc" else df.withColumn(CHANGE_TYPE, F.lit(kind))
                parts.append(df)
        # Vectors that changed: rows of one vector and not of the other, found on the driver only as a plan.
        for kind, more, less in (("delete", 1, 2), ("insert", 2, 1)):
            rows = [p for p in pairs if p[more].deletionVector is not None]
            if rows:
                parts.append(self._between(rows, more, less, names, predicate).withColumn(CHANGE_TYPE, F.lit(kind)))
        if not parts:
            empty = spark.createDataFrame([], T.StructType([s.schema[n] for n in names]))
            return empty.withColumns({CHANGE_TYPE: F.lit(""), COMMIT_VERSION: F.lit(0).cast("long"), COMMIT_TIME: F.lit(None).cast("timestamp")})
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        at = F.create_map(*[F.lit(x) for v, t in times.items() for x in (v, t)])
        return out.withColumn(COMMIT_TIME, F.timestamp_millis(F.element_at(at, F.col(COMMIT_VERSION)))).select(*names, CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIME)

    @staticmethod
    def _file(r, vector) -> dict:
        return {"path": r.path, "partitionValues": r.partitionValues, "deletionVector": vector, "baseRowId": None}

    def _read(self, rows, names, predicate, extra=()) -> DataFrame:
        # One path may stand in several versions: each version's files are read by themselves where that is so.
        parts, left = [], rows
        while left:
            seen, now, later = set(), [], []
            for x in left:
                (later if x[1].path in seen else now).append(x)
                seen.add(x[1].path)
            parts.append(read_files(self.snapshot, [self._file(r, v) for _, r, v in now], names, predicate, constants={COMMIT_VERSION: [v for v, *_ in now]}, physical_extra=list(extra)))
            left = later
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _between(self, rows, more, less, names, predicate) -> DataFrame:
        """Rows that the vector of ``more`` marks and that of ``less`` doesn't."""
        s = self.snapshot

        out = None
        left = rows
        while left:
            seen, now, later = set(), [], []
            for x in left:
                (later if x[1].path in seen else now).append(x)
                seen.add(x[1].path)
            uri = {x[1].path: spark_uri(absolute(s.root, x[1].path)) for x in now}
            marked = deleted_rows(s.spark, s.root, [(uri[x[more].path], x[more].deletionVector) for x in now])
            others = [(uri[x[less].path], x[less].deletionVector) for x in now if x[less].deletionVector is not None]
            if others:
                marked = marked.join(deleted_rows(s.spark, s.root, others), ["_file", "_row"], "left_anti")
            df = read_files(s, [self._file(x[1], None) for x in now], names, predicate, row_index="_i", file_path="_f", constants={COMMIT_VERSION: [x[0] for x in now]})
            df = df.join(marked, (df["_f"] == marked["_file"]) & (df["_i"] == marked["_row"]), "left_semi").drop("_f", "_i")
            out = df if out is None else out.unionByName(df)
            left = later
        return out


@dataclass(frozen=True)
class IncrementalScan:
    """File changes after ``base`` up to ``target``: live adds, and keys of removed files, newest first."""

    base: int
    target: int
    adds: DataFrame
    removes: DataFrame

    def against(self, base_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """With the base's file keys (path, dv): adds that are new, adds that the base has, and removes that the base has."""
        key = F.struct("path", F.col("dv").cast("string")).cast("string")
        base = base_keys.select(F.struct("path", F.col("dv").cast("string")).cast("string").alias("_k")).distinct()
        adds = self.adds.withColumn("_k", F.struct("path", F.col("_dv").cast("string")).cast("string"))
        removes = self.removes.withColumn("_k", key)
        return (
            adds.join(base, "_k", "left_anti").drop("_k"),
            adds.join(base, "_k", "left_semi").drop("_k"),
            removes.join(base, "_k", "left_semi").drop("_k"),
        )


def incremental_scan(table: Table, base: int, target: int | None = None, predicate: Predicate | None = None) -> IncrementalScan | None:
    """What changed in the file list after ``base``; None if the log can't tell.  Removes are never pruned."""
    try:
        files = _commit_files(table, base + 1, target)
    except TableError:
        return None
    s = table.snapshot(files[-1].version)
    s.protocol.check("scan")
    rows = read_commits(table.spark, files, "add", "remove").where("add is not null or remove is not null")
    rows = rows.withColumn("_key", F.coalesce(file_key("add"), file_key("remove")))
    newest = rows.groupBy("_key").agg(F.max_by(F.struct("add"), F.struct("version", F.col("add").isNotNull())).alias("_w"))
    adds = newest.where("_w.add is not null").select("_w.add.*", F.col("_key.dv").alias("_dv"))
    keep = s._pruning(predicate)
    adds = keep(adds) if keep else adds
    removes = newest.where("_w.add is null").select("_key.path", F.col("_key.dv").alias("dv"))
    return IncrementalScan(base, files[-1].version, adds, removes)


def file_keys(snapshot: Snapshot) -> DataFrame:
    """(path, dv) of a snapshot's files."""
    d = F.col("deletionVector")
    vector = F.when(d.isNotNull(), F.struct(d["storageType"].alias("storageType"), d["pathOrInlineDv"].alias("pathOrInlineDv"), d["offset"].alias("offset")))
    return snapshot.live_files().select("path", vector.alias("dv"))


def tracked_changes(table: Table, start: int, end: int | None = None, net: bool = False) -> DataFrame:
    """File actions of tables with row tracking: all of them (version, kind, path, vector id), or the net effect for each path.

    The net effect is the earliest remove and the latest add of a path; where both have one vector the path is left out.
    """
    files = _commit_files(table, start, end)
    rows = read_commits(table.spark, files, "add", "remove")

    def of(kind: str) -> DataFrame:
        d = F.col(f"{kind}.deletionVector")
        text = F.concat(d["storageType"], d["pathOrInlineDv"], F.coalesce(F.concat(F.lit("@"), d["offset"]), F.lit("")))
        return rows.where(f"{kind}.dataChange").select("version", F.lit(kind).alias("kind"), f"{kind}.path", text.alias("dv_id"), f"{kind}.baseRowId")

    every = of("add").unionByName(of("remove"))
    if not net:
        return every
    each = every.groupBy("path").agg(
        F.min_by(F.struct("version", "dv_id"), F.when(F.col("kind") == "remove", F.col("version"))).alias("removed"),
        F.max_by(F.struct("version", "dv_id"), F.when(F.col("kind") == "add", F.col("version"))).alias("added"),
        F.max_by("kind", F.struct("version", F.col("kind") == "add")).alias("last"),
        F.min_by("kind", F.struct("version", F.col("kind") == "add")).alias("first"),
    )
    each = each.withColumn("removed", F.when(F.col("first") == "remove", F.col("removed"))).withColumn("added", F.when(F.col("last") == "add", F.col("added")))
    same = F.col("removed").isNotNull() & F.col("added").isNotNull() & F.col("removed.dv_id").eqNullSafe(F.col("added.dv_id"))
    return each.where(~same & (F.col("removed").isNotNull() | F.col("added").isNotNull())).select("path", "removed", "added")
