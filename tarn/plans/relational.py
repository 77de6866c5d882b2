"""Nine relational operators and seven aggregates with exact null semantics, as thin layers over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.expressions import Expr, Predicate, quoted
from tarn.sources.files import spark_uri
from tarn.table import by_field_id


#: Above this many files or deleted rows a table of them is shuffled and no longer broadcast.
BROADCAST_ROWS = 200_000


class PlanError(Exception):
    """A plan whose parts don't fit."""


def _column(x: Expr | Column | str) -> Column:
    return x.to_column() if isinstance(x, Expr) else F.col(x) if isinstance(x, str) else x


def _checked(read: DataFrame, there: T.StructType, schema: T.StructType) -> DataFrame:
    names = {f.name.lower() for f in there.fields}
    for f in schema.fields:
        if not f.nullable and f.name.lower() not in names:
            raise PlanError(f"column {f.name} may not be NULL and is missing in the files")
    return read.select(*[F.col(quoted([f.name])) for f in schema.fields])


def _with_constants(df: DataFrame, constants: dict[str, dict[str, Any]] | None, kinds: T.StructType | None, row_index: str | None, columns: list[str]) -> DataFrame:
    """Add per-file constants (file to name to value) and the row's place in its file."""
    if row_index:
        df = df.withColumn(row_index, F.col("_metadata.row_index"))
        columns = [*columns, row_index]
    if constants:
        spark = df.sparkSession
        named = T.StructType([T.StructField("_file", T.StringType()), *kinds.fields])
        rows = spark.createDataFrame([(spark_uri(k), *[v.get(f.name) for f in kinds.fields]) for k, v in constants.items()], named)
        df = df.withColumn("_file", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")).join(F.broadcast(rows) if len(constants) <= BROADCAST_ROWS else rows, "_file")
        columns = [*columns, *[f.name for f in kinds.fields]]
    return df.select(*[F.col(quoted([c])) for c in columns])


def scan_parquet(
    spark: SparkSession, files: Sequence[str], schema: T.StructType, constants: dict[str, dict[str, Any]] | None = None, constant_schema: T.StructType | None = None, row_index: str | None = None
) -> DataFrame:
    """Rows of the files as exactly ``schema``: columns by field id where the schema has ids, then by name; a missing
    nullable column is NULL, any other missing column an error.  ``constants`` are literals by file, for each of the files."""
    if not files:
        return spark.createDataFrame([], schema)
    if constants and (strange := {spark_uri(f) for f in files} ^ {spark_uri(f) for f in constants}):
        raise PlanError(f"files and constants don't match: {sorted(strange)[:3]}")
    by_id = any("parquet.field.id" in f.metadata for f in schema.fields)
    reader = by_field_id(spark.read) if by_id else spark.read
    there = spark.read.parquet(*files).schema
    loose = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
    if not by_id:
        _checked(spark.createDataFrame([], loose), there, schema)
    return _with_constants(reader.schema(loose).parquet(*files), constants, constant_schema, row_index, schema.names)


def scan_json(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of newline-delimited JSON files as exactly ``schema``."""
    return spark.read.schema(schema).json(list(files)) if files else spark.createDataFrame([], schema)


def values(spark: SparkSession, schema: T.StructType, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """Literal rows."""
    for r in rows:
        if len(r) != len(schema.fields):
            raise PlanError("a row has another number of values than the schema has columns")
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def project(df: DataFrame, columns: Sequence[Expr | Column], schema: T.StructType) -> DataFrame:
    """Columns evaluated to a declared schema; another number of columns or another type is an error."""
    if len(columns) != len(schema.fields):
        raise PlanError("the projection has another number of columns than its schema")
    if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
        raise PlanError("names must differ, whatever their case")
    out = df.select(*[_column(c).alias(f.name) for c, f in zip(columns, schema.fields, strict=True)])
    for have, want in zip(out.schema.fields, schema.fields, strict=True):
        if _bare(have.dataType) != _bare(want.dataType):
            raise PlanError(f"column {want.name} is {have.dataType.simpleString()}, declared as {want.dataType.simpleString()}")
    return out


def _bare(kind: T.DataType) -> str:
    return kind.simpleString()


class Patch:
    """A sparse edit of a row or a struct: drop, replace, insert after, put first or last, and nested edits."""

    def __init__(self):
        self.drops: dict[str, bool] = {}
        self.replaced: dict[str, Column] = {}
        self.after: dict[str | None, list[tuple[str, Column]]] = {}
        self.nested: dict[str, Patch] = {}
        self.last: list[tuple[str, Column]] = []

    def drop(self, name: str, if_exists: bool = False) -> Patch:
        self.drops[name] = if_exists
        return self

    def replace(self, name: str, value: Expr | Column) -> Patch:
        self.replaced[name] = _column(value)
        return self

    def insert_after(self, name: str, new: str, value: Expr | Column) -> Patch:
        self.after.setdefault(name, []).append((new, _column(value)))
        return self

    def prepend(self, new: str, value: Expr | Column) -> Patch:
        self.after.setdefault(None, []).append((new, _column(value)))
        return self

    def append(self, new: str, value: Expr | Column) -> Patch:
        self.last.append((new, _column(value)))
        return self

    def nest(self, name: str, patch: Patch) -> Patch:
        self.nested[name] = patch
        return self

    def columns(self, kind: T.StructType, at: Sequence[str] = ()) -> list[Column]:
        names = set(kind.names)
        asked = {n for n, loose in self.drops.items() if not loose} | set(self.replaced) | (set(self.after) - {None}) | set(self.nested)
        if missing := asked - names:
            raise PlanError(f"no column {sorted(missing)}")
        out = [v.alias(n) for n, v in self.after.get(None, [])]
        for f in kind.fields:
            here = F.col(quoted([*at, f.name]))
            if f.name in self.nested:
                made = F.struct(*self.nested[f.name].columns(f.dataType, [*at, f.name]))
                here = F.when(here.isNotNull(), made)
            if f.name not in self.drops:
                out.append(self.replaced.get(f.name, here).alias(f.name))
            out += [v.alias(n) for n, v in self.after.get(f.name, [])]
        return out + [v.alias(n) for n, v in self.last]


def project_patch(df: DataFrame, patch: Patch) -> DataFrame:
    return df.select(*patch.columns(df.schema))


def filter_rows(df: DataFrame, predicate: Predicate | Column) -> DataFrame:
    """Rows for which the predicate is TRUE."""
    return df.where(_column(predicate))


def dynamic_scan(spark: SparkSession, upstream: DataFrame, path_column: str, base: str, schema: T.StructType, carry: Sequence[str] = ()) -> DataFrame:
    """Read the files that a relation names, relative to ``base``, with its columns ``carry`` on each of their rows.

    The list of files must reach the driver, which plans the read; nothing else does.
    """
    named = upstream.select(F.col(path_column).alias("_path"), *carry)
    rows = named.collect()
    if not rows:
        return spark.createDataFrame([], T.StructType([*schema.fields, *[named.schema[c] for c in carry]]))
    paths = {r["_path"]: r["_path"] if "://" in r["_path"] or r["_path"].startswith(("/", "file:")) else f"{base.rstrip('/')}/{r['_path']}" for r in rows}
    uri = {p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString() for p in paths.values()}
    fs = {p: u if u.split(":", 1)[0].isalnum() and ":" in u else f"file:{u}" for p, u in uri.items()}
    read = spark.read.schema(schema).parquet(*dict.fromkeys(paths.values())).withColumn("_file", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"))
    if not carry:
        return read.drop("_file")
    facts = spark.createDataFrame([(fs[paths[r["_path"]]], *[r[c] for c in carry]) for r in rows], T.StructType([T.StructField("_file", T.StringType()), *[named.schema[c] for c in carry]]))
    return read.join(F.broadcast(facts) if len(rows) <= BROADCAST_ROWS else facts, "_file").select(*schema.names, *carry)


# Aggregates


def agg_min(c: str) -> Column:
    return F.min(c)


def agg_max(c: str) -> Column:
    return F.max(c)


def agg_sum(c: str) -> Column:
    """Sum of a long column; a column of another type and overflow are errors."""
    long = F.typeof(F.col(c)) == "bigint"
    whole = F.col(c).bitwiseOR(F.lit(0).cast("long"))  # refused by analysis for other numbers than integers
    return F.sum(F.when(long, whole).otherwise(F.raise_error(F.lit(f"the sum of {c} needs a long column")).cast("long")))


def agg_count(c: str) -> Column:
    return F.count(c)


def agg_count_star() -> Column:
    return F.count(F.lit(1)).alias("count")


def min_non_null_by(value: str, sentinel: str, key: str) -> Column:
    """The value, NULL or not, at the least key among rows whose sentinel and key are not NULL."""
    return F.min_by(F.col(value), F.when(F.col(sentinel).isNotNull(), F.col(key)))


def max_non_null_by(value: str, sentinel: str, key: str) -> Column:
    """The value, NULL or not, at the greatest key among rows whose sentinel and key are not NULL; ties take any."""
    return F.max_by(F.col(value), F.when(F.col(sentinel).isNotNull(), F.col(key)))


def aggregate(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by columns, in which NULL is a value; without keys exactly one row comes out."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


# Joins and unions


def _same(probe: DataFrame, build: DataFrame, keys: Sequence[str | tuple[str, str]]) -> Column:
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    return reduce(lambda a, b: a & b, [probe[p].eqNullSafe(build[b]) for p, b in pairs])


def semi_join(probe: DataFrame, build: DataFrame, keys: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Rows of ``probe`` whose key is in ``build``; NULL is equal to NULL."""
    probe, build = probe.alias("_p"), build.alias("_b")
    return probe.join(build, _same(probe, build, keys), "left_semi")


def anti_join(probe: DataFrame, build: DataFrame, keys: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Rows of ``probe`` whose key isn't in ``build``; NULL is equal to NULL."""
    probe, build = probe.alias("_p"), build.alias("_b")
    return probe.join(build, _same(probe, build, keys), "left_anti")


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of relations with one schema."""
    first = [(f.name, _bare(f.dataType)) for f in dfs[0].schema.fields]
    for d in dfs[1:]:
        if [(f.name, _bare(f.dataType)) for f in d.schema.fields] != first:
            raise PlanError("the inputs of a union must have one schema")
    return reduce(DataFrame.unionByName, dfs)
