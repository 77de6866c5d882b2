"""Structured expressions and predicates: each becomes a Spark column; predicates also become filters over file statistics.

Null behaviour is that of the table format and not always Spark's: membership is never NULL, casts that fail give NULL,
float division follows IEEE and junctions of nothing have a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(path: Sequence[str]) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in path)


class Expr:
    """A scalar expression."""

    def to_column(self) -> Column:
        raise NotImplementedError

    def children(self) -> Sequence[Expr]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def references(self) -> set[tuple[str, ...]]:
        return {x.path for x in self.walk() if isinstance(x, Ref)}

    def __lt__(self, o):
        return Compare("<", self, expr(o))

    def __le__(self, o):
        return Compare("<=", self, expr(o))

    def __gt__(self, o):
        return Compare(">", self, expr(o))

    def __ge__(self, o):
        return Compare(">=", self, expr(o))

    def eq(self, o):
        return Compare("=", self, expr(o))

    def ne(self, o):
        return Compare("!=", self, expr(o))

    def distinct_from(self, o):
        return Compare("distinct", self, expr(o))

    def is_in(self, values):
        return In(self, values if isinstance(values, Expr) else tuple(values))

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return Not(IsNull(self))

    def __add__(self, o):
        return Arithmetic("+", self, expr(o))

    def __sub__(self, o):
        return Arithmetic("-", self, expr(o))

    def __mul__(self, o):
        return Arithmetic("*", self, expr(o))

    def __truediv__(self, o):
        return Divide(self, expr(o))

    def cast(self, kind: str | T.DataType):
        return Cast(self, kind)


@dataclass(frozen=True, eq=False)
class Ref(Expr):
    path: tuple[str, ...]

    def to_column(self):
        return F.col(quoted(self.path))


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: Any
    kind: T.DataType | str | None = None

    def to_column(self):
        out = F.lit(self.value)
        return out.cast(self.kind) if self.kind is not None else out


@dataclass(frozen=True, eq=False)
class Struct(Expr):
    """A struct of named fields; NULL as a whole unless ``keep``, where given, is TRUE."""

    fields: tuple[tuple[str, Expr], ...]
    keep: Predicate | None = None

    def children(self):
        return [e for _, e in self.fields] + ([self.keep] if self.keep else [])

    def to_column(self):
        made = F.struct(*[e.to_column().alias(n) for n, e in self.fields])
        return made if self.keep is None else F.when(self.keep.to_column(), made)


@dataclass(frozen=True, eq=False)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return [self.left, self.right]

    def to_column(self):
        a, b = self.left.to_column(), self.right.to_column()
        return {"+": a + b, "-": a - b, "*": a * b}[self.op]


@dataclass(frozen=True, eq=False)
class Divide(Expr):
    """Division of floats after IEEE: by zero it gives infinities or NaN, and NULL only for NULL."""

    left: Expr
    right: Expr

    def children(self):
        return [self.left, self.right]

    def to_column(self):
        a, b = self.left.to_column().cast("double"), self.right.to_column().cast("double")
        minus = (a < 0) != b.cast("string").startswith("-")
        endless = F.when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a.isNotNull(), endless)).otherwise(F.try_divide(a, b))


@dataclass(frozen=True, eq=False)
class IntDivide(Expr):
    """Division of integers: it truncates, and a zero divisor is an error."""

    left: Expr
    right: Expr

    def children(self):
        return [self.left, self.right]

    def to_column(self):
        return F.call_function("div", self.left.to_column(), self.right.to_column())


@dataclass(frozen=True, eq=False)
class Coalesce(Expr):
    parts: tuple[Expr, ...]

    def children(self):
        return self.parts

    def to_column(self):
        return F.coalesce(*[p.to_column() for p in self.parts])


@dataclass(frozen=True, eq=False)
class Array(Expr):
    parts: tuple[Expr, ...]

    def children(self):
        return self.parts

    def to_column(self):
        return F.array(*[p.to_column() for p in self.parts])


@dataclass(frozen=True, eq=False)
class ToJson(Expr):
    """JSON text of a struct: binary in lower-case hex, timestamps with three digits, cut off."""

    child: Expr
    schema: T.StructType

    def children(self):
        return [self.child]

    def to_column(self):
        c = self.child.to_column()
        return F.when(c.isNotNull(), F.to_json(_hexed(c, self.schema)))


def _hexed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_hexed(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hexed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _hexed(x, kind.valueType))
    return c


@dataclass(frozen=True, eq=False)
class ParseJson(Expr):
    """A struct from JSON text; text that can't be parsed gives NULL fields and never an error."""

    child: Expr
    schema: T.StructType | str

    def children(self):
        return [self.child]

    def to_column(self):
        return F.from_json(self.child.to_column(), self.schema, {"mode": "PERMISSIVE"})


@dataclass(frozen=True, eq=False)
class MapToStruct(Expr):
    """A typed struct from a map of texts: a missing key is NULL, '' is '' for texts, empty bytes for binary and else NULL."""

    child: Expr
    schema: T.StructType

    def children(self):
        return [self.child]

    def to_column(self):
        return F.struct(*[parsed_partition(F.element_at(self.child.to_column(), F.lit(f.name)), f.dataType).alias(f.name) for f in self.schema.fields])


def parsed_partition(text: Column, kind: T.DataType) -> Column:
    """The typed value of a serialised partition value; a text that doesn't parse is an error."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return F.encode(text, "utf-8")
    return F.when(text != "", text.cast(kind))


@dataclass(frozen=True, eq=False)
class Cast(Expr):
    """A cast whose failures are NULL."""

    child: Expr
    kind: T.DataType | str

    def children(self):
        return [self.child]

    def to_column(self):
        return self.child.to_column().try_cast(self.kind)


@dataclass(frozen=True, eq=False)
class Opaque(Expr):
    """Any column of the host engine."""

    make: Callable[[], Column]

    def to_column(self):
        return self.make()


@dataclass(frozen=True, eq=False)
class Unknown(Expr):
    """A named stand-in: skipping takes it for NULL, evaluation is an error."""

    name: str

    def to_column(self):
        raise ValueError(f"unknown expression {self.name} can't be evaluated")


class Predicate(Expr):
    """A boolean expression."""

    def __and__(self, o):
        return And((self, o))

    def __or__(self, o):
        return Or((self, o))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True, eq=False)
class BooleanExpr(Predicate):
    child: Expr

    def children(self):
        return [self.child]

    def to_column(self):
        return self.child.to_column()


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return [self.left, self.right]

    def to_column(self):
        a, b = self.left.to_column(), self.right.to_column()
        return {
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "=": lambda: a == b, "!=": lambda: a != b,
            "distinct": lambda: ~a.eqNullSafe(b), "same": lambda: a.eqNullSafe(b),
        }[self.op]()


@dataclass(frozen=True, eq=False)
class In(Predicate):
    """Membership in literals or in a list column; a NULL needle and NULL elements never match, and the answer is never NULL."""

    needle: Expr
    values: tuple | Expr

    def children(self):
        return [self.needle, *([self.values] if isinstance(self.values, Expr) else [])]

    def to_column(self):
        n = self.needle.to_column()
        if isinstance(self.values, Expr):
            return F.coalesce(F.exists(self.values.to_column(), lambda x: F.coalesce(x == n, F.lit(False))), F.lit(False))
        known = [expr(v).to_column() for v in self.values if not (v is None or isinstance(v, Literal) and v.value is None)]
        return F.coalesce(n.isin(*known), F.lit(False)) if known else F.lit(False)


@dataclass(frozen=True, eq=False)
class IsNull(Predicate):
    child: Expr

    def children(self):
        return [self.child]

    def to_column(self):
        return self.child.to_column().isNull()


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    child: Predicate

    def children(self):
        return [self.child]

    def to_column(self):
        return ~self.child.to_column()


@dataclass(frozen=True, eq=False)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def to_column(self):
        out = F.lit(True)
        for p in self.parts:
            out = out & p.to_column()
        return out


@dataclass(frozen=True, eq=False)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def to_column(self):
        out = F.lit(False)
        for p in self.parts:
            out = out | p.to_column()
        return out


@dataclass(frozen=True, eq=False)
class OpaquePredicate(Predicate):
    """A predicate of the host engine, with an optional rewrite over file statistics."""

    make: Callable[[], Column]
    skipping: Callable[[Any], Column | None] | None = None

    def to_column(self):
        return self.make()


@dataclass(frozen=True, eq=False)
class UnknownPredicate(Predicate):
    name: str

    def to_column(self):
        raise ValueError(f"unknown predicate {self.name} can't be evaluated")


def expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def col(name: str | Sequence[str]) -> Ref:
    return Ref(tuple(name.split(".")) if isinstance(name, str) else tuple(name))


lit = Literal
_OPPOSITE = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "=": "!=", "!=": "=", "distinct": "same", "same": "distinct"}
_MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!=", "distinct": "distinct", "same": "same"}


def normal(p: Predicate, negate: bool = False) -> Predicate:
    """Push NOT down to the leaves and put literals on the right."""
    match p:
        case Not():
            return normal(p.child, not negate)
        case And() | Or():
            kind = Or if isinstance(p, And) == negate else And
            return kind(tuple(normal(x, negate) for x in p.parts))
        case Compare():
            op, left, right = p.op, p.left, p.right
            if isinstance(left, Literal) and not isinstance(right, Literal):
                op, left, right = _MIRRORED[op], right, left
            return Compare(_OPPOSITE[op] if negate else op, left, right)
        case _:
            return Not(p) if negate else p


class Stats:
    """Columns of a file's statistics, by path; None where there are none."""

    def minimum(self, path) -> Column | None: ...

    def maximum(self, path) -> Column | None: ...

    def nulls(self, path) -> Column | None: ...

    def rows(self) -> Column | None: ...

    def exact(self, path) -> Column | None: ...

    def kind(self, path) -> T.DataType | None: ...


def skipping_filter(p: Predicate, stats: Stats) -> Column:
    """Whether a file may hold rows for which ``p`` is TRUE: NULL where statistics can't tell."""
    unknown = F.lit(None).cast("boolean")

    def leaf(c: Compare) -> Column:
        if not isinstance(c.left, Ref) or not isinstance(c.right, Literal):
            return unknown
        path, value = c.left.path, c.right.value
        if c.op in ("distinct", "same"):
            if value is None:
                return null_check(path, c.op == "same")
            if c.op == "same":
                return leaf(Compare("=", c.left, c.right))
            return null_check(path, True) | leaf(Compare("!=", c.left, c.right))
        if value is None:
            return F.lit(False)  # a comparison with NULL is never TRUE
        one = stats.exact(path)
        v = c.right.to_column()
        if one is not None:
            same_kind = v.cast(stats.kind(path)) if stats.kind(path) is not None and not isinstance(value, (int, float)) else v
            return {"<": one < same_kind, "<=": one <= same_kind, ">": one > same_kind, ">=": one >= same_kind, "=": one == same_kind, "!=": one != same_kind}[c.op]
        low, high = stats.minimum(path), stats.maximum(path)
        if low is None or high is None:
            return unknown
        top = v
        if isinstance(stats.kind(path), (T.TimestampType, T.TimestampNTZType)):  # maxima are cut to milliseconds
            v = v.cast(stats.kind(path))
            top = v - F.expr("INTERVAL '0.000999' SECOND")
        rule = {
            "<": low < v, "<=": ~(low > v), ">": high > top, ">=": ~(high < top),
            "=": ~(low > v) & ~(high < top), "!=": (low != v) | (high != top),
        }[c.op]
        if isinstance(stats.kind(path), (T.FloatType, T.DoubleType)):  # NaN is in no minimum or maximum
            rule = F.when(F.isnan(low) | F.isnan(high), unknown).otherwise(rule)
            if c.op in (">", ">=", "!="):
                rule = F.when(rule, rule)  # a NaN row may be above any maximum
        some = null_check(path, False)
        return some & rule

    def null_check(path, is_null: bool) -> Column:
        one = stats.exact(path)
        if one is not None:
            return one.isNull() if is_null else one.isNotNull()
        n = stats.nulls(path)
        if n is None:
            return unknown
        if is_null:
            return n != 0
        rows = stats.rows()
        return n != rows if rows is not None else unknown

    def go(q: Predicate) -> Column:
        match q:
            case And():
                out = F.lit(True)
                for x in q.parts:
                    out = out & go(x)
                return out
            case Or():
                out = F.lit(False)
                for x in q.parts:
                    out = out | go(x)
                return out
            case Compare():
                return leaf(q)
            case IsNull(child=Ref()):
                return null_check(q.child.path, True)
            case Not(child=IsNull(child=Ref())):
                return null_check(q.child.child.path, False)
            case In(needle=Ref()) if not isinstance(q.values, Expr) and stats.exact(q.needle.path) is not None:
                return In(Opaque(lambda: stats.exact(q.needle.path)), q.values).to_column()
            case OpaquePredicate() if q.skipping is not None:
                out = q.skipping(stats)
                return unknown if out is None else out
            case BooleanExpr(child=Literal()):
                return F.lit(q.child.value).cast("boolean")
            case _:
                return unknown

    return go(normal(p))


def always_false(p: Predicate) -> bool:
    """Whether a predicate can be TRUE for no row whatever the columns hold."""

    def value(q: Predicate) -> bool | None:  # None: not known
        match q:
            case And():
                got = [value(x) for x in q.parts]
                return False if False in got else True if all(x is True for x in got) else None
            case Or():
                got = [value(x) for x in q.parts]
                return True if True in got else False if all(x is False for x in got) else None
            case BooleanExpr(child=Literal()):
                return bool(q.child.value)
            case Compare(left=Literal(), right=Literal()):
                a, b = q.left.value, q.right.value
                if q.op in ("distinct", "same"):
                    return (a != b) == (q.op == "distinct")
                if a is None or b is None:
                    return False
                try:
                    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "!=": a != b}[q.op]
                except TypeError:
                    return None
            case Compare(right=Literal(value=None)) if q.op not in ("distinct", "same"):
                return False
            case In() if not isinstance(q.values, Expr) and not [v for v in q.values if v is not None]:
                return False
            case _:
                return None

    return value(normal(p)) is False


__all__ = [n for n in globals() if n[0].isupper() or n in ("col", "lit", "expr", "normal", "skipping_filter", "always_false", "parsed_partition")]
