"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import durable, running_total

#: Fixed pattern: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights are summed in units of 1 / UNITS.
UNITS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ramped(rank: Column, swing: float = 0.5) -> Column:
    """The default curriculum: the source of rank r has mean weight 1 + r mod 3; even ranks rise over training and odd ranks fall.

    Knots (t, w) of a piecewise-linear weight over training time 0 to 1.
    """
    mean = (rank % 3 + 1).cast("double")
    by = F.when(rank % 2 == 0, F.lit(swing)).otherwise(F.lit(-swing))
    knot = lambda t, w: F.struct(F.lit(t).cast("double").alias("t"), w.alias("w"))
    return F.array(knot(0.0, mean * (1 - by)), knot(0.5, mean), knot(1.0, mean * (1 + by)))


def source_targets(sized: DataFrame, schedule: Callable[[Column], Column] = ramped, max_epochs: float = 3.0) -> DataFrame:
    """Targets of all sources: (_key, rank, source_size, target, pieces, area).

    ``sized`` has ``_key`` (the source in code-point order) and ``size``.  A source's weight is the integral of its
    schedule.  The mix has as many words as the input; a source's target stops at ``max_epochs`` times its size, and
    what exceeds that is shared again by weight until no source is above: target = min(max_epochs * size, level *
    weight), where the level is found from prefix sums over the sources sorted by the level at which each fills up.
    Ranking and prefix sums are distributed, so the number of sources is not limited.
    """
    totals = sized.groupBy("_key").agg(F.sum("size").alias("source_size"))
    ranked = running_total(totals, [F.col("_key")], ["source_size"], "mix")
    budget = F.col("source_size_total").alias("_budget")
    ranked = ranked.select("_key", "source_size", budget, F.col("row_before").alias("rank"), schedule(F.col("row_before")).alias("_knots"))
    # One trapezoid for each pair of neighbouring knots, with the area before it.
    n = F.size("_knots") - 1
    flat = F.zip_with(
        F.slice("_knots", F.lit(1), n), F.slice("_knots", F.lit(2), n),
        lambda p, q: F.struct(p["t"].alias("t0"), q["t"].alias("t1"), p["w"].alias("w0"), q["w"].alias("w1")),
    )
    area = lambda x: (x["t1"] - x["t0"]) * (x["w0"] + x["w1"]) / 2
    pieces = F.transform(
        "_flat",
        lambda x, i: F.struct(x["t0"].alias("t0"), x["t1"].alias("t1"), x["w0"].alias("w0"), x["w1"].alias("w1"),
                              F.aggregate(F.slice("_flat", F.lit(1), i), F.lit(0.0), lambda a, y: a + area(y)).alias("a0")),
    )
    ranked = (
        ranked.withColumn("_flat", flat)
        .withColumn("pieces", pieces)
        .withColumn("area", F.aggregate("_flat", F.lit(0.0), lambda a, y: a + area(y)))
        .withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("_fill", F.when(F.col("area") > 0, F.try_divide("_cap", "area")).otherwise(F.lit(float("inf"))))
        .withColumn("_unit", F.round(F.col("area") * UNITS).cast("long"))  # whole units, so that sums are exact
        .drop("_flat", "_knots")
    )
    # Prefix sums in the order in which sources fill up.
    full = running_total(ranked, [F.col("_fill"), F.col("_key")], ["source_size", "_unit"], "mix")
    full = durable(full, "mix")
    filled = F.lit(max_epochs) * F.col("source_size_before")
    rest = (F.col("_unit_total") - F.col("_unit_before")) / float(UNITS)
    met = full.where((rest > 0) & (filled + F.least(F.col("_fill"), F.lit(1e300)) * rest >= F.col("_budget")))
    found = met.agg(F.min_by((F.col("_budget") - filled) / rest, F.struct("_fill", "_key"))).first()[0]  # one number
    level = F.lit(found).cast("double")
    return full.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("area")), F.lit(0.0))).select(
        "_key", "rank", "source_size", "target", "pieces", "area"
    )


def position(share: Column, pieces: Column, area: Column) -> Column:
    """The training time in 0 to 1 at which a source has had ``share`` of its demand: the inverse of its integrated weight."""
    at = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * area

    def inside(x: Column) -> Column:
        slope = (x["w1"] - x["w0"]) / (x["t1"] - x["t0"])
        need = at - x["a0"]
        root = F.sqrt(F.greatest(x["w0"] * x["w0"] + 2 * slope * need, F.lit(0.0)))
        below = x["w0"] + root
        return F.least(x["t1"], x["t0"] + F.when(below > 0, 2 * need / below).otherwise(F.lit(0.0)))

    return inside(F.element_at(F.filter(pieces, lambda x: x["a0"] <= at), -1))


def mix_sources(
    docs: DataFrame, schedule: Callable[[Column], Column] = ramped, max_epochs: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decide how often and when training takes each document.

    Each source streams its documents in an order fixed by hashes, again from the start when it ends, until its
    target is met: every document is taken ``floor(target / source_size)`` times, and once more where the middle of
    its words lies in what is left.  A copy's place in its source's stream is a share of that source's demand; the
    inverse of the integrated schedule turns it into a training position.

    Returns one row per document: id, size, source_size, target, copies (int), taken (words), positions (array of
    double, one for each copy) and the columns in ``keep``.  Same input, same result, whatever the partitioning.
    NULL texts have size 0; the NULL source is a source, last in order; sources without words have target 0, and the
    documents without words of other sources are taken or left by place as all others.  Repeated rows count each.  An
    empty table gives an empty table.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source_col)))
    place = F.xxhash64(F.coalesce(F.col(id_col), F.lit(-1)), F.xxhash64(text_col))
    slim = docs.select(F.col(id_col), *keep, key.alias("_key"), word_count(F.col(text_col)).alias("size"), place.alias("_place"))
    order = [F.col("_key"), F.col("_place"), F.col(id_col), F.col("size")]
    summed = durable(running_total(slim, order, ["size"], "mix").drop("size_total", "n_rows", "row_before"), "mix")
    begins = summed.groupBy("_key").agg(F.min("size_before").alias("_start"))
    sources = durable(source_targets(summed, schedule, max_epochs).join(begins, "_key"), "mix")
    joined = summed.join(sources, "_key")  # the planner broadcasts sources if the written table is small; else a skew-split join
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(ratio)
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("size_before") - F.col("_start") + F.col("size") / 2
    copies = (whole + (middle < rest).cast("int")).cast("int")
    shares = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: position(F.try_divide(c * F.col("source_size") + F.col("_middle"), F.col("target")), F.col("pieces"), F.col("area")))
    return (
        joined.withColumn("copies", copies)
        .withColumn("_middle", middle)
        .select(
            id_col, *keep, "size", "source_size", F.col("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
            F.when(F.col("copies") > 0, shares).otherwise(F.array().cast("array<double>")).alias("positions"),
        )
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, range-sorted by ``position``; no single task sorts everything."""
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return copies.repartitionByRange("position").sortWithinPartitions("position")
