"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import durable

#: The language of text that fits none: its trigrams are spread evenly.
OTHER = "und"
BUCKETS = 1 << 16
#: Numbers in a table at most: with more languages than fit, each has fewer buckets.
CELLS = 1 << 25
BLOCK = 1 << 20
#: What ``TextModel`` takes for ``share`` and ``most`` unless told otherwise.
SHARE, MOST = 0.3, 400.0
# All letters of ASCII lower case and all bytes of longer characters stay; everything else becomes a space.
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte trigrams of the lower-cased whole text, block by block."""
    data = b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" "
    for start in range(0, max(len(data) - 2, 0), BLOCK):
        raw = np.frombuffer(data[start : start + BLOCK + 2], np.uint8).astype(np.uint32)
        code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        blank = np.uint32(0x20)
        # A trigram of two spaces or more says nothing.
        spaces = (raw[:-2] == blank).astype(np.uint8) + (raw[1:-1] == blank) + (raw[2:] == blank)
        code = code[spaces < 2]
        yield (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """log P(trigram | language), one row for each language; the last language is ``OTHER``.

    Neighbouring trigrams share letters, so each counts as ``share`` of an independent one, and no text counts as more
    than ``most`` independent ones: every trigram of a long text has its part in the mean, and what else is known about
    the document is never drowned.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    share: float = SHARE
    most: float = MOST

    def likelihoods(self, text: str | None) -> np.ndarray:
        """Log-likelihoods of the whole text, scaled for dependence and bounded."""
        total, n = np.zeros(len(self.languages)), 0
        for codes in _trigrams(text):
            total += self.table[codes % np.uint32(len(self.table))].sum(0, dtype=np.float64)
            n += len(codes)
        return total * (min(self.share * n, self.most) / n) if n else total


def train_text_model(
    docs: DataFrame, sample: int = 400, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = SHARE, most: float = MOST
) -> TextModel:
    """Train on a bounded sample of labelled rows: about ``sample`` documents of each label.

    Rows are chosen by hashes of id and text against a share computed from each label's count, in one scan, four times
    ``sample`` for each label at most, the least hashes first.  ``share`` and ``most`` are the model's bounds on evidence.
    All labels are learnt; the table is bounded by
    its buckets, which are halved until it fits ``CELLS``.  NULL labels and NULL texts train nothing.  Without any labelled text ``OTHER`` is the only language.
    """
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = some.groupBy(lang_col).count().collect()
    names = tuple(sorted(r[0] for r in counts))
    buckets = BUCKETS
    while buckets > 256 and (len(names) + 1) * buckets > CELLS:
        buckets //= 2
    model = np.full((len(names), buckets), smoothing)
    if names:
        at = {x: i for i, x in enumerate(names)}
        part = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, sample / r[1]))]), F.col(lang_col))
        place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language"))
        chosen = some.where(F.pmod(place, F.lit(1 << 20)) / float(1 << 20) < part).select(lang_col, text_col, place.alias("_place"))
        chosen = chosen.orderBy(F.pmod("_place", F.lit(1 << 20)), "_place").limit(4 * sample * len(names))
        for r in chosen.toLocalIterator():
            row = model[at[r[0]]]
            for codes in _trigrams(r[1]):
                row += np.bincount(codes % np.uint32(buckets), minlength=buckets)
    table = np.log(model / model.sum(1, keepdims=True)) if names else np.zeros((0, buckets))
    # Text that fits a language gains several nats a trigram over an even spread of the 40,000 that occur or so.
    even = np.full((1, buckets), -np.log(float(buckets)))
    return TextModel((*names, OTHER), np.ascontiguousarray(np.concatenate([table, even]).T, dtype=np.float32), share, most)


def text_likelihoods(docs: DataFrame, model: TextModel, text: Column, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` and ``ll`` (array of double, by language), in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 numbers
    slim = docs.select(text.alias("_text"), F.struct(*keep).alias("_keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            ll = [m.likelihoods(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ll, pa.list_(pa.float64()))], names=["_keep", "ll"])

    schema = slim.schema["_keep"].dataType.simpleString()
    return slim.mapInArrow(run, f"_keep {schema}, ll array<double>").select("_keep.*", "ll")


def normalised(log_weights: Column) -> Column:
    """exp of an array of log weights, made to sum to 1."""
    top = F.array_max(log_weights)
    up = F.transform(log_weights, lambda x: F.exp(x - top))
    total = F.aggregate(up, F.lit(0.0), lambda a, x: a + x)
    return F.transform(up, lambda x: x / total)


def markup_language(html: Column) -> Column:
    """The primary subtag that the html element declares, lower case; NULL without one."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]{0,400}?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def markup_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments, tags and character references."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*+>|&#?[a-z0-9]{1,32};", " ")


def address_host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def address_suffix(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def identify_languages(
    docs: DataFrame, model: TextModel, id_col: str, text: Column, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None,
    mass: float = 20.0, trust: float = 0.85, other_prior: float = 0.02, keep: tuple[str, ...] = (), prefix: str = "",
) -> DataFrame:
    """Posterior language of every document.

    log P(language | all) = log-likelihood of the whole text + log P(declared | language) + log P(language | host) + c.
    The priors are hierarchical: soft language counts of each host, from the text alone, are summed by grouped
    aggregation; a host's prior is its counts and ``mass`` counts of its address suffix's prior, which is its counts
    and ``mass`` of the whole table's, which is smoothed towards even.  A document's own count is taken out of all of
    them, so it is never evidence for itself.  Declared markup is right with probability ``trust``.

    Returns id, lang, probability, kept (their names after ``prefix``) and ``keep``; kept is false where ``OTHER`` is the
    likeliest.  Where ``keep`` has a name of these, the computed column wins.
    NULL host, suffix or declaration: that evidence is left out (the prior is the next level's).  NULL, empty and
    letterless texts have no text evidence and take the prior's language.  Hosts of any size: counts are combined
    before the shuffle and the planner splits or broadcasts the join.  Ties go to the first language in code-point
    order.  Repeated rows are rows; an empty table gives an empty table.
    """
    languages, n = list(model.languages), len(model.languages)
    nothing = F.lit(None).cast("string")
    made = {f"{prefix}{c}" for c in ("lang", "probability", "kept")} | {id_col}
    kept = [c for c in keep if c not in made]
    columns = [F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], *[(c if c is not None else nothing).cast("string").alias(a) for c, a in ((host, "_host"), (suffix, "_suffix"), (declared, "_declared"))]]
    seen = durable(text_likelihoods(docs, model, text, columns), "language")
    prior0 = F.array(*[F.lit(float(np.log(other_prior if x == OTHER else (1 - other_prior) / max(n - 1, 1)))) for x in languages])
    own = normalised(F.zip_with("ll", prior0, lambda a, b: a + b))
    soft = seen.withColumn("_own", own)

    def counts(keys: list[str], name: str) -> DataFrame:
        sums = F.array(*[F.sum(F.col("_own")[i]) for i in range(n)])
        return soft.groupBy(*keys).agg(sums.alias(name))

    by_host = durable(counts(["_host", "_suffix"], "_h"), "language")
    total = F.array(*[F.sum(F.col("_h")[i]) for i in range(n)])
    by_suffix = durable(by_host.groupBy("_suffix").agg(total.alias("_s")), "language")
    everything = by_suffix.agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(n)]).alias("_g")).first()[0]
    if everything[0] is None:
        everything = [0.0] * n
    levels = by_host.join(by_suffix, by_host["_suffix"].eqNullSafe(by_suffix["_suffix"])).select(by_host["_host"].alias("_host2"), by_host["_suffix"].alias("_suffix2"), "_h", "_s")
    levels = durable(levels, "language")
    joined = soft.join(levels, soft["_host"].eqNullSafe(F.col("_host2")) & soft["_suffix"].eqNullSafe(F.col("_suffix2")), "left")

    def blended(counts: Column, below: Column) -> Column:
        less = F.zip_with(counts, "_own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(less, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(less, below, lambda a, b: (a + mass * b) / (size + mass))

    even = F.array(*[F.lit(1.0 / n)] * n)
    prior = blended(F.array(*[F.lit(float(x)) for x in everything]), even)
    prior = F.when(F.col("_suffix").isNull(), prior).otherwise(blended(F.col("_s"), prior))
    joined = joined.withColumn("_prior", prior)
    host_prior = F.when(F.col("_host").isNull(), F.col("_prior")).otherwise(blended(F.col("_h"), F.col("_prior")))
    names = F.array(*[F.lit(x) for x in languages])
    # A declaration in a language that the model doesn't know says nothing.
    said = F.transform(names, lambda x: F.when(F.col("_declared") == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log((1 - trust) / max(n - 1, 1))))))
    said = F.when(F.array_contains(names, F.coalesce("_declared", F.lit(""))), said).otherwise(F.array(*[F.lit(0.0)] * n))
    weight = F.zip_with(F.zip_with("ll", F.transform(host_prior, lambda x: F.log(F.greatest(x, F.lit(1e-12)))), lambda a, b: a + b), said, lambda a, b: a + b)
    best = joined.withColumn("_p", normalised(weight)).withColumn("_at", F.array_position("_p", F.array_max("_p")).cast("int"))
    lang = F.element_at(names, F.col("_at"))
    return best.select(
        F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)],
        lang.alias(f"{prefix}lang"), F.array_max("_p").alias(f"{prefix}probability"), (lang != OTHER).alias(f"{prefix}kept"),
    )
