"""Quality classifier by compression with dictionaries of good and bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are compressed at once: few, so that a text can't teach the compressor itself and the dictionary
#: alone tells how small it gets.
PIECE = 256
DICTIONARY = 448 << 10
LEVEL = 15


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` on division by ``folds``.  A NULL id has no remainder; it is held
    out, since no label can be told to belong to it."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(True))


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the logistic calibration of the difference: its centre, weight and an offset."""

    good: bytes
    bad: bytes
    centre: float = 0.0
    weight: float = 0.0
    offset: float = 0.0

    def scorer(self) -> DifferenceScorer:
        return DifferenceScorer(self.good, self.bad)

    def probability(self, measures: np.ndarray) -> np.ndarray:
        """Scores of differences; NaN (an empty text) is undecided and takes the centre."""
        x = np.where(np.isnan(measures), 0.0, measures - self.centre)
        return 1 / (1 + np.exp(-np.clip(x * self.weight + self.offset, -30, 30)))


class DifferenceScorer:
    """Compresses texts piece by piece with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if made is None:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            made.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def measures(self, text: str | None) -> float:
        """The normalised difference over the whole text: the compressed size with the bad dictionary less that with the
        good one, by the text's bytes.  NaN for an empty text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return (bad - good) / len(data) if data else math.nan


def build_dictionary(texts: Sequence[str], size: int = DICTIONARY) -> bytes:
    """A dictionary of ``size`` bytes: equal shares of the texts, taken at even distances, so that all of them are in it."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    if not data:
        return b""
    share = max(64, size // len(data))
    parts = []
    for d in data:
        step = max(1, math.ceil(len(d) / share))
        block = 256
        if len(d) <= share:
            parts.append(d)
        else:
            starts = range(0, len(d), step * block)
            parts.append(b"".join(d[s : s + block] for s in starts)[:share])
    return b"".join(parts)[-size:]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression on one measure by Newton's method: its centre and weight, and the offset."""
    centre, spread = x.mean(), x.std() or 1.0
    z, w = np.c_[(x - centre) / spread, np.ones(len(x))], np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(centre), float(w[0] / spread), float(w[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample: int = 600, sample_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> QualityModel:
    """Fit on a bounded sample of labelled rows that aren't held out.

    ``sample`` rows of each label at most, those with the least hashes of their ids, and ``sample_bytes`` of text of each
    label at most reach the driver; a text of more than an eighth of that isn't fitted on.  Half of each label's rows make its dictionary; the other half calibrate.
    The offset is moved to the labels' shares among all labelled rows, so scores follow the true mix.
    Labels other than 0 and 1, NULL labels, NULL ids and labelled rows without a document are left out.  With no
    usable rows of either label, every score is one half (or the share of the only label there is, by the prior).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    totals = {r._label: r.n for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return QualityModel(b"", b"")
    place = F.xxhash64(F.col("_id"), F.lit("quality"))
    picks = [known.where(F.col("_label") == y).orderBy(place, "_id").limit(sample) for y in totals]
    chosen = picks[0] if len(picks) == 1 else picks[0].unionByName(picks[1])
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select("_id", "_label", F.col(text_col).alias("_text"), place.alias("_place"))
    size = F.octet_length(F.coalesce("_text", F.lit("")))
    rows = rows.where(size <= sample_bytes // 8)  # one text is an eighth of the bound at most
    rows = rows.groupBy("_id", "_label", "_place").agg(F.min("_text").alias("_text"))  # one row for each id
    first, second, used = {0: [], 1: []}, {0: [], 1: []}, {0: 0, 1: 0}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r._place, r._id)):
        n = len((r._text or "").encode("utf-8", "surrogatepass"))
        if used[r._label] + n <= sample_bytes:
            used[r._label] += n
            (first if len(first[r._label]) <= len(second[r._label]) else second)[r._label].append(r._text or "")
    good, bad = build_dictionary(first[1]), build_dictionary(first[0])
    if not good or not bad:
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return QualityModel(b"", b"", offset=math.log(prior / (1 - prior)))
    measure = DifferenceScorer(good, bad)
    x = np.array([measure.measures(t) for y in (0, 1) for t in second[y]], float)
    y = np.array([label for label in (0, 1) for _ in second[label]], float)
    x, y = x[~np.isnan(x)], y[~np.isnan(x)]
    if not 0 < y.sum() < len(y):
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return QualityModel(good, bad, offset=math.log(prior / (1 - prior)))
    centre, weight, offset = calibrate(x, y)
    share = math.log((totals[1] / totals[0]) / (y.sum() / (len(y) - y.sum())))
    return QualityModel(good, bad, centre, weight, offset + share)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that a text is good, from its whole text alone, in one pass without a shuffle.

    NULL and empty texts have the score of an undecided text.  Repeated rows get equal scores; an
    empty table gives an empty table; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = m.scorer()
        for b in batches:
            x = np.array([scorer.measures(t.as_py()) for t in b.column(1)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.probability(x))], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, score double")
