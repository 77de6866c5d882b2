"""Held-out accuracy and edges of the quality classifier."""

import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from tarn.llm.quality import LEVEL, PIECE, DifferenceScorer, fit_quality, held_out, score_quality
from tarn.llm.queries import op10_quality


def made(n):
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(30, 200))
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            w = [w[0]] * len(w) if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [x + rng.choice(["###", "$$$"]) for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = made(1500)
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "x", "en", "s", 1), (5002, "é" * 300_000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels += [(5000, None, 0), (None, 1, 0), (9999, 0, 0), (3, 7, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op10_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    right = [got[i].predicted == q for i, q, _ in labels[:1500] if got[i].held_out]
    assert len(right) > 300 and sum(right) / len(right) > 0.95
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
    again = {r.doc_id: r.score for r in op10_quality(spark, str(tmp_path)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_held_out_labels_do_not_matter(spark):
    rows, labels = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    assert fit_quality(docs, spark.createDataFrame(labels, schema)) == fit_quality(docs, spark.createDataFrame(flipped, schema))


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "some text", 5.0), (2, None, 5.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, fit_quality(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in score_quality(docs, fit_quality(docs, one)).collect())
    assert score_quality(docs.limit(0), fit_quality(docs, none)).collect() == []


def test_whole_texts_count():
    scorer = DifferenceScorer(b"good words here " * 50, b"BAD!! WORDS!! " * 50)
    start = "good words here " * 1000
    assert scorer.measures(start) != scorer.measures(start + "BAD!! WORDS!! " * 1000)


def test_fold_is_crc32_of_the_decimal_id(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_repeated_ids_count_once(spark):
    rows = [(i, f"{'good clean words' if i % 2 else 'bad spam spam'} {i * 7919} " * 5) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame(rows + rows[:20] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert fit_quality(more, labels) == fit_quality(docs, labels)


def test_scores_by_hand(spark):
    """Ten scores from the model's dictionaries with plain zstandard calls, in pieces, and the logistic of the difference."""
    rows, labels = made(400)
    rows += [(900, "é" * 5000, "en", "s", 1), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}

    def size(content, data):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(data[at : at + PIECE])) for at in range(0, len(data), PIECE))

    for i, text, *_ in [*rows[:8], *rows[-2:]]:
        data = text.encode()
        x = (size(model.bad, data) - size(model.good, data)) / len(data) - model.centre if data else 0.0
        assert abs(got[i] - 1 / (1 + math.exp(-(x * model.weight + model.offset)))) < 1e-9
