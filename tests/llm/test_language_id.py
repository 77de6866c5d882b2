"""Language identification: fusion against plain arithmetic, held-out accuracy and edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm.language_id import MOST, OTHER, SHARE, TextModel, _trigrams, address_host, address_suffix, identify_languages, markup_language, train_text_model

WORDS = {"en": "the and of to in that it with for was on are by this thing other".split(), "fr": "le la les de des et que qui dans pour sur être après avec une où".split(), "de": "der die das und nicht mit für auf ist eine über ich wir schön auch noch".split()}


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang, f"src{i % 3}"))
    return rows


def test_held_out_accuracy_and_junk(spark):
    train = spark.createDataFrame(made(900), "doc_id long, text string, lang string, source string")
    rng = random.Random(5)
    test = made(300, 2) + [(1000 + i, "".join(rng.choices("qxzjkvwbpYQ0123", k=300)), "und", "src0") for i in range(20)]
    model = train_text_model(train, sample=200)
    assert model.languages == ("de", "en", "fr", OTHER)
    got = identify_languages(spark.createDataFrame(test, train.schema), model, "doc_id", F.col("text"), host=F.col("source"))
    found = {r.doc_id: r for r in got.collect()}
    assert sum(found[i].lang == lang for i, _, lang, _ in test) >= 315
    assert all(found[i].kept == (found[i].lang != OTHER) for i, *_ in test)
    assert all(found[i].kept for i, *_ in test[:300])


def test_fusion_is_bayes(spark):
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.ones(1 << 16) * 0.05, 3) + 1e-9).T.astype(np.float32)
    model = TextModel(("aa", "bb", OTHER), table)
    rows = [(i, "".join(rng.choice(list("abc "), 12)), [None, "x.com", "y.com", "z.de"][i % 4], ["aa", "bb", "qq", None][i // 4 % 4]) for i in range(60)]
    rows += [(100, None, "x.com", "bb"), (101, "", None, None), (102, "123", "new.fr", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string")
    got = {r.doc_id: r for r in identify_languages(df, model, "doc_id", F.col("text"), F.col("host"), address_suffix(F.col("host")), F.col("said")).collect()}

    def ll(t):
        codes = np.concatenate(list(_trigrams(t)) or [np.zeros(0, np.uint32)])
        n = len(codes)
        return table[codes].sum(0, dtype=np.float64) * (min(SHARE * n, MOST) / n) if n else np.zeros(3)

    def norm(w):
        w = np.exp(w - w.max())
        return w / w.sum()

    own = {i: norm(ll(t) + np.log([0.49, 0.49, 0.02])) for i, t, _, _ in rows}
    tld = {None: None, "x.com": "com", "y.com": "com", "z.de": "de", "new.fr": "fr"}
    for i, t, host, said in rows:
        def blend(members, below):
            c = np.maximum(sum((own[j] for j in members), np.zeros(3)) - own[i], 0)
            return (c + 20 * below) / (c.sum() + 20)

        p = blend([r[0] for r in rows], np.ones(3) / 3)
        if tld[host]:
            p = blend([r[0] for r in rows if tld[r[2]] == tld[host]], p)
        if host:
            p = blend([r[0] for r in rows if r[2] == host], p)
        w = ll(t) + np.log(p)
        if said in ("aa", "bb"):
            w = w + np.array([math.log(0.85) if x == said else math.log(0.075) for x in model.languages])
        w = norm(w)
        assert got[i].probability == pytest.approx(w.max(), abs=1e-6) and got[i].lang == model.languages[int(w.argmax())]


def test_evidence_from_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="fr-CA"><head>'
    df = spark.createDataFrame([(html, "https://u:p@m.Example.co.uk:80/a?b#c"), ("<p lang='de'>", "nonsense"), (None, None)], "html string, url string")
    got = df.select(markup_language(F.col("html")), address_host(F.col("url")), address_suffix(address_host(F.col("url")))).collect()
    assert [tuple(r) for r in got] == [("fr", "m.example.co.uk", "uk"), (None, None, None), (None, None, None)]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, ll int, _host string, kept string"
    empty = spark.createDataFrame([], schema)
    model = train_text_model(empty)
    assert model.languages == (OTHER,)
    assert identify_languages(empty, model, "doc_id", F.col("text"), F.col("source")).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, 1, "a", "b"), (1, None, None, None, 1, "a", "b"), (None, "x" * 3_000_000, "en", "s", 1, "a", "b")], schema)
    assert identify_languages(odd, train_text_model(odd), "doc_id", F.col("text"), F.col("source"), keep=("ll",)).count() == 3


def test_query_covers_pages(spark, tmp_path):
    from tarn.llm.queries import op7_language_id

    spark.createDataFrame(made(60), "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    body = lambda lang: f'<html lang="{lang}"><script>the of and</script><p>{" ".join(WORDS[lang] * 3)}</p></html>'
    pages = [(i, f"http://a.example.{lang}/", body(lang)) for i, lang in enumerate(WORDS)] + [(9, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_language_id(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.table == "documents") == list(range(60))
    found = {r.page_id: r.lang for r in got if r.table == "pages"}
    assert set(found) == {0, 1, 2, 9} and [found[i] for i in range(3)] == list(WORDS)


def test_all_labels_are_learnt(spark, monkeypatch):
    rows = [(i, f"w{chr(97 + i % 9)}{chr(97 + i // 9)} text", f"l{i:03}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_text_model(df)
    assert model.languages == (*sorted(r[2] for r in rows), OTHER) and model.table.shape == (1 << 16, 81)
    monkeypatch.setattr("tarn.llm.language_id.CELLS", 81 << 12)
    small = train_text_model(df)
    assert small.table.shape == (1 << 12, 81) and small.likelihoods("waa text").argmax() == 0
