"""Chunked encoding against encoding whole texts."""

import gc
import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import bpe
from tarn.llm.bpe import ChunkEncoder, chunks, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["don't", "It's", "été", "éá", "日本語", "  ", "\n\n", "\t", " ", " ", "3rd", "12345", "<|endoftext|>", "<|startoftext|> x", "...", "naïve", "İI", "ΣΑΣ", " ", "　", "́", "a" * 300, "\U0001f600", "The", "quick", "brown", "🏳️‍🌈", "'ll", "—", "\x1c", "\x85", "\u2028", "\xa0x"]


def random_text(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice([" ", " ", " ", "", "\n", "\r\n"]) for _ in range(n))


def test_chunks_are_content_defined():
    rng = random.Random(1)
    shared = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(2000))
    a, b = chunks("x" * 777 + shared), chunks("Something else. " * 9 + shared)
    assert "".join(a) == "x" * 777 + shared
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert chunks("") == [] and chunks("é" * 50_000, most=100)[0].encode() <= "é".encode() * 51


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("mean", [16, 128, 512])
def test_ids_are_those_of_whole_texts(name, mean):
    rng = random.Random(2)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = ChunkEncoder(tokenizer, mean, remember=20_000)
    assert encoder.by_word == (name == "word_bpe_49k.json")
    texts = [random_text(rng, rng.choice([0, 1, 5, 60, 900])) for _ in range(150)]
    texts += ["", "word", " ", "y" * 5000, "z " * 5000, "\n" * 3000, texts[7] + texts[8] + texts[7]]
    for i in range(0, len(texts), 20):
        some = texts[i : i + 20]
        assert encoder.encode_batch(some) == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert encoder.reused > 0
    ids = [encoder.encode_batch([t])[0] for t in texts[:60]]
    assert [encoder.decode(i) for i in ids] == [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_encode_decode(spark):
    rng = random.Random(3)
    rows = [(i, random_text(rng, 120), "n") for i in range(40)] + [(50, None, "n"), (51, "", None), (None, "x", "n"), (51, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = encode_decode(df, PATH, ("n_tokens", "ids_sha256", "decoded_sha256"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert encode_decode(df.limit(0), PATH).collect() == []
    plain = encode_decode(df.where(F.col("doc_id") == 0), PATH).first()
    assert plain.ids == tokenizer.encode(rows[0][1], add_special_tokens=False).ids and plain.decoded == tokenizer.decode(plain.ids, skip_special_tokens=False)


def test_words_one_by_one():
    """Every letter that the short way takes, in both cases and with marks after it, against the tokenizer."""
    tokenizer = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(33, 0x250)]
    words = [a + x + b for x in letters for a, b in (("", ""), ("Ab", ""), ("", "c,"), ("É", "ß!?"), ("x", "́"))] + ["don't", "It's.", "'s", "...", "a.b", "ΣΑΣ", "ﬁn", "Ab..,"]
    encoder = ChunkEncoder(tokenizer)
    for w in words:
        assert encoder.encode_batch([w]) == [tokenizer.encode(w, add_special_tokens=False).ids], w


@pytest.mark.parametrize("collecting", [True, False])
def test_no_collection_inside_a_batch(collecting):
    """Collections walk all remembered words: a batch makes none, and whether they run at all is as before it."""
    rng = random.Random(4)
    encoder, runs = ChunkEncoder(Tokenizer.from_file(PATH)), []
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(400)) for _ in range(40)]
    note = lambda phase, info: runs.append((gc.isenabled(), phase))
    was = gc.isenabled()
    (gc.enable if collecting else gc.disable)()
    gc.callbacks.append(note)
    try:
        encoder._encode_batch(texts)
        unpaused, runs[:] = len(runs), []
        encoder.words, encoder.young = {}, {}
        encoder.encode_batch(texts)
        inside = len(runs)
    finally:
        gc.callbacks.remove(note)
        now = gc.isenabled()
        (gc.enable if was else gc.disable)()
    assert now == collecting and (unpaused > 2) == collecting and inside <= 2
    assert all(type(ids) is tuple for ids in encoder.words.values())


def test_decimals_of_any_id():
    assert bpe._decimals([]) == "" and bpe._decimals([0, 7, 262143, 262144, 10**7]) == "0 7 262143 262144 10000000"
