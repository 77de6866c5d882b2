"""SimHash near-duplicates through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import components, durable

SEED, WIDTH, RADIUS = 42, 3, 3
#: The 64 bits in three segments (start, length), each at most as long as a word of the binary Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the perfect binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BLOCK = 1 << 20  # bytes of a text that are cut into words at once
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
_AT = np.arange(8) * 256


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block, so that memory doesn't grow with the text."""
    start = 0
    while len(data) - start > BLOCK:
        end = start + BLOCK
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text: majority of the bits of the hashes of its 3-word shingles.

    ASCII capitals are lowered; words end at ASCII white space only.  Fewer words make one shingle, none the fingerprint 0.
    """
    counts, n, carry = np.zeros(2048, np.int64), 0, []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= WIDTH:
            hashes = np.fromiter((xxhash.xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)), "<u8", len(words) - WIDTH + 1)
            counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=2048)
            n += len(hashes)
            carry = words[1 - WIDTH :]
        else:
            carry = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits((counts.reshape(8, 256) @ _BITS).ravel() * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash): fp is the fingerprint as a signed long.  One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64)), b.column(2)], names=[id_col, "fp", "text_hash"])

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col).alias("text_hash"))
    return slim.mapInArrow(run, f"`{id_col}` long, fp long, text_hash long")


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes of the code: the only error of weight 3 or less, and its weight."""
    error, weight = np.zeros(2048, np.uint32), np.zeros(2048, np.uint8)
    for w in range(1, RADIUS + 1):
        for places in combinations(range(23), w):
            e = np.uint32(sum(1 << p for p in places))
            s = int(_syndrome(np.array([e]))[0])
            error[s], weight[s] = e, w
    return error, weight


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial."""
    x = x.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where((x >> np.uint32(bit)) & np.uint32(1), x ^ np.uint32(GENERATOR << (bit - 11)), x)
    return x


def _index(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word: the code is perfect, so there is one within 3 bits."""
    return (x ^ _cosets()[0][_syndrome(x)]) >> np.uint32(11)


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index of each segment, and in (row, index) form all indices of words that differ from it in one bit or none.

    A word at 2 bits or less from its codeword has that one index; a word at 3 bits has six.  So two segments that
    differ in one bit at most share the index of either among the indices of the other.
    """
    x = segment.astype(np.uint32)
    own = _index(x)
    far = np.flatnonzero(_cosets()[1][_syndrome(x)] == RADIUS)
    near = np.stack([_index(x[far] ^ np.uint32(1 << b)) for b in range(23)], 1) if len(far) else np.zeros((0, 23), np.uint32)
    rows = np.concatenate([np.arange(len(x)), np.repeat(far, 23)])
    both = np.unique(rows.astype(np.uint64) << np.uint64(12) | np.concatenate([own, near.ravel()]).astype(np.uint64))
    return own, (both >> np.uint64(12)).astype(np.int64), (both & np.uint64(4095)).astype(np.uint32)


def _bucket_rows(probe: bool):
    """Rows (key, fp) of one side: key = which two segments, with their codeword indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                sides = []
                for at, n in SEGMENTS:
                    own, rows, more = golay_keys((fps >> np.uint64(at)) & np.uint64((1 << n) - 1))
                    sides.append((rows, more) if probe else (np.arange(len(fps)), own))
                keys, who = [], []
                for k, (i, j) in enumerate(combinations(range(3), 2)):
                    (ri, ki), (rj, kj) = sides[i], sides[j]
                    # Pair every index of one segment with every index of the other, row by row.
                    n_j, first = np.bincount(rj, minlength=len(fps)), np.searchsorted(rj, np.arange(len(fps)))
                    times = n_j[ri]
                    left = np.repeat(np.arange(len(ri)), times)
                    right = first[ri][left] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                    keys.append((k << 24 | ki[left].astype(np.int64) << 12 | kj[right]).astype(np.int32))
                    who.append(fps.view(np.int64)[ri[left]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(who))], names=["key", "fp"])

    return run


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints ``fp`` that differ in 1 to 3 bits.

    Three errors over three segments leave two segments with one error at most, whichever bits differ.  Every
    fingerprint is indexed under the three pairs of its segments' codeword indices and probes the pairs of all nearby
    indices; a join on the 24-bit keys gives candidates and the bit count verifies them.
    """
    put = fps.mapInArrow(_bucket_rows(False), "key int, fp long").withColumnRenamed("fp", "b")
    ask = fps.mapInArrow(_bucket_rows(True), "key int, fp long").withColumnRenamed("fp", "a")
    found = ask.join(put, "key").where((F.col("a") != F.col("b")) & (_distance("a", "b") <= RADIUS))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (id, fingerprint as 16 hex digits, component_id).

    Documents link where fingerprints differ in 3 bits or fewer; component_id is the least id reachable.  Copies share
    a fingerprint, so a group of any number of copies is one node of the graph.  Fingerprints and the links between
    distinct ones are written to the shared folder.
    NULL, empty and blank texts have the fingerprint 0, linked as any other.  Repeated rows keep their number.  Rows
    whose id is NULL are returned and link others, but never name a component unless they are alone in it (NULL
    then).  Empty tables give an empty table; other columns are ignored.
    """
    return _rooted(docs, id_col, text_col).select(id_col, "fingerprint", "component_id")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``simhash_groups``, with ``root``, a fingerprint that names the group whatever its ids are, and ``text_hash``."""
    prints = durable(with_fingerprints(docs, id_col, text_col), "simhash")
    nodes = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash")
    roots = durable(components(durable(fingerprint_links(nodes.select("fp")), "simhash"), "simhash"), "simhash")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(names, "root").select("fp", "component_id", "root"), "simhash")
    return prints.join(named, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root"
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate group: that of the least id, then of the least hash of its text.

    Rows without an id come last in a group.  Rows that repeat id and text are one document, of which one row stays.
    """
    groups = _rooted(docs, id_col, text_col)
    times = groups.groupBy("root", F.coalesce(F.col(id_col), F.lit(0)).alias("_g_at"), F.col(id_col).isNull().alias("_g_none"), "text_hash").agg(F.count(F.lit(1)).alias("_g_times"))
    first = times.groupBy("root").agg(F.min(F.struct("_g_none", "_g_at", "text_hash", "_g_times")).alias("_f"))
    stay = durable(first.select("_f._g_none", "_f._g_at", F.col("_f.text_hash").alias("_g_hash"), "_f._g_times"), "simhash")
    own = docs.withColumns({"_g_at": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_g_none": F.col(id_col).isNull(), "_g_hash": F.xxhash64(text_col)})
    kept = own.join(stay, ["_g_none", "_g_at", "_g_hash"])
    # Only documents that are there more than once are shuffled to find their one row.
    once = kept.where("_g_times = 1")
    again = kept.where("_g_times > 1").dropDuplicates(["_g_none", "_g_at", "_g_hash"])
    return once.unionByName(again).select(*docs.columns)
