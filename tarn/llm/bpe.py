"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8  # bytes that the rolling hash sees
WORDS = 400_000  # words whose ids a worker remembers
#: The start of a run of white space: no tokenizer rule joins characters across it from the left.
RUN = re.compile(r"(?<!\s)[ \t\n\r]")


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte, from a linear congruential generator."""
    out, x = np.empty(256, np.uint32), 1
    for i in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out[i] = x >> 32
    return out


_GEAR = _gear()


def chunks(text: str, mean: int = 1024, least: int = 64, most: int = 8192) -> list[str]:
    """Cut a text where a rolling hash of the last ``WINDOW`` bytes has its low bits at zero.

    Cuts depend on nearby content alone, so a passage that documents share is cut alike in each, whatever precedes it.
    ``least`` and ``most`` bound the bytes of a chunk (the last one may be shorter); cuts never split a character.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= least:
        return [text] if text else []
    raw = np.frombuffer(data, np.uint8)
    mapped, h = _GEAR[raw], np.zeros(len(raw), np.uint32)
    for j in range(WINDOW):
        h[j:] += mapped[: len(raw) - j] << np.uint32(j * 4)
    marks = np.flatnonzero(((h * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(mean) == 0) + 1
    out, start, at = [], 0, 0
    while len(data) - start > least:
        at = int(np.searchsorted(marks, max(start + least, 1)))
        end = min(int(marks[at]) if at < len(marks) else len(data), start + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[start:end].decode("utf-8", "surrogatepass"))
        start = end
    if start < len(data):
        out.append(data[start:].decode("utf-8", "surrogatepass"))
    return out


def _byte_map() -> dict[int, str]:
    """Byte-level models spell each byte as a printable character: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Fixed value: the pattern of word tokenizers whose words need no context (contractions, letters, single digits, marks).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_MAP = _byte_map()
ENDS = ".,;:!?"


def separable(tokenizer) -> bool:
    """Whether this is a tokenizer of the kind for which a text's ids are those of its words: white space is dropped,
    the pattern is ``WORD_PATTERN``, text is lower-cased and spelled in bytes, and no added token has white space."""
    config = json.loads(tokenizer.to_str())
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = (config.get("normalizer") or {}).get("normalizers", [])
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and not any(t["lstrip"] or t["rstrip"] or t["content"].isalpha() or any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
        and config.get("post_processor") is None
    )


class ChunkEncoder:
    """Encodes texts chunk by chunk with any ``tokenizers`` tokenizer, each distinct chunk once while it is remembered.

    ``remember`` bounds the characters kept; what has not been used lately goes first.
    """

    def __init__(self, tokenizer, mean: int = 1024, remember: int = 16_000_000):
        self.tokenizer, self.mean, self.remember = tokenizer, mean, remember
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.size = 0
        # Tuples of numbers, unlike lists, aren't walked by the garbage collector each time that many more have been made.
        self.words: dict[str, tuple[int, ...]] = {}
        self.by_word, self.model = separable(tokenizer), tokenizer.model
        # Without a decoder of its own, a tokenizer joins its tokens by spaces.
        plain = tokenizer.decoder is None
        self.spelled = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())] if plain else None
        if plain and "" in self.spelled:
            self.spelled = None
        self.encoded = self.reused = self.merged = 0

    def _learn(self, pieces: Sequence[str]) -> None:
        new = []
        for p in dict.fromkeys(pieces):
            if p in self.young:
                self.reused += 1
            elif (ids := self.old.get(p)) is not None:
                self.young[p] = ids
                self.size += len(p)
                self.reused += 1
            else:
                new.append(p)
        if new:
            self.encoded += len(new)
            for p, ids in zip(new, self._encode(new), strict=True):
                self.young[p] = ids
                self.size += len(p)

    def _latin(self, word: str) -> bool:
        return max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)

    def _encode(self, new: list[str]) -> list[list[int]]:
        if not self.by_word:
            return [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        # White space separates tokens: a chunk's ids are those of its words, and most words have been met before.
        split = [p.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for p in new]
        if len(self.words) > WORDS:
            self.words = {}
        missing = list(set().union(*split) - self.words.keys())
        rest = []
        for word in missing:
            core = word.rstrip(ENDS)
            low = core.lower()
            if core and core.isalpha() and low.isalpha() and (core.isascii() or self._latin(core)):
                end = word[len(core) :]
                if end and end not in self.words:
                    self.words[end] = tuple(self.tokenizer.encode(end, add_special_tokens=False).ids)
                mapped = low if core.isascii() else low.encode().decode("latin-1").translate(BYTE_MAP)
                ids = tuple([t.id for t in self.model.tokenize(mapped)])
                self.words[word] = ids + self.words[end] if end else ids
            else:
                rest.append(word)
        for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.words[word] = tuple(e.ids)
        return [list(chain.from_iterable(map(self.words.__getitem__, ws))) for ws in split]

    def _forget(self) -> None:
        if self.size > self.remember // 2:
            self.old, self.young, self.size = self.young, {}, 0

    def _ids(self, piece: str) -> list[int]:
        if piece not in self.young:
            self._learn([piece])
        return self.young[piece]

    @staticmethod
    def _tail(text: str, words: int) -> str | None:
        """The end of a text from the start of its ``words + 1``-th run of white space from the end."""
        reach = 24 * (words + 1)
        part = text[-reach:]
        runs = [m.start() for m in RUN.finditer(part) if m.start()]
        return part[runs[-words - 1] :] if len(runs) > words else None

    @staticmethod
    def _head(text: str, words: int) -> str | None:
        """The start of a text up to its ``words + 1``-th run of white space."""
        part = text[: 24 * (words + 1)]
        runs = [m.start() for m in RUN.finditer(part) if m.start()]
        return part[: runs[words]] if len(runs) > words else None

    def _joint(self, left: str, left_from: int, right: str, words: int) -> tuple[str, str] | None:
        """The window over a join: the end of ``left`` (beyond what its own left join has used) and the start of ``right``."""
        tail, head = self._tail(left, words), self._head(right, words)
        if tail is None or head is None or len(left) - len(tail) < left_from:
            return None
        return tail, head

    def _repaired(self, left: str, left_from: int, left_skip: int, right: str) -> tuple[list[int], str, int] | None:
        """The ids of ``left`` and of the join, the head of ``right`` and how many of its ids are spent.

        The window is encoded again, and wider while it doesn't agree with both chunks: its first ids must be those
        of the left chunk's end, its last ids those of the right chunk's start.
        """
        words = 1
        while (window := self._joint(left, left_from, right, words)) is not None:
            tail, head = window
            a, b, t, h, w = self._ids(left), self._ids(right), self._ids(tail), self._ids(head), self._ids(tail + head)
            whole = len(a) - len(t) >= left_skip and a[len(a) - len(t) :] == t and b[: len(h)] == h
            if whole and t and h and w and w[0] == t[0] and w[-1] == h[-1]:
                return a[left_skip : len(a) - len(t)] + w, head, len(h)
            words *= 2
        return None

    def decode(self, ids: list[int]) -> str:
        """What the tokenizer's own decode gives, special tokens included."""
        if self.spelled is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.spelled.__getitem__, ids))

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text: those of encoding it whole, without special tokens added.

        Cyclic garbage collection rests meanwhile: a batch makes many small objects and no cycles, and each collection
        walks all that is remembered.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        self._forget()
        cut = [chunks(t, self.mean) for t in texts]
        need = [c for cs in cut for c in cs]
        for cs in cut:
            for left, right in zip(cs, cs[1:], strict=False):
                if (window := self._joint(left, 0, right, 1)) is not None:
                    need += [window[0], window[1], window[0] + window[1]]
        self._learn(need)
        return [self._joined(cs) for cs in cut]

    def _joined(self, cs: list[str]) -> list[int]:
        if not cs:
            return []
        out, left, used, skip = [], cs[0], 0, 0
        for right in cs[1:]:
            found = self._repaired(left, used, skip, right)
            if found is None:  # no agreement: the two are one chunk
                self.merged += 1
                left += right
                continue
            ids, head, skip = found
            out += ids
            left, used = right, len(head)
        return out + self._ids(left)[skip:]


#: Decimal forms of the ids that vocabularies have; larger ones are formatted one by one.
_DECIMAL = [str(i) for i in range(1 << 18)]


def _decimals(ids: Sequence[int]) -> str:
    try:
        return " ".join(map(_DECIMAL.__getitem__, ids))
    except IndexError:
        return " ".join(map(str, ids))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: What can be asked of ``encode_decode``: column type and value from (ids, decoded text).
OUTPUTS = {
    "ids": ("array<int>", lambda ids, text: ids),
    "n_tokens": ("long", lambda ids, text: len(ids)),
    "ids_sha256": ("string", lambda ids, text: _sha(_decimals(ids))),
    "decoded": ("string", lambda ids, text: text),
    "decoded_sha256": ("string", lambda ids, text: _sha(text)),
}
ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


#: The encoder that a worker process keeps from task to task.
_ENCODERS: dict[tuple[int, int], ChunkEncoder] = {}


def encode_decode(
    docs: DataFrame, tokenizer_path: str, outputs: Sequence[str] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", mean: int = 1024, keep: str | None = None
) -> DataFrame:
    """Encode every whole text and decode it again: (id, *outputs), and the long column ``keep`` as it is.

    One pass without a shuffle: each task keeps the ids of the chunks that it has met within a bound, so passages that
    documents of a task share are encoded once.  The tokenizer's file (its size is fixed) is read by the driver and
    broadcast, so executors need no copy.

    NULL texts count as empty, which has no ids and decodes to the empty text.  Special tokens in a text are what the
    tokenizer makes of them; none are added.  Rows are independent: repeated rows give equal rows, a NULL id stays
    NULL, an empty table gives an empty table, other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    names = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = _ENCODERS.get((hash(model.value), mean))
        if encoder is None:
            tokenizer = Tokenizer.from_str(model.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _ENCODERS.clear()
            encoder = _ENCODERS[hash(model.value), mean] = ChunkEncoder(tokenizer, mean)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                found = []
                for ids in encoder.encode_batch([x or "" for x in b.column(1).to_pylist()]):
                    text = encoder.decode(ids)
                    found.append([OUTPUTS[n][1](ids, text) for n in names])
                columns = [pa.array([f[k] for f in found], ARROW[OUTPUTS[n][0]]) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, *b.columns[2:]], names=[id_col, *names, *more])

    more = [keep] if keep else []
    schema = ", ".join([f"`{id_col}` long", *[f"`{n}` {OUTPUTS[n][0]}" for n in names], *[f"`{n}` long" for n in more]])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *[F.col(n).cast("long") for n in more]).mapInArrow(run, schema)
