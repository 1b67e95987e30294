"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 6).

Method: pair occurrence index. A task splits its texts into words, keeps each word once, and
maps every adjacent pair that has a merge rank to all its positions in those words. Active
ranks are applied in ascending order; each merge updates only the lists of the pairs it
touches. A merge can only create pairs of later rank, so one ascending pass is complete.
Words are looked up, so a word that stands in half of all texts is merged once per task.

The vocabulary is a `tokenizers` JSON file whose path is a parameter. The driver reads it and
sends its merges (their number is fixed by the file, not by the data) to the executors.

Defined cases: null and empty texts give an empty list. Text that looks like a special token
is ordinary text. Whole texts are encoded, in blocks of rows bounded by characters, so very
long texts cost memory in proportion to the longest one only. Repeated rows, repeated ids and
null ids are encoded row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.json"
#: The split that precedes the merges, with white space spelled out so that it doesn't depend
#: on a regex library's idea of it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters gathered before a block of rows is encoded, and words remembered by a task.
BLOCK_CHARS, REMEMBERED_WORDS = 4_000_000, 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The installed file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(id of each single byte, merges as rows of left id, right id, merged id in rank order)."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    single = np.zeros(256, np.int32)
    for letter, byte in byte_letters().items():
        single[byte] = ids[letter]
    return single, np.array([[ids[a], ids[b], ids[a + b]] for a, b in pairs], np.int32)


class PairIndexEncoder:
    """Encodes texts; remembers the ids of the words it has met."""

    def __init__(self, single: np.ndarray, merges: np.ndarray):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.single = single
        key = (merges[:, 0].astype(np.int64) << 20) | merges[:, 1]
        self.left, self.right, self.made = (merges[:, i].tolist() for i in range(3))
        self.rank_of = dict(zip(key.tolist(), range(len(key))))
        self.sorted_rank = np.argsort(key, kind="stable")
        self.sorted_key = key[self.sorted_rank]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.offset = np.zeros(1, np.int64)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and the number of ids of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(ids)
        ends = np.cumsum(sizes)
        following = np.arange(1, n + 1)
        following[ends - 1] = -1
        inner = np.ones(n, bool)
        inner[ends - 1] = False
        inner = np.flatnonzero(inner)
        # the index: rank -> positions of its pair
        key = (ids[inner].astype(np.int64) << 20) | ids[inner + 1]
        slot = np.minimum(np.searchsorted(self.sorted_key, key), len(self.sorted_key) - 1)
        known = self.sorted_key[slot] == key
        rank, place = self.sorted_rank[slot[known]], inner[known]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        active = rank[np.r_[0, cuts]].tolist() if len(rank) else []
        index = dict(zip(active, (p.tolist() for p in np.split(place, cuts))))
        sym, after = ids.tolist(), following.tolist()
        before = np.arange(-1, n - 1)
        before[np.r_[0, ends[:-1]]] = -1
        before = before.tolist()
        rank_of, left, right, made = self.rank_of, self.left, self.right, self.made
        heap = active  # ascending, hence a heap
        while heap:
            r = heappop(heap)
            a, b, new = left[r], right[r], made[r]
            places = index.pop(r)
            places.sort()
            for p in places:
                q = after[p]
                if sym[p] != a or q < 0 or sym[q] != b:
                    continue  # another merge took one of the two
                sym[p], sym[q] = new, -1
                after[p] = s = after[q]
                if s >= 0:
                    before[s] = p
                    m = rank_of.get(new << 20 | sym[s])
                    if m is not None:
                        if m in index:
                            index[m].append(p)
                        else:
                            index[m] = [p]
                            heappush(heap, m)
                o = before[p]
                if o >= 0:
                    m = rank_of.get(sym[o] << 20 | new)
                    if m is not None:
                        if m in index:
                            index[m].append(o)
                        else:
                            index[m] = [o]
                            heappush(heap, m)
        merged = np.array(sym, np.int32)
        kept = merged >= 0
        counts = np.add.reduceat(kept, ends - sizes, dtype=np.int64)
        return merged[kept], counts

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, one after the other, and the number of words of each."""
        index, find = self.index, self.find
        words = [find(t) if t else [] for t in texts]
        missing = set().union(*words).difference(index)
        if missing:
            new = sorted(missing)
            ids, counts = self._merge(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.pool = np.concatenate([self.pool, ids])
            self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(counts)])
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter((i for w in words for i in map(index.__getitem__, w)), np.int64, int(per_text.sum()))
        return numbers, per_text

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, per_text = self._words(texts)
        sizes = np.concatenate([[0], np.cumsum((self.offset[1:] - self.offset[:-1])[numbers])])
        ends = np.cumsum(per_text)
        return sizes[ends] - sizes[ends - per_text]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; the number of ids of each text)."""
        numbers, per_text = self._words(texts)
        start, size = self.offset[numbers], (self.offset[1:] - self.offset[:-1])[numbers]
        filled = np.cumsum(size)
        total = int(filled[-1]) if len(filled) else 0
        flat = self.pool[np.repeat(start - (filled - size), size) + np.arange(total)] if total else np.empty(0, np.int32)
        sums = np.concatenate([[0], filled])
        ends = np.cumsum(per_text)
        return flat, sums[ends] - sums[ends - per_text]


def _blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch of at most BLOCK_CHARS characters, or one row."""
    texts = batch.column(text).to_pylist()
    start, chars = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > start and chars + size > BLOCK_CHARS:
            yield batch.slice(start, i - start), texts[start:i]
            start, chars = i, 0
        chars += size
    if len(texts) > start:
        yield batch.slice(start), texts[start:]


def _encoder_of(shared) -> PairIndexEncoder:
    return PairIndexEncoder(*shared.value)


def _mapped(docs: DataFrame, text: str, path: str | None, field: T.StructField, column) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(shared)
        for batch in batches:
            for rows, texts in _blocks(batch, text):
                if len(encoder.index) > REMEMBERED_WORDS:
                    encoder.forget()
                made = column(encoder, texts)
                kept = [c for c, name in zip(rows.columns, rows.schema.names) if name != text]
                names = [name for name in rows.schema.names if name != text]
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*names, field.name])

    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), field])
    return docs.mapInArrow(run, schema)


def _id_lists(encoder: PairIndexEncoder, texts: list[str | None]) -> pa.Array:
    flat, counts = encoder.encode(texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))


def _id_counts(encoder: PairIndexEncoder, texts: list[str | None]) -> pa.Array:
    return pa.array(encoder.count(texts), pa.int64())


def encode_corpus(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` with the ids of `text` in place of it. Select the columns to keep first; a column
    named like `into` must not be among them."""
    return _mapped(docs, text, path, T.StructField(into, T.ArrayType(T.IntegerType(), False)), _id_lists)


def count_tokens(docs: DataFrame, text: str = "text", into: str = "tokens", path: str | None = None) -> DataFrame:
    """`docs` with the number of ids of `text` in place of it."""
    return _mapped(docs, text, path, T.StructField(into, T.LongType()), _id_counts)
