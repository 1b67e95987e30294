"""Long spans that stand word for word in more than one record (problem 8).

A character is shared if it lies in a window of `length` characters that also occurs, exactly,
in another record. Method: a count-min prefilter. Partition sketches are merged into one that
overestimates in how many records a window can occur; a second pass groups exactly, and only,
the windows estimated repeated. No repeated window is lost:

1. A window is counted under its anchor, the least hash among its sub-windows of half the
   length. Equal windows have equal anchors, so the count of an anchor is at least that of
   each of its windows. Consecutive windows share anchors, so a record of n characters has
   about 2.5 n / 100 runs of windows with one anchor.
2. First reading of the texts: each task gathers the hashes of its anchors (each at most twice)
   by slice of the hash space, 4 bytes an anchor. The tasks that merge a slice count its
   anchors and size its part of the sketch by that count: two rows of counters that stop at 2,
   CELLS cells an anchor, of which one bit each ("2 or more") is kept. The merged sketch grows
   with the corpus up to 2 * 2**`bits` bits (256 MB by default) and no further; beyond about
   2**`bits` / CELLS anchors it tells less and less apart and lets more through, never less.
3. Second reading: consecutive runs that pass are written as segments, with their text, a
   128-bit hash of each run's whole content, and where they stand. Later steps read segments.
4. Runs are compared before windows. Runs of equal content form a class; a class in two
   records is shared as a whole. An anchor found in one record only is dropped here, exactly.
   Windows are opened only where one anchor has several classes (the edges of passages): all
   occurrences of classes of one record, one representative of classes already shared. They
   are grouped by a 128-bit hash of their text with the least and greatest record id.
5. Shared runs and windows are joined into stretches.

No pairs of records are formed, and no group is collected: a notice in a third of all
records is one class with two ids, aggregated in part before the shuffle. The lookups are
joins whose hot keys AQE splits.

Defined cases: null texts, null ids and texts shorter than `length` have no shared
characters. Repeats within one record don't count. Rows with one id are one record. Offsets
count code points. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written

#: Characters of a span; at most 2**SKETCH_BITS cells in a row of the sketch, CELLS for an anchor.
LENGTH, SKETCH_BITS, CELLS = 160, 30, 4
#: Slices that the sketch is merged in (2**SLICE_BITS); characters hashed at a time.
SLICE_BITS, BLOCK_CHARS = 10, 1 << 18
#: Anchors that a task gathers before it hands them on, and that a slice counts at a time.
GATHERED, COUNTED = 2_000_000, 1 << 20
#: Odd multipliers: of characters, of the polynomial, of the final mix, of slices, of the second row.
MIX, BASE, FINAL, SPREAD, SECOND = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B1


def _u(x: int) -> np.uint64:
    return np.uint64(x)


class Anchors:
    """Finds the runs of windows with one anchor in texts laid end to end."""

    def __init__(self, length: int):
        self.length, self.sub = length, max(1, length // 2)
        self.width = length - self.sub + 1
        self.power = self.inverse = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.full(n, _u(BASE)))
            self.inverse = np.cumprod(np.full(n, _u(pow(BASE, -1, 1 << 64))))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of every sub-window."""
        n, k = len(codes), self.sub
        self._powers(n)
        x = codes.astype(np.uint64)
        x *= _u(MIX)
        x ^= x >> _u(32)
        x *= _u(MIX)
        x *= self.power[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> _u(33)
        h *= _u(FINAL)
        h ^= h >> _u(29)
        return h

    def runs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, anchor, first window, number of windows) of each run."""
        sizes = np.array([len(t) for t in texts], np.int64)
        least = self.hashes(np.concatenate(texts))
        span = 1
        while span * 2 <= self.width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.width:
            rest = self.width - span
            least = np.minimum(least[:-rest], least[rest:])
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        whole = owner[: len(least)] == owner[self.length - 1 :]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | ~whole[:-1]
        new &= whole
        start = np.flatnonzero(new)
        # a run ends where the next begins, or where windows stop lying in one text
        last = (first + sizes - self.length)[owner[start]] + 1
        n = np.minimum(np.append(start[1:], len(least)), last) - start
        return owner[start], least[start], start - first[owner[start]], n


class Block(NamedTuple):
    """Texts, or parts of long ones, that are hashed together; `first` is where a part begins."""

    ids: list[int]
    texts: list[str]
    first: list[int]

    def codes(self) -> list[np.ndarray]:
        return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in self.texts]


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Block]:
    """The texts long enough, in blocks. A text longer than a block comes in parts that share
    `length` - 1 characters, so each of its windows lies in exactly one part."""
    block, chars = Block([], [], []), 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if doc is None or text is None or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, BLOCK_CHARS):
                part = text[at : at + BLOCK_CHARS + length - 1]
                if chars and chars + len(part) > BLOCK_CHARS + length - 1:
                    yield block
                    block, chars = Block([], [], []), 0
                block.ids.append(doc)
                block.texts.append(part)
                block.first.append(at)
                chars += len(part)
    if chars:
        yield block


def _slice_bits(bits: int) -> int:
    return max(0, min(SLICE_BITS, bits - 3))


def _placed(anchor: np.ndarray, slice_bits: int) -> np.ndarray:
    """Anchors as slice << 32 | value; the multiplier spreads them, as least hashes are small."""
    x = anchor ^ (anchor >> _u(29))
    return ((x * _u(SPREAD)) >> _u(32 - slice_bits)).astype(np.int64)


def _cell(value: np.ndarray, row: int, bits: int | np.ndarray) -> np.ndarray:
    """Cells of 32-bit values (int64) in a row of 2**bits cells."""
    return (value if row == 0 else value * SECOND & 0xFFFFFFFF) >> (32 - bits)


class Sketch(NamedTuple):
    """One bit a cell, set where 2 or more records touched it. Slice s has 2**bits[s] cells in
    each row, from cell base[s]."""

    slice_bits: int
    bits: np.ndarray
    base: np.ndarray
    rows: tuple[np.ndarray, np.ndarray]

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        """Which anchors can occur in 2 or more records."""
        placed = _placed(anchor, self.slice_bits)
        number, value = placed >> 32, placed & 0xFFFFFFFF
        out = np.ones(len(anchor), bool)
        for row, cells in enumerate(self.rows):
            at = self.base[number] + _cell(value, row, self.bits[number])
            out &= (cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


_GATHERED = pa.schema([("slice", pa.int32()), ("hashes", pa.binary())])
_MERGED = pa.schema([("slice", pa.int32()), ("bits", pa.int32()), ("row0", pa.binary()), ("row1", pa.binary())])


def _by_slice(placed: np.ndarray) -> pa.RecordBatch:
    """The sketch of a task, as yet without cells: the values of each slice, at most twice each."""
    placed.sort()
    third = np.zeros(len(placed), bool)
    third[2:] = placed[2:] == placed[:-2]
    placed = placed[~third]
    number = placed >> 32
    cuts = np.flatnonzero(np.diff(number)) + 1
    parts = np.split((placed & 0xFFFFFFFF).astype(np.uint32), cuts)
    return pa.RecordBatch.from_arrays([pa.array(number[np.r_[0, cuts]].astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_GATHERED)


class _Slice:
    """Counts the values of one slice."""

    def __init__(self, most: int):
        self.most, self.held, self.size, self.counts = most, [], 0, None

    def _fold(self, bits: int) -> None:
        value = np.concatenate(self.held).astype(np.int64)
        for row in range(2):
            counts = np.minimum(np.bincount(_cell(value, row, bits), minlength=1 << bits), 2).astype(np.uint8)
            self.counts[row] = np.minimum(self.counts[row] + counts, 2)
        self.held = []

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        if sum(map(len, self.held)) > COUNTED:
            if self.counts is None:  # a slice of so many has cells up to the bound in any case
                self.counts = np.zeros((2, 1 << self.most), np.uint8)
            self._fold(self.most)

    def row(self, number: int) -> pa.RecordBatch:
        bits = min(self.most, max(3, (CELLS * self.size - 1).bit_length())) if self.counts is None else self.most
        if self.counts is None:
            self.counts = np.zeros((2, 1 << bits), np.uint8)
        if self.held:
            self._fold(bits)
        return pa.RecordBatch.from_pylist([{"slice": number, "bits": bits, **{f"row{r}": np.packbits(self.counts[r] > 1).tobytes() for r in range(2)}}], schema=_MERGED)


def repeated_sketch(docs: DataFrame, length: int = LENGTH, bits: int = SKETCH_BITS) -> Sketch:
    """The merged sketch of the anchors of all records. The driver receives at most
    2 * 2**`bits` bits, at any input size."""
    slice_bits = _slice_bits(bits)
    most = bits - slice_bits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Anchors(length), [], 0
        for block in _blocks(batches, length):
            owner, anchor, _, _ = anchors.runs(block.codes())
            order = np.lexsort((anchor, owner))  # each anchor of a record once
            owner, anchor = owner[order], anchor[order]
            once = np.ones(len(anchor), bool)
            once[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            held.append(_placed(anchor[once], slice_bits))
            size += len(held[-1])
            if size > GATHERED:
                yield _by_slice(np.concatenate(held))
                held, size = [], 0
        if size:
            yield _by_slice(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, None
        for batch in batches:
            for at, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != number:
                    if now is not None:
                        yield now.row(number)
                    now, number = _Slice(most), at
                now.add(np.frombuffer(hashes.as_py(), np.uint32))
        if now is not None:
            yield now.row(number)

    gathered = docs.mapInArrow(gather, "slice int, hashes binary").repartition("slice").sortWithinPartitions("slice")
    found = gathered.mapInArrow(merge, "slice int, bits int, row0 binary, row1 binary").collect()
    bits_of, cells = np.full(1 << slice_bits, 3, np.int64), [[bytes(1)] * (1 << slice_bits) for _ in range(2)]
    for row in found:
        bits_of[row["slice"]] = row["bits"]
        for r in range(2):
            cells[r][row["slice"]] = row[f"row{r}"]
    size = np.int64(1) << bits_of
    return Sketch(slice_bits, bits_of, np.cumsum(size) - size, tuple(np.frombuffer(b"".join(c), np.uint8) for c in cells))


_RUN = pa.struct([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_SEGMENT = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("sid", pa.int64()), ("text", pa.string()), ("runs", pa.list_(_RUN))])


def segments(docs: DataFrame, sketch: Sketch, length: int = LENGTH) -> DataFrame:
    """(doc, at, sid, text, runs): the stretches of text whose runs the sketch estimates repeated,
    with each run's anchor, the hash of its content (c1, c2), its `start` in the record and its
    `n` windows. `sid`, a hash of the text, tells rows of one id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        anchors, filter = Anchors(length), Sketch(*shared.value)
        for block in _blocks(batches, length):
            codes = block.codes()
            owner, anchor, start, n = anchors.runs(codes)
            kept = np.flatnonzero(filter.repeated(anchor))
            if not len(kept):
                continue
            owner, anchor, start, n = owner[kept], anchor[kept], start[kept], n[kept]
            data = [memoryview(c).cast("B") for c in codes]
            keys = b"".join(xxh3_128_digest(data[o][4 * s : 4 * (s + k + length - 1)]) for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist()))
            keys = np.frombuffer(keys, np.int64).reshape(-1, 2)
            new = np.ones(len(kept), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + n[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(kept)) - 1
            of = owner[head]
            texts = [block.texts[o][a:b] for o, a, b in zip(of.tolist(), start[head].tolist(), (start[tail] + n[tail] + length - 1).tolist())]
            first = np.array(block.first, np.int64)
            runs = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array((start + first[owner]).astype(np.int32)), pa.array(n.astype(np.int32))], fields=list(_RUN))
            sids = np.array([xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(block.ids, np.int64)[of]), pa.array(start[head] + first[of]), pa.array(sids), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(np.append(head, len(kept)).astype(np.int32)), runs)], schema=_SEGMENT)

    return docs.mapInArrow(run, "doc long, at long, sid long, text string, runs array<struct<anchor: long, c1: long, c2: long, start: int, n: int>>")


def runs_of(found: DataFrame) -> DataFrame:
    """(doc, at, sid, anchor, c1, c2, start, n): the runs of segments."""
    return found.select("doc", "at", "sid", F.explode("runs").alias("r")).select("doc", "at", "sid", "r.*")


def candidate_runs(docs: DataFrame, sketch: Sketch, length: int = LENGTH) -> DataFrame:
    """(anchor, doc, start, n): runs of windows that the sketch estimates repeated."""
    return runs_of(segments(docs, sketch, length)).select("anchor", "doc", "start", "n")


def run_classes(runs: DataFrame) -> DataFrame:
    """Classes of runs with equal content, of anchors found in two or more records: (c1, c2, a, b)
    with the least and greatest record, `whole` where these differ, `open` where the anchor has
    further classes, and an occurrence `one`."""
    one = F.min(F.struct("doc", "at", "sid", "start", "n")).alias("one")
    classes = runs.groupBy("c1", "c2").agg(F.first("anchor").alias("anchor"), F.min("doc").alias("a"), F.max("doc").alias("b"), one)
    anchors = classes.groupBy("anchor").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.count("*").alias("k")).where("least < most")
    return classes.join(anchors, "anchor").select("c1", "c2", "a", "b", F.expr("a < b").alias("whole"), F.expr("k > 1").alias("open"), "one")


def _window_keys(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            for doc, begin, text, opened in zip(*(batch.column(i) for i in range(4))):
                data = memoryview(text.as_py().encode("utf-32-le", "surrogatepass"))
                doc, begin, runs = doc.as_py(), begin.as_py(), opened.as_py()
                count = np.array([r["n"] for r in runs])
                at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
                keys = b"".join([digest(data[i : i + 4 * length]) for i in (4 * (at - begin)).tolist()])
                keys = np.frombuffer(keys, np.int64).reshape(-1, 2)
                of = [pa.array(np.repeat(np.array([r[c] for r in runs]), count)) for c in ("a", "b", "whole")]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *of, pa.array(np.full(len(at), doc)), pa.array(at)], names=["k1", "k2", "a", "b", "whole", "doc", "start"])

    return run


def shared_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc, start, end): shared runs and windows; together they cover every shared character."""
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    found = written(segments(rows, repeated_sketch(rows, length, bits), length), "segments")
    classes = written(run_classes(runs_of(found)), "classes")
    placed = runs_of(found).join(classes.drop("one"), ["c1", "c2"])
    whole = placed.where("whole").select("doc", F.col("start").cast("long").alias("start"), (F.col("start").cast("long") + F.col("n") + (length - 1)).alias("end"))
    alone = placed.where("open and not whole").select("doc", "at", "sid", "start", "n", "a", "b", "whole")
    spoken = classes.where("open and whole").select("one.*", "a", "b", "whole")
    opened = alone.unionByName(spoken).groupBy("doc", "at", "sid").agg(F.collect_list(F.struct("start", "n", "a", "b", "whole")).alias("opened"))
    texts = found.select("doc", "at", "sid", "text").join(opened, ["doc", "at", "sid"]).select("doc", "at", "text", "opened")
    windows = written(texts.mapInArrow(_window_keys(length), "k1 long, k2 long, a long, b long, whole boolean, doc long, start long"), "windows")
    repeated = windows.groupBy("k1", "k2").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("k1", "k2")
    single = windows.where("not whole").join(repeated, ["k1", "k2"], "left_semi").select("doc", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(single)


def shared_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, start_at, end_at): maximal stretches of shared characters, end exclusive."""
    by_doc = Window.partitionBy("doc").orderBy("start", "end")
    pieces = shared_pieces(docs, id, text, length, bits)
    reached = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)))
    numbered = starts.withColumn("stretch", F.sum(F.col("new").cast("int")).over(by_doc))
    found = numbered.groupBy("doc", "stretch").agg(F.min("start").alias("start_at"), F.max("end").alias("end_at"))
    return found.select(F.col("doc").alias(id), "start_at", "end_at")


def shared_share(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = SKETCH_BITS) -> DataFrame:
    """(id, chars, stretches, shared, share) of every record, unshared ones included; a null id
    is kept with nothing shared."""
    found = shared_spans(docs, id, text, length, bits).groupBy(id).agg(F.count("*").alias("stretches"), F.sum(F.col("end_at") - F.col("start_at")).cast("long").alias("shared"))
    rows = docs.select(F.col(id).cast("long").alias(id), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))
    shared = F.coalesce("shared", F.lit(0))
    share = F.when(F.col("chars") > 0, F.round(shared / F.col("chars"), 6)).otherwise(0.0)
    return rows.join(found, id, "left").select(id, "chars", F.coalesce("stretches", F.lit(0)).alias("stretches"), shared.alias("shared"), share.alias("share"))
