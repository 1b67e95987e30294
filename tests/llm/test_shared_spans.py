"""Problem 8 beyond `test_llm.py`: long texts in parts, sketches of any size, classes of runs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import shared_spans as S
from tests.conftest import rows_of
from tests.llm.test_llm import brute_spans, corpus


def frame_of(frame, texts: dict[int, str], parts: int = 3):
    return frame("doc_id long, text string", list(texts.items()), parts)


@pytest.mark.parametrize("seed, length, block", [(10, 20, 64), (11, 9, 33), (12, 31, 40)])
def test_parts_of_long_texts(seed, length, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHARS", block)
    texts = corpus(seed)
    batch = pa.RecordBatch.from_pydict({"doc": list(texts), "text": list(texts.values())})
    windows = {i: [] for i in texts}
    anchors = S.Anchors(length)
    for b in S._blocks(iter([batch]), length):
        owner, _, start, n = anchors.runs(b.codes())
        for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist()):
            windows[b.ids[o]] += [b.first[o] + s + i for i in range(k)]
    for i, t in texts.items():
        assert sorted(windows[i]) == list(range(len(t) - length + 1))


def test_a_text_longer_than_a_block(frame):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh \n", k=S.BLOCK_CHARS * 2 + 5000))
    cut = S.BLOCK_CHARS  # the copies stand at other offsets, and across the edges of parts
    texts = {1: text, 2: "q" * 77 + text[cut - 400 : cut + 900], 3: text[2 * cut - 50 : 2 * cut + 300] + "z", 4: text[5:170]}
    want = [(1, 5, 170), (1, cut - 400, cut + 900), (1, 2 * cut - 50, 2 * cut + 300), (2, 77, 77 + 1300), (3, 0, 350), (4, 0, 165)]
    assert rows_of(S.shared_spans(frame_of(frame, texts))) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [3, 5, 12, 13, 30])
def test_a_sketch_of_any_size_loses_nothing(frame, bits):
    texts = corpus(7, 60)
    assert rows_of(S.shared_spans(frame_of(frame, texts), length=15, bits=bits)) == sorted(brute_spans(texts, 15), key=repr)


def test_the_sketch_grows_with_the_anchors(frame):
    rng = random.Random(2)
    sizes, passed = [], []
    for count in (20, 400):
        docs = frame_of(frame, {i: "".join(rng.choices("abcdefghij", k=3000)) for i in range(count)})
        rows = docs.withColumnRenamed("doc_id", "doc")
        sketch = S.repeated_sketch(rows)
        sizes.append(sum(len(r) for r in sketch.rows))
        passed.append(S.candidate_runs(rows, sketch).count() / (count * 3000 / 41))
    assert sizes[1] > 5 * sizes[0]
    assert max(passed) < 0.15  # no text is repeated: what passes is the sketch's error


def test_a_slice_counted_in_folds_equals_one_count(monkeypatch):
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 1 << 32, 500).astype(np.uint32) for _ in range(20)]
    rows = []
    for counted in (1 << 20, 700):
        monkeypatch.setattr(S, "COUNTED", counted)
        part = S._Slice(12)
        for v in values:
            part.add(v)
        rows.append(part.row(3).to_pylist())
    assert rows[0] == rows[1] and rows[0][0]["bits"] == 12


def test_copies_are_classes_and_only_edges_open(frame):
    rng = random.Random(4)
    notice = "".join(rng.choices("abcdefgh ", k=2000))
    texts = {i: "".join(rng.choices("xyz", k=50 + i)) + notice + "".join(rng.choices("xyz", k=40)) for i in range(30)}
    rows = frame_of(frame, texts).withColumnRenamed("doc_id", "doc")
    classes = S.run_classes(S.runs_of(S.segments(rows, S.repeated_sketch(rows))))
    assert classes.where("whole").count() > 20
    assert classes.where("open").selectExpr("sum(one.n)").first()[0] < 30 * 350  # of 30 * 1,840 shared windows
    assert rows_of(S.shared_spans(frame_of(frame, texts))) == sorted(brute_spans(texts, 160), key=repr)


def test_rows_of_one_id_with_other_texts(frame):
    rng = random.Random(5)
    a, b = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    rows = [(1, a), (1, b), (1, a), (2, "-" + a), (3, b[100:])]
    got = rows_of(S.shared_spans(frame("doc_id long, text string", rows)))
    assert got == [(1, 0, 400), (2, 1, 401), (3, 0, 300)]
