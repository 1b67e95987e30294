"""Problems 6 to 8: against public libraries, brute force and the defined cases."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.bpe import PairIndexEncoder, count_tokens, encode_corpus, load_merges, vocabulary_path
from loomgraph.llm import mixing
from loomgraph.llm.mixing import calibrate, fill, mix, rake, short_sources
from loomgraph.llm.shared_spans import Anchors, candidate_runs, repeated_sketch, shared_share, shared_spans
from tests.conftest import rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, project string, file_path string, tokens string, ids string, doc string, at string"
TEXTS = ["", None, " ", "\x1c\x85　a", "Hello  world\r\n\t x", "naïve 日本語のテキスト 12345 ½ ²", "<|endoftext|> x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é \U0001f41b\U0001f600 ퟿", "don't we'll I'M", "\x00\x01", "x" * 3000 + " " * 500 + "y", "a​ b  c"]


def doc(i, text, source="s", lang="en", path="a/b.py"):
    return (i, text, lang, source, 1, "p", path, "clash", "clash", "clash", "clash")


@pytest.fixture(scope="session")
def encoder():
    return PairIndexEncoder(*load_merges(vocabulary_path()))


@pytest.fixture(scope="session")
def reference_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda texts: [t.ids for t in tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def split(flat, counts):
    return [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])]


def test_ids_equal_the_library(encoder, reference_ids):
    assert split(*encoder.encode(TEXTS)) == reference_ids(TEXTS)
    assert encoder.count(TEXTS).tolist() == [len(x) for x in reference_ids(TEXTS)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), min_size=1, max_size=5))
def test_ids_of_any_text(encoder, reference_ids, texts):
    assert split(*encoder.encode(texts)) == reference_ids(texts)


def test_round_trip(encoder):
    import json

    from loomgraph.llm.bpe import byte_letters

    with open(vocabulary_path(), encoding="utf-8") as file:
        letters = {i: w for w, i in json.load(file)["model"]["vocab"].items()}
    back = byte_letters()
    for text, ids in zip(TEXTS, split(*encoder.encode(TEXTS))):
        assert bytes(back[c] for i in ids for c in letters[i]).decode() == (text or "")


def test_encode_corpus(frame, reference_ids):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "again"), (None, "no id")]
    got = rows_of(encode_corpus(frame("doc_id long, text string", rows)))
    assert got == sorted(((i, ids) for (i, _), ids in zip(rows, reference_ids([t for _, t in rows]))), key=repr)
    assert encode_corpus(frame("doc_id long, text string", [])).count() == 0
    assert rows_of(count_tokens(frame("text string, ids int", [("a b", 1), (None, 2)]))) == [(1, 2), (2, 0)]


# problem 7

TARGETS = "mix_name string, source string, weight double, max_repeats int, copies string"


def test_short_sources(frame):
    docs = [doc(i, "word " * 10, " Code") for i in range(8)] + [doc(100 + i, "word " * 10, "wiki") for i in range(2)] + [doc(200, None, "wiki"), doc(201, "x", None), doc(202, "word " * 100, "other")]
    # sizes: code 80-ish, wiki 20-ish; total 100-ish
    targets = [("m", "CODE", 50.0, 1, ""), ("m", "wiki ", 50.0, 2, ""), ("k", "code", 0.5, 1, ""), ("k", "wiki", 0.5, 3, ""), ("n", "nothing", 1.0, 9, ""), ("n", "code", 1.0, 1, ""), ("z", "code", 0.0, 1, ""), ("z", "wiki", None, None, ""), (None, "code", 1.0, 1, ""), ("m", None, 1.0, 1, "")]
    got = rows_of(short_sources(frame(DOCS, docs), frame(TARGETS, targets)))
    assert got == [("m", "wiki"), ("n", "nothing")]
    assert short_sources(frame(DOCS, docs), frame(TARGETS, [])).count() == 0
    assert rows_of(short_sources(frame(DOCS, []), frame(TARGETS, targets))) == []


def test_short_follows_the_filled_copies(monkeypatch):
    cells = pd.DataFrame({"mix_name": "m", "source": ["a", "b"], "lang": "en", "topic": 0, "tokens": [80, 20], "weight": 50.0, "max_repeats": [1, 2]})
    assert list(mixing._calibrated(cells)["short"]) == [False, True]
    monkeypatch.setattr(mixing, "fill", lambda size, weight, cap, wanted: np.full(len(size), wanted / size.sum()))
    assert list(mixing._calibrated(cells)["short"]) == [False, False]


def test_rake_meets_all_margins():
    rng = np.random.default_rng(0)
    source, lang, topic = (rng.integers(0, k, 300) for k in (4, 5, 6))
    size = rng.integers(1, 100, 300).astype(float)
    wanted = np.array([0.1, 0.2, 0.3, 0.4]) * size.sum()
    weight = rake(size, source, wanted, [lang, topic])
    assert np.allclose(np.bincount(source, weight), wanted)
    assert np.allclose(np.bincount(lang, weight), np.bincount(lang, size), rtol=1e-6)
    assert np.allclose(np.bincount(topic, weight), np.bincount(topic, size), rtol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 5), st.floats(0, 400))
def test_fill_never_passes_the_cap(sizes, cap, wanted):
    size = np.array(sizes, float)
    copies = fill(size, size * np.linspace(1, 2, len(size)), cap, wanted)
    assert (copies <= cap).all() and abs((copies * size).sum() - min(wanted, cap * size.sum())) < 1e-6


def test_mix_reaches_the_shares(frame):
    rng = random.Random(0)
    docs = [doc(i, "word " * rng.randrange(5, 30), rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["en", "de-DE", None, "??"]), rng.choice(["x/a.py", "y/b.py", None])) for i in range(1500)]
    targets = [("m", "a", 1.0, 1, ""), ("m", "b", 1.0, 4, ""), ("m", "c", 0.5, 2, "")]
    chosen, report = mix(frame(DOCS, docs), frame(TARGETS, targets))
    taken = chosen.collect()
    assert all(1 <= r.copies <= {"a": 1, "b": 4, "c": 2}[r.source] for r in taken)
    assert len({(r.mix_name, r.doc_id) for r in taken}) == len(taken)
    for r in report.collect():
        assert abs(r.reached_share - r.share) < 0.04 and not r.short


# problem 8


def brute_spans(texts: dict[int, str], length: int) -> list[tuple]:
    owners = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            owners[t[p : p + length]].add(i)
    out = []
    for i, t in texts.items():
        hit = [False] * len(t)
        for p in range(len(t) - length + 1):
            if len(owners[t[p : p + length]]) > 1:
                hit[p : p + length] = [True] * length
        start = None
        for p, h in enumerate([*hit, False]):
            if h and start is None:
                start = p
            if not h and start is not None:
                out.append((i, start, p))
                start = None
    return sorted(out)


def corpus(seed: int, count: int = 40) -> dict[int, str]:
    rng = random.Random(seed)
    letters = "ab \n日é\U0001f41b"
    blocks = ["".join(rng.choices(letters, k=rng.randrange(5, 90))) for _ in range(8)] + ["-" * 70]
    texts = {}
    for i in range(count):
        texts[i] = "".join("".join(rng.choices(letters, k=rng.randrange(0, 60))) + rng.choice(blocks) * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 5)))
    texts[count] = texts[1]  # an exact copy
    return texts


@pytest.mark.parametrize("seed, length, bits", [(0, 20, 26), (1, 31, 26), (2, 7, 6), (3, 1, 22), (4, 2, 8)])
def test_spans_against_brute_force(frame, seed, length, bits):
    texts = corpus(seed)
    rows = [doc(i, t) for i, t in texts.items()] + [doc(900, None), doc(901, ""), doc(None, texts[1])]
    got = shared_spans(frame(DOCS, rows + rows[:5]), length=length, bits=bits)
    assert rows_of(got) == sorted(brute_spans(texts, length), key=repr)


def test_share_keeps_every_record(frame):
    rows = [doc(1, "x" * 5 + "shared words here"), doc(2, "shared words here"), doc(3, None), doc(4, "alone"), doc(None, "shared words here")]
    got = {r.doc_id: (r.chars, r.stretches, r.shared) for r in shared_share(frame(DOCS, rows), length=10).collect()}
    assert got == {1: (22, 1, 17), 2: (17, 1, 17), 3: (0, 0, 0), 4: (5, 0, 0), None: (17, 0, 0)}


def test_spans_empty(frame):
    assert shared_spans(frame(DOCS, [])).count() == 0


def test_very_long_text(frame):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    got = rows_of(shared_spans(frame(DOCS, [doc(1, long), doc(2, "q" * 50 + long[300_000:300_500])])))
    assert got == [(1, 300_000, 300_500), (2, 50, 550)]


def test_prefilter_loses_nothing_and_drops_most(frame):
    texts = corpus(5)
    rows = frame("doc long, text string", list(texts.items()))
    kept = rows_of(candidate_runs(rows, repeated_sketch(rows, 20), 20))
    shared = {(i, p) for i, a, b in brute_spans(texts, 20) for p in range(a, b - 19)}
    estimated = {(r[1], p) for r in kept for p in range(r[2], r[2] + r[3])}
    assert {(i, p) for i, p in shared} - estimated == set() or all(len({j for j in texts if texts[i][p : p + 20] in texts[j]}) < 2 for i, p in shared - estimated)
    assert len(estimated) < sum(max(0, len(t) - 19) for t in texts.values())


def test_runs_cover_every_window():
    texts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in corpus(6).values() if len(t) >= 12]
    owner, _, start, n = Anchors(12).runs(texts)
    for i, t in enumerate(texts):
        covered = sorted(p for s, k in zip(start[owner == i], n[owner == i]) for p in range(s, s + k))
        assert covered == list(range(len(t) - 11))
