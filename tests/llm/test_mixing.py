"""Problem 7 beyond `test_llm.py`: caps inside the raking, shares and margins that are reached."""

import os
import random

import numpy as np
import pytest

from loomgraph.llm import mixing, queries
from loomgraph.llm.mixing import calibrate, margins_reached, mix, mix_sized, rake
from tests.conftest import rows_of
from tests.llm.test_llm import DOCS, TARGETS, doc

SIZED = "doc_id long, source string, lang string, topic int, tokens long"


@pytest.mark.parametrize("seed", range(4))
def test_raking_keeps_the_caps_and_the_margins(seed):
    rng = np.random.default_rng(seed)
    source, lang, topic = (np.r_[np.arange(k), rng.integers(0, k, 400 - k)] for k in (4, 5, 6))
    size = rng.integers(1, 100, 400).astype(float)
    wanted, cap = np.array([0.1, 0.2, 0.4, 0.3]) * size.sum(), np.array([1.0, 2.0, 2.0, 3.0])
    weight = rake(size, source, wanted, [lang, topic], cap)
    assert (weight <= cap[source] * size + 1e-9).all()
    assert np.allclose(np.bincount(source, weight), wanted)
    for m in (lang, topic):
        assert np.allclose(np.bincount(m, weight), np.bincount(m, size), rtol=1e-4)


def test_a_short_source_is_at_its_cap():
    size, source = np.array([10.0, 20.0, 30.0, 40.0]), np.array([0, 0, 1, 1])
    weight = rake(size, source, np.array([80.0, 20.0]), [np.array([0, 1, 0, 1])], np.array([2.0, 3.0]))
    assert np.allclose(weight[:2], [20.0, 40.0]) and abs(weight[2:].sum() - 20) < 1e-9


def test_shares_are_met_to_one_document(frame):
    rng = random.Random(1)
    sized = frame(SIZED, [(i, rng.choice("aabc"), rng.choice(["en", "de", "und"]), rng.randrange(5), int(10 ** rng.uniform(0, 4))) for i in range(3000)])
    targets = frame(TARGETS, [("m", "a", 5.0, 2, ""), ("m", "b", 3.0, 2, ""), ("m", "c", 2.0, 3, ""), ("k", "a", 1.0, 1, ""), ("k", "c", 9.0, 9, "")])
    chosen, shares, margins = mix_sized(sized, targets)
    rows = shares.collect()
    assert len(rows) == 5
    for r in rows:
        if r.short:
            assert r.reached == r.size * r.max_repeats < r.wanted
        else:
            assert abs(r.reached - r.wanted) <= min(r.largest, 0.001 * r.wanted + 2)
    copies = chosen.collect()
    assert len({(r.mix_name, r.doc_id) for r in copies}) == len(copies)
    whole = {d: sum(r.reached_share for r in margins.collect() if r.mix_name == "m" and r.dimension == d) for d in ("lang", "topic")}
    assert all(abs(v - 1) < 1e-6 for v in whole.values())
    for r in margins.collect():
        if r.mix_name == "m":
            assert abs(r.calibrated_share - r.wanted_share) < 1e-3 and abs(r.reached_share - r.calibrated_share) < 0.05


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_the_same_documents_whatever_the_partitions(spark, frame, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.choice(["en", "de"]), rng.randrange(3), rng.choice([7, 7, 7, rng.randrange(1, 400)])) for i in range(900)]
    targets = frame(TARGETS, [("m", "a", 2.0, 1, ""), ("m", "b", 3.0, 2, "")])
    taken = []
    for parts in (1, 5):
        chosen, shares, _ = mix_sized(frame(SIZED, rows, parts), targets)
        taken.append(rows_of(chosen))
        for r in shares.collect():
            assert r.short or abs(r.reached - r.wanted) <= r.largest / 2 * max(1, 900 / block)
    assert taken[0] == taken[1]


def test_a_cell_gets_floor_or_ceiling_of_its_copies(frame):
    rng = random.Random(2)
    sized = frame(SIZED, [(i, rng.choice("ab"), "en", rng.randrange(3), rng.choice([0, 1, 5, 5, 5, 900])) for i in range(800)] + [(None, "a", "en", 0, 7), (7, "b", "en", 0, 5)])
    targets = frame(TARGETS, [("m", "a", 7.0, 5, ""), ("m", "b", 3.0, 1, "")])
    rate = {(r.source, r.topic): r.copies for r in calibrate(sized, targets).collect()}
    for r in mix_sized(sized, targets)[0].collect():
        assert np.floor(rate[r.source, r.topic]) <= r.copies <= np.ceil(rate[r.source, r.topic])


def test_empty_tables(frame):
    for docs, targets in (([], [("m", "a", 1.0, 1, "")]), ([doc(1, "x", "a")], []), ([], [])):
        chosen, report = mix(frame(DOCS, docs), frame(TARGETS, targets))
        assert chosen.count() == 0 and report.count() == len(targets)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shares_of_the_test_tables(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables here")
    rows = queries.p7_shares(spark, f"/root/testdata/{sf}").collect()
    found = {tuple(r) for r in queries.p7_found(spark, f"/root/testdata/{sf}").collect()}
    assert found == {(r.mix_name, r.source) for r in rows if r.short}
    for r in rows:
        assert r.short or abs(r.reached - r.wanted) <= r.largest
        assert not r.short or r.reached == r.size * r.max_repeats


def test_margins_of_no_documents(frame):
    sized, targets = frame(SIZED, []), frame(TARGETS, [("m", "a", 1.0, 1, "")])
    calibrated = calibrate(sized, targets)
    assert rows_of(margins_reached(calibrated, mix_sized(sized, targets)[0])) == []
