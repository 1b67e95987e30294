"""Problems 1, 2, 3 and 5 on small fixtures: brute force, and the defined cases of each docstring."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.bitmaps import ARRAY_MAX, Bitmap
from loomgraph.functions.json_text import canonical
from loomgraph.functions.times import micros_of, micros_of_text
from loomgraph.operators.feature_table import feature_columns, feature_table, features_long
from loomgraph.operators.history import ATTRIBUTES, entity_history
from loomgraph.operators.rolling import bursts, rolling_totals
from loomgraph.operators.snapshot_diff import snapshot_changes
from loomgraph.operators.snapshots import ready_sequence
from loomgraph.plans import general_queries
from tests.conftest import rows_of

AS_OF = "2026-06-30 00:00:00"
EVENT = "id long, ts string, type string, project string, tokens_saved long, event_id string, n int, latest string"


# problem 1


def test_features_dirty_events(frame):
    rows = [
        (1, "2026-06-29T23:00:00-01:00", "a-b.x", " P ", 5, "e1", 1, "clash"),  # exactly the as-of time
        (2, "2026-06-29T00:00:00Z", "A_B.X", "p", 100, "e1", 1, None),  # the same event, later id
        (3, "n/a", "t", "p", 7, "e2", 1, None),  # no time: its copy doesn't count either
        (4, "2026-01-01T00:00:00Z", "t", "p", 7, "e2", 1, None),
        (5, "2026-06-30 00:00:01", "t", "p", 7, None, 1, None),  # after the as-of time
        (6, "2026-05-01", "t", "p", None, None, 1, None),
        (7, "2026-05-01 00:00:00", "t", "p", 3, None, 1, None),
        (8, None, "t", "p", 3, None, 1, None),
        (9, "2026-05-01T00:00:00Z", None, "p", 3, None, 1, None),
        (10, "2026-05-01T00:00:00Z", "t", None, 3, None, 1, None),
        (11, "0000-00-00 00:00:00", "t", "q", 3, None, 1, None),
    ]
    wide = feature_table(frame(EVENT, rows), AS_OF)
    assert wide.count() == 1
    got = {(r.entity, r.kind): (r.n, r.total, r.age_us // 1_000_000) for r in features_long(wide, AS_OF).collect()}
    assert got == {("p", "a_b.x"): (1, 5, 0), ("p", "t"): (2, 3, 60 * 86400)}
    flat = feature_columns(wide, ["t", "never"]).collect()[0]
    assert (flat["t__n"], flat["never__n"], flat["never__latest"]) == (2, 0, None)


@pytest.mark.parametrize("text, moment", [("2025-07-01T02:04:59+0530", "2025-06-30 20:34:59"), ("2025-07-01 02:04", "2025-07-01 02:04:00"), ("2025-07-01T02:04-01:00", "2025-07-01 03:04:00"), (" 2025-07-01 ", "2025-07-01 00:00:00"), ("2025-07-01T02:04:59.123456Z", "2025-07-01 02:04:59.123456"), ("2025-02-30", None), ("2025-07-01T25:00:00Z", None), ("2025", None), ("", None), (None, None)])
def test_time_texts(frame, text, moment):
    got = frame("t string", [(text,)]).select(micros_of_text(F.col("t"))).first()[0]
    assert got == (moment and micros_of(moment))


def test_features_empty(frame):
    assert feature_table(frame(EVENT, []), AS_OF).count() == 0


def test_features_hot_entity_against_brute_force(frame):
    rng = random.Random(1)
    rows, want = [], defaultdict(lambda: [0, 0])
    for i in range(3000):
        project, kind = rng.choice(["hot", "hot", f"p{i % 40}"]), f"k{rng.randrange(30)}"
        rows.append((i, f"2026-01-{1 + i % 28:02d}T00:00:00Z", kind, project, i, None if i % 3 else f"e{i}", 0, ""))
        want[project, kind][0] += 1
        want[project, kind][1] += i
    wide = feature_table(frame(EVENT, rows, 7), AS_OF)
    assert wide.count() == len({p for p, _ in want})
    got = {(r.entity, r.kind): [r.n, r.total] for r in features_long(wide, AS_OF).collect()}
    assert got == dict(want)


# problem 2

SNAPSHOTS = "id long, snapshot_id string, project string, status string, valid_from timestamp_ntz, extra string"
WRITES = "id long, project string, semantic_id string, entity_class string, name string, qualified_name string, normalized_signature string, structural_context string, properties_json string, last_seen_snapshot string, valid_to string, updated_at timestamp_ntz, seq long, at string"


def day(n: int) -> datetime:
    return datetime(2026, 1, 1) + timedelta(days=n)


def snapshots(frame, project="p", count=4, more=()):
    return frame(SNAPSHOTS, [(10 + i, f"s{i}", project, "ready", day(i), None) for i in range(1, count + 1)] + list(more))


def write(id, entity, snapshot, name, closing=False, props="{}", project="p", updated=None):
    return (id, project, entity, "Function", name, None, None, None, props, snapshot, "2026-01-01" if closing else None, updated or day(id), 99, "clash")


def versions(frame, writes, snaps):
    return sorted((r.semantic_id, r.name, r.start_snapshot, r.end_snapshot) for r in entity_history(frame(WRITES, writes), snaps).collect())


def test_sequence_takes_the_last_status(frame):
    rows = [(1, "a", "p", "building", day(5), None), (2, "a", "p", "ready", day(5), None), (3, "b", "p", "ready", day(1), None), (4, "b", "p", "failed", day(1), None), (5, "c", "p", "ready", day(3), None), (6, None, "p", "ready", day(2), None), (7, "d", None, "ready", day(2), None)]
    assert rows_of(ready_sequence(frame(SNAPSHOTS, rows)).select("snapshot_id", "seq", "next_id")) == [("a", 2, None), ("c", 1, "a")]


def test_history_versions(frame):
    writes = [
        write(1, "e", "s1", "x"),
        write(2, "e", "s2", "x", props="{ }"),  # the same JSON value: nothing changes
        write(3, "e", "s3", "y"),
        write(4, "e", "s4", None, closing=True),
        write(5, "f", "s2", "z", closing=True),  # not open
        write(6, "f", "s3", None),
        write(7, "f", "s9", "late"),  # not in the sequence
        write(8, "g", "s1", "old", updated=day(50)),
        write(9, "g", "s1", "new", updated=day(51)),
        write(10, "g", "s2", "new", closing=True),
        write(11, "g", "s3", "new"),  # opened again
        write(12, None, "s1", "no entity"),
        write(13, "h", None, "no snapshot"),
    ]
    got = versions(frame, writes + writes[:3], snapshots(frame))
    assert got == [("e", "x", "s1", "s3"), ("e", "y", "s3", "s4"), ("f", None, "s3", None), ("g", "new", "s1", "s2"), ("g", "new", "s3", None)]


def test_history_empty(frame):
    assert versions(frame, [], snapshots(frame)) == []
    assert versions(frame, [write(1, "e", "s1", "x")], frame(SNAPSHOTS, [])) == []


def test_history_against_brute_force(frame):
    rng = random.Random(2)
    writes = []
    for i in range(400):
        values = [rng.choice([None, "a", "b"]) for _ in range(5)]
        writes.append((i, "p", f"e{rng.randrange(20)}", *values, rng.choice(['{"a":1,"b":2}', '{"b":2.0, "a":1}', '{"a":1', None]), f"s{rng.randrange(1, 14)}", rng.choice([None, None, None, "x"]), day(rng.randrange(5)), 0, ""))
    best = {}
    for w in writes:
        key = (w[2], int(w[9][1:]))
        if key[1] <= 12 and (key not in best or (w[11], w[0]) > (best[key][11], best[key][0])):
            best[key] = w
    want = []
    for entity in {e for e, _ in best}:
        state, start = None, None
        for s in sorted(n for e, n in best if e == entity):
            w = best[entity, s]
            values = (*w[3:8], canonical(w[8]))
            if w[10] is not None:
                if state is not None:
                    want.append((entity, start, f"s{s}"))
                state = None
            elif values != state:
                if state is not None:
                    want.append((entity, start, f"s{s}"))
                state, start = values, f"s{s}"
        if state is not None:
            want.append((entity, start, None))
    got = entity_history(frame(WRITES, writes), snapshots(frame, count=12)).select("semantic_id", "start_snapshot", "end_snapshot")
    assert rows_of(got) == sorted(want, key=repr)
    assert len(ATTRIBUTES) == 6


def test_history_queries_return_the_properties(spark, frame, tmp_path):
    rng = random.Random(3)
    writes = [write(e * 10 + s, f"e{e}", f"s{s}", "x", props=rng.choice(['{"a":1,"b":2}', '{"b":2.0, "a":1}', '{"a":1', "{}", None]), closing=rng.random() < 0.2) for e in range(8) for s in range(1, 9)]
    frame(WRITES, writes).write.parquet(f"{tmp_path}/semantic_entities.parquet")
    snapshots(frame, count=8).write.parquet(f"{tmp_path}/graph_snapshots.parquet")
    want = []
    for e in range(8):
        began = None
        for w in writes[e * 8 : e * 8 + 8]:
            value = canonical(w[8])
            if began and (w[10] or value != began[0]):
                want.append((f"e{e}", *began, w[9]))
                began = None
            if not w[10] and not began:
                began = (value, w[9])
        if began:
            want.append((f"e{e}", *began, None))
    attributes = general_queries.p2_attributes(spark, str(tmp_path)).where("attribute = 'properties_json'")
    assert rows_of(attributes.select("semantic_id", "value", "start_snapshot", "end_snapshot")) == sorted(want, key=repr)
    history = general_queries.p2_history(spark, str(tmp_path))
    assert rows_of(history.select("semantic_id", "properties_json", "first_seen_snapshot", "end_snapshot")) == sorted(want, key=repr)


@pytest.mark.parametrize("a, b, same", [('{"a":1,"b":[]}', '{ "b" : [], "a": 1.0}', True), ('{"a":"\\u00e9"}', '{"a":"é"}', True), ('{"a":1}', '{"a":1} x', False), ("{", "{", True), ("{", "{}", False), ('{"a":1,"a":2}', '{"a":2}', True), ("NaN", "null", False), ('"x"', "x", False), ('{"a":1e2}', '{"a":100}', True)])
def test_json_values(a, b, same):
    assert (canonical(a) == canonical(b)) is same


# problem 3

NODES = "id long, snapshot_id string, project string, kind string, name string, qualified_name string, file_path string, start_line int, is_exported int, is_test int, is_entry_point int, properties string, seq string, change string"


def node(id, snapshot, qn, props="{}", project="p", kind="F", line=1):
    return (id, snapshot, project, kind, "n", qn, None, line, 1, 0, 0, props, "clash", "clash")


def changes(frame, nodes, snaps):
    return sorted(tuple(r)[1:] for r in snapshot_changes(frame(NODES, nodes), snaps).collect())


def test_changes(frame):
    nodes = [node(1, "s1", "a"), node(2, "s1", "b"), node(3, "s1", "A"), node(4, "s2", "a", "{ }", line=7), node(5, "s2", "b", '{"x":1}', kind="G"), node(6, "s2", "c"), node(7, "s2", "c", '{"x"'), node(8, "s4", "c", '{"x"'), node(9, "s9", "zz"), node(10, "s1", None), node(11, None, "zz"), node(12, "s1", "zz", project=None)]
    got = changes(frame, nodes + nodes[:2], snapshots(frame))  # s3 is an empty graph
    assert got == [("s2", "A", "removed", ""), ("s2", "b", "changed", "kind,properties"), ("s2", "c", "added", ""), ("s3", "a", "removed", ""), ("s3", "b", "removed", ""), ("s3", "c", "removed", ""), ("s4", "c", "added", "")]
    assert changes(frame, [], snapshots(frame)) == []
    assert changes(frame, nodes, frame(SNAPSHOTS, [])) == []


def test_changes_against_brute_force(frame, monkeypatch):
    rng = random.Random(3)
    nodes, state = [], {}
    for i in range(3000):
        project, s, qn = rng.choice(["p", "p", "q"]), rng.randrange(1, 7), f"k{rng.randrange(200)}"
        nodes.append(node(i, f"s{s}", qn, rng.choice(["{}", None, '{"a":1}', '{"a": 1.0}', "{"]), project, rng.choice("FG")))
        state[project, s, qn] = (nodes[-1][3], canonical(nodes[-1][11], "{}"))
    want = []
    for project, last in (("p", 6), ("q", 4)):
        for s in range(2, last + 1):
            for qn in {k[2] for k in state}:
                old, new = state.get((project, s - 1, qn)), state.get((project, s, qn))
                if old != new:
                    want.append((project, f"s{s}", qn, "added" if old is None else "removed" if new is None else "changed"))
    more = [(100 + i, f"s{i}", "q", "ready", day(i), None) for i in range(1, 5)]
    got = snapshot_changes(frame(NODES, nodes), snapshots(frame, count=6, more=more)).drop("columns")
    assert rows_of(got) == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9000), st.integers(0, 9000), st.integers(1, 3))
def test_bitmaps(seed, m, n, chunks):
    rng = np.random.default_rng(seed)
    a, b = (np.unique(rng.integers(0, chunks << 16, k)) for k in (m, n))
    x, y = Bitmap.of(a), Bitmap.of(b)
    assert np.array_equal((x & y).ordinals(), np.intersect1d(a, b))
    assert np.array_equal(x.and_not(y).ordinals(), np.setdiff1d(a, b))
    assert ARRAY_MAX == 4096


# problem 5

DAILY = "project string, date string, tokens_saved long, llm_cost double, written_at timestamp_ntz, day string, measure int"


def test_rolling(frame):
    rows = [("p", "2026-01-01", 10, 0.1, day(1), "", 0), ("p", "2026-01-01T00:00:00Z", 30, 0.3, day(2), "", 0), ("p", "2026-01-03 00:00:00", None, None, day(3), "", 0), ("p", "2026-01-09", 7, 0.7, None, "", 0), ("p", "soon", 7, 0.7, day(3), "", 0), (None, "2026-01-01", 7, 0.7, day(3), "", 0), ("p", None, 1, 1.0, day(1), "", 0)]
    got = {r.day: (int(r.tokens_saved_7d), int(r.tokens_saved_30d), float(r.llm_cost_7d)) for r in rolling_totals(frame(DAILY, rows + rows)).collect()}
    assert len(got) == 9
    assert got[date(2026, 1, 7)] == (30, 30, 0.3) and got[date(2026, 1, 8)] == (0, 30, 0.0) and got[date(2026, 1, 9)] == (7, 37, 0.7)
    assert rolling_totals(frame(DAILY, [])).count() == 0


def test_rolling_within_bounds(frame):
    rows = [("p", d, 1, 0.0, day(1), "", 0) for d in ("0001-01-01", "2026-01-01", "2026-01-04", "9999-12-31")]
    got = rolling_totals(frame(DAILY, rows), since="2020-01-01", until="2026-06-30")
    assert [(r.day, int(r.tokens_saved_7d)) for r in got.orderBy("day").collect()] == [(date(2026, 1, d), 1 + (d == 4)) for d in (1, 2, 3, 4)]


def test_bursts_against_brute_force(frame):
    rng = random.Random(5)
    values = {d: rng.choice([0, 0, 1, 50]) for d in range(120) if rng.random() < 0.6}
    rows = [("p", f"{day(d):%Y-%m-%d}", v, v / 10000, day(d), "", 0) for d, v in values.items()]
    first, last = min(values), max(values)
    want = [(day(d).date(), m) for d in range(first + 29, last + 1) for m in ("tokens_saved", "llm_cost") if sum(values.get(x, 0) for x in range(d - 6, d + 1)) * 30 > 2 * 7 * sum(values.get(x, 0) for x in range(d - 29, d + 1))]
    assert rows_of(bursts(rolling_totals(frame(DAILY, rows))).select("day", "measure")) == sorted(want, key=repr)
