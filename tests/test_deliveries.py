"""Problems 2 and 3 beyond `test_general.py`: JSON on the JVM, persistent ordinals, intervals."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.json_text import canonical, canonical_json
from loomgraph.operators import snapshot_diff as D
from loomgraph.operators.history import combine
from tests.conftest import rows_of
from tests.test_general import NODES, day, node, snapshots

TEXTS = [
    None, "", " ", "null", "1", " 1.0 ", "1e0", "10E-1", "-0.0", "1,2", "1],[2", "[1],[2]", '{"a":1}x', "{} {}", '{"a":1}],[{"b":2}', '{"a":1},"k":{"b":2}', '1},{"x":2',
    '{"a":1', "[1,]", "NaN", "{'a':1}", '{"b":1,"a":[1,2.50,{"d":null,"c":true}]}', '{"a":1,"a":2}', '{"é":"\\u00e9"}', '"\\u001f\\n\\t/"', '"\\ud83d\\ude00"', '"\U0001f600"', '"\\ud800"', "12345678901234567890123", "0.00001", "1e-5", "1E400", '{"a":"x]y"}', '["]"]', "﻿{}", "01", "// c\n1", '{"":0}', "[]", "{}", '{"a":"1e5"}', '"a\x7fb"', '{"A":1,"a":2,"_":3}', "tru", '"open', "[" * 50 + "]" * 50,
]


def test_json_of_any_text(frame):
    rows = frame("t string, i int", [(t, i) for i, t in enumerate(TEXTS)])
    got = {r.t: (r.a, r.b) for r in rows.select("t", canonical_json(F.col("t")).alias("a"), canonical_json(F.col("t"), "{}").alias("b")).collect()}
    assert got == {t: (canonical(t), canonical(t, "{}")) for t in TEXTS}
    assert canonical('"\\ud800"') == '"\\ud800"' and canonical("1e0") == canonical(" 1.0 ") == "1" and canonical("{} {}") == "\x00{} {}"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(-100, 100, width=16) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), min_size=20, max_size=40))
def test_json_of_any_value(spark, values):
    import json

    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(values)]
    texts = [t for t in texts if t.isprintable() or all(ord(c) < 0xD800 or ord(c) > 0xDFFF for c in t)]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_json(F.col("t")).alias("t")).collect()}
    assert got == {i: canonical(t) for i, t in enumerate(texts)}


def many(seed, count=1500):
    rng = random.Random(seed)
    return [node(i, f"s{rng.randrange(1, 7)}", f"k{rng.randrange(400)}", rng.choice(["{}", None, '{"a":1}', '{"a": 1.0}', "{"]), rng.choice("pq"), rng.choice("FG")) for i in range(count)]


@pytest.mark.parametrize("block, buckets", [(100_000, 1 << 14), (50, 3), (7, 1)])
def test_ordinals_given_or_counted(frame, monkeypatch, block, buckets):
    monkeypatch.setattr(D, "BUCKETS", buckets)
    rows = frame(NODES, many(1))
    more = [(100 + i, f"s{i}", "q", "ready", day(i), None) for i in range(1, 5)]
    plain = rows_of(D.snapshot_changes(rows, snapshots(frame, count=6, more=more)))
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    earlier = D.key_ordinals(rows.where("id % 3 = 0"))
    ordinals = D.key_ordinals(rows, earlier)
    assert plain and rows_of(D.snapshot_changes(rows, snapshots(frame, count=6, more=more))) == plain
    assert rows_of(D.snapshot_changes(rows, snapshots(frame, count=6, more=more), ordinals=ordinals)) == plain


def test_ordinals_persist(frame, monkeypatch):
    monkeypatch.setattr(D, "BUCKETS", 5)
    rows = frame(NODES, many(2))
    first = D.key_ordinals(rows.where("id % 2 = 0"))
    second = D.key_ordinals(rows, first)
    place = {(r.project, r.qualified_name): (r.bucket, r.ordinal) for r in second.collect()}
    assert all(place[r.project, r.qualified_name] == (r.bucket, r.ordinal) for r in first.collect())
    assert len(set(place.values())) == len(place) == rows.select("project", "qualified_name").distinct().count()
    for b in range(5):
        assert sorted(o for k, o in place.values() if k == b) == list(range(sum(k == b for k, _ in place.values())))


def test_ordinals_counted_while_streamed(frame, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "BUCKETS", 4)
    keys = D.key_ordinals(frame(NODES, many(3)))
    table = keys.orderBy("bucket", "project", "qualified_name").toPandas()
    for size in (1, 3, 1000):
        last, got = None, []
        for at in range(0, len(table), size):
            part = D._numbered(pa.Table.from_pandas(table[["bucket", "project", "qualified_name"]][at : at + size], preserve_index=False), last)
            got += part["ordinal"].to_pylist()
            last = tuple(part[c][-1].as_py() for c in ("bucket", "project", "qualified_name", "ordinal"))
        assert got == table["ordinal"].tolist()


def test_intervals_are_split_and_coalesced(frame):
    at = {i: day(i) for i in range(1, 9)}
    rows = [("a", 1, 3, "x"), ("a", 3, 6, "x"), ("a", 7, None, "x"), ("b", 1, 4, "y"), ("b", 4, 6, None), ("b", 7, None, "z")]
    schema = "project string, semantic_id string, attribute string, value string, start_snapshot string, start_at timestamp_ntz, start_seq int, end_snapshot string, end_at timestamp_ntz, end_seq int"
    intervals = frame(schema, [("p", "e", a, v, f"s{i}", at[i], i, j and f"s{j}", j and at[j], j) for a, i, j, v in rows])
    got = rows_of(combine(intervals, ("a", "b")).select("a", "b", "start_snapshot", "end_snapshot"))
    assert got == sorted([("x", "y", "s1", "s4"), ("x", None, "s4", "s6"), ("x", "z", "s7", None)], key=repr)
