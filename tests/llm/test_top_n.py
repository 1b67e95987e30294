"""Problem 4: brute force, and the defined cases of its docstring."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.queries import ORACLES, QUERIES
from loomgraph.llm.top_n import top_n, worst_functions
from tests.conftest import rows_of

SMALL = "/root/testdata/sf0.001"


def day(d):
    return datetime(2026, 1, 1) + timedelta(days=d)


HOTSPOTS = "hotspot_id long, project string, name string, qualified_name string, file_path string, complexity long, fan_in long, measured_at timestamp_ntz, position string"


def test_worst_functions(frame):
    rows = [(1, "p", "", "a", "./src/x.py", 5, None, day(1), "clash"), (2, "p", "", "b", "src\\x.py", 5, 3, day(1), ""), (3, "p", "", "b", "src/x.py", 1, 3, day(0), ""), (4, "p", "", "c", "src/x.py", None, 9, None, ""), (5, "p", "", "B", "src/x.py", 5, 3, day(1), ""), (6, "p", "", "d", None, 50, 3, day(1), ""), (7, "p", "", "e", "./", 50, 3, day(1), ""), (8, None, "", "f", "src/x.py", 1, 1, day(1), ""), (9, "p", "", None, "src/x.py", 0, 0, day(1), "")]
    got = [(r.project, r.position, r.hotspot_id) for r in worst_functions(frame(HOTSPOTS, rows + rows), 3).collect()]
    assert sorted(got, key=repr) == sorted([("p", 1, 5), ("p", 2, 2), ("p", 3, 1), (None, 1, 8)], key=repr)
    assert worst_functions(frame(HOTSPOTS, []), 3).count() == 0


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n_group_over_many_partitions(frame, n):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 50}", None if i % 97 == 0 else rng.randrange(20), i) for i in range(3000)]
    got = top_n(frame("g string, v long, id long", rows, 6), ["g"], [F.col("v").desc_nulls_last(), F.col("id").asc()], n)
    want = []
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += [(*r, i) for i, r in enumerate(ordered[:n], 1)]
    assert rows_of(got) == sorted(want, key=repr)


def test_group_that_is_all_of_several_partitions(frame):
    rows = [("only", 1, i) for i in range(4000)]
    got = top_n(frame("g string, v long, id long", rows, 8), ["g"], [F.col("v").desc_nulls_last(), F.col("id").asc()], 1500)
    assert rows_of(got) == sorted([(*r, i) for i, r in enumerate(rows[:1500], 1)], key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["p4_found", "p4_ranked"])
def test_rows_equal_the_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW hotspot_rows AS SELECT * FROM '{SMALL}/hotspot_rows.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, SMALL).select(*(c[0] for c in want.description))
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
