"""The registry, its SQL, and the independence of the core from the llm subpackage."""

import os
import subprocess
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from loomgraph.plans import general_queries, graph_queries, language_queries, resolve_queries, search_queries, source_queries, stats_queries, tool_queries, usage_queries

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
#: One or two of each family; the driver compares all of them on more rows.
SAMPLED = ["p1_found", "p2_found", "p3_found", "p5_found", "op20_structured_search", "op31_incident_counts", "op54_hotspots", "op59_invariants", "op66_look_back", "op70_order_statistics", "op77_evidence", "op84_role_quotas", "op110_bfs_both", "op161_grep", "op180_path_groups"]


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 100


def test_names_are_unique_over_modules():
    modules = (general_queries, graph_queries, language_queries, resolve_queries, search_queries, source_queries, stats_queries, tool_queries, usage_queries)
    assert max(Counter(name for m in modules for name in m.QUERIES).values()) == 1


def test_core_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not any(q.startswith(('p4', 'p6', 'p7', 'p8')) for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for path in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "loomgraph.llm" not in path.read_text()


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLED)
def test_rows_equal_the_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    got = entry.queries()[name](spark, SMALL)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())
