"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import events as S
from tests.conftest import rows_of

T0 = datetime(2026, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


@pytest.fixture()
def stream(spark, tmp_path):
    """stream(schema, batches, transform, mode): all rows a query emits over the batches."""

    def go(schema, batches, transform, mode="append", timeouts=False):
        folder = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        query = transform(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination(20 if timeouts else 120)  # a query with timeouts goes on waiting for them
        query.stop()
        assert query.exception() is None
        return rows_of(spark.sql("SELECT * FROM out"))

    return go


LATE = [("zz", at(10**6), "p", 0, "zz")]
EVENTS = "event_id string, at timestamp, project string, tokens_saved long, path string"


def test_once(stream):
    rows = [("a", at(0), "p", 1, ""), ("b", at(1), "p", 1, ""), ("a", at(2), "p", 1, "")]
    got = stream(EVENTS, [rows, [("a", at(3), "p", 1, "")]], lambda s: S.once(s).select("event_id"))
    assert got == [("a",), ("b",)]


def test_debounced(stream):
    rows = [("1", at(0), "p", 0, "f"), ("2", at(0.3), "p", 0, "f"), ("3", at(0.9), "p", 0, "f"), ("4", at(0.1), "p", 0, "g")]
    got = [r for r in stream(EVENTS, [rows, LATE, LATE], S.debounced) if r[0] != "zz"]
    assert sorted((p, n) for p, _, n in got) == [("f", 1), ("f", 2), ("g", 1)]


def test_daily_and_sessions(stream):
    rows = [("1", at(0), "p", 5, ""), ("2", at(3600), "p", 6, ""), ("3", at(90_000), "p", 7, "")]
    got = [r for r in stream(EVENTS, [rows, LATE, LATE], S.daily) if r[2]]
    assert sorted((n, k) for _, _, n, k in got) == [(7, 1), (11, 2)]


def test_first_seen(stream):
    schema = "event_id string, at timestamp, project string, session_id string, files array<string>"
    got = stream(schema, [[("1", at(0), "p", "s", ["a", "b", "a"])], [("2", at(1), "p", "s", ["b", "c", None]), ("3", at(1), "p", "t", None)]], S.first_seen, timeouts=True)
    assert got == [("p", "s", "1", 2, 2), ("p", "s", "2", 2, 1), ("p", "t", "3", 0, 0)]


def test_settled(stream):
    schema = "id long, project string, tool string, at timestamp, read boolean"
    rows = [(1, "p", "x", at(0), False), (2, "p", "x", at(500), False), (3, "p", "x", at(60), True), (4, "q", "x", at(60), True)]
    late = [(9, "z", "z", at(10**6), False), (9, "z", "z", at(10**6), True)]
    split = lambda s: S.settled(s.where("not read").drop("read"), s.where("read").drop("read")).select("id", F.col("read_at").isNotNull())
    got = stream(schema, [rows, late, late], split)  # filtered here: a pushed filter would hide late rows from the watermark
    assert [r for r in got if r[0] < 9] == [(1, True), (2, False)]


def test_replace_files_is_idempotent(spark, frame, tmp_path):
    table = str(tmp_path / "t")
    extract = lambda batch: batch.select(F.col("path").alias("file_path"), F.explode(F.split("content", " ")).alias("name"))
    write = S.replace_files(table, extract)
    write(frame("path string, content string", [("a", "x y"), ("b", "z")]), 0)
    for _ in range(2):  # the second is a repeated batch
        write(frame("path string, content string", [("a", "w")]), 1)
    assert S.current_version(spark, table) == 1
    assert rows_of(spark.read.parquet(f"{table}/v1")) == [("a", "w"), ("b", "z")]


def test_traces(frame):
    nodes = frame("id long, qualified_name string", [(1, "a"), (2, "b")])
    known = frame("source_id long, target_id long, type string", [(2, 1, "ASYNC_CALLS")])
    traces = [("http_call", "a", "b"), ("http_call", "a", "b"), ("http_call", "a", "zz"), ("async_call", "b", "a"), ("odd", "a", "b"), ("channel_message", None, "b"), ("channel_message", "b", "a")]
    assert rows_of(S.ingest_traces(frame("type string, from string, to string", traces), nodes, known)) == [(1, 2, "HTTP_CALLS"), (2, 1, "CHANNEL")]
