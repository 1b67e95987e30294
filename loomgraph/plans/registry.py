"""Queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import lens


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def table(self, name: str, sql: str | None = None):
        """A query given (read, spark), where read(table name) is a table."""

        def add(f):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

            self._put(name, query, sql)
            return f

        return add

    def graph(self, name: str, sql: str | None = None, few_calls: bool = False, walks: bool = False):
        """A query given (nodes, edges) of the graph lens; `sql` may use g_nodes and g_edges.
        `few_calls`: see `lens.with_few_calls`; with `walks` it is given the graph's steps too."""

        def add(f):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                nodes, edges = lens.stored(spark, sf_dir)
                if walks:
                    return f(nodes, edges, lens.walk(spark, sf_dir))
                return f(nodes, lens.with_few_calls(spark, sf_dir, edges) if few_calls else edges)

            shown = lens.FEW_CALLS_SQL if few_calls else lens.LENS_SQL
            self._put(name, query, sql and shown + (sql if sql.lstrip().startswith(",") else " " + sql))
            return f

        return add

    def _put(self, name: str, query, sql: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is taken")
        query.__name__ = name
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql
