"""Registration of named queries: a Spark function, and SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the function it decorates."""

        def register(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register

    def statement(self, name: str, text: str, **args: object) -> None:
        """Registers a parameterised statement: ``{table}`` names a table, ``:name`` a parameter.

        Spark runs it with named arguments, so a value never becomes text of the statement.
        """
        import re

        names = sorted(set(re.findall(r"\{(\w+)\}", text)))

        def run(spark: SparkSession, d: str) -> DataFrame:
            return spark.sql(text, args=dict(args), **{n: table(spark, d, n) for n in names})

        self.queries[name] = run
        plain = re.sub(r"\{(\w+)\}", r"\1", text)
        for k, v in args.items():
            plain = re.sub(rf":{k}\b", "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v), plain)
        self.sql[name] = plain
