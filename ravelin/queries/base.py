"""Registration, table access, and SQL text built from the same constants as the expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def rows(values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in values) + ")"


def cell(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else q(x)


def replaced(expr: str, rules) -> str:
    """Nested regexp_replace for DuckDB; $n becomes \\n."""
    for pattern, to in rules:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    return expr


SPACE = r"[\s\p{Z}]"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACE}+'), lambda w: w <> '')"
