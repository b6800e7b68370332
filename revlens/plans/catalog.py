"""Registry of named queries: a Spark callable and (where SQL can say it) a DuckDB twin.

Every query reads the driver's parquet tables from ``sf_dir`` (or tables that
Spark derives from them) and runs over all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _wrap_calls(sql: str, key: str, typ: str) -> str:
    """Wrap every ``key...)`` call (matching parentheses, quotes skipped) in CAST(... AS typ)."""
    out, i = [], 0
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, quoted = 1, j + len(key), False
        while depth:
            ch = sql[k]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += {"(": 1, ")": -1}.get(ch, 0)
            k += 1
        inner = _wrap_calls(sql[j + len(key):k - 1], key, typ)
        out.append(sql[i:j] + f"CAST({key}{inner}) AS {typ})")
        i = k


def _bigint_counts(sql: str) -> str:
    """DuckDB result types aligned with Spark's: count_if -> BIGINT, row_number -> INTEGER."""
    return _wrap_calls(_wrap_calls(sql, "count_if(", "BIGINT"), "row_number() OVER (", "INTEGER")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _bigint_counts(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from revlens.plans import classification, cleaning, dashboards, files_q, histories, industry, retrieval_q, themes_q, plans_q, streams_q  # noqa: F401
