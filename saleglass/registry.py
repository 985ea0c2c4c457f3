"""All queries of the sales engine by name, and their DuckDB SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "") -> Callable:
    """Register a function of (spark, sf_dir) under ``name``. Dates leave as text, in Spark and (the columns named in
    ``dates``) in SQL."""

    def add(run: Callable) -> Callable:
        assert name not in QUERIES, name

        @functools.wraps(run)
        def edge(spark, sf_dir):
            df = run(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})

        QUERIES[name] = edge
        if sql is not None:
            texts = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split())
            SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return run

    return add


for _module in ("rollups", "listings", "joins", "audits", "coverage", "text", "titles", "pages", "merges", "streams"):
    importlib.import_module(f"saleglass.plans.{_module}")
