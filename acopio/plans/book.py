"""A module's queries and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None, doubles: tuple[str, ...] = ()):
        """Register a function (spark, sf_dir) under its name, with SQL for the same rows.

        ``doubles``: whole-number columns with nulls, given as doubles on both sides.
        """

        def add(f):
            @wraps(f)
            def run(spark, sf_dir):
                return f(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in doubles})

            self.queries[f.__name__] = run if doubles else f
            if sql:
                changed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles)
                self.sql[f.__name__] = f"SELECT * REPLACE ({changed}) FROM ({sql})" if doubles else sql
            return f

        return add
