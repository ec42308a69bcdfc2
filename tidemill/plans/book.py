"""How a module of plans notes its queries, and values that rows get in turn."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Book:
    """Queries and oracles by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a function under its name, with the SQL that says the same."""

        def note(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return note


def pick(key: Column, values: Sequence[str]) -> Column:
    """One of the values by the remainder of a key."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(key: str, values: Sequence[str]) -> str:
    """The SQL of ``pick``."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"
