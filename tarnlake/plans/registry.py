"""Registration of queries with the SQL that each equals."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def registry(queries: dict, oracles: dict):
    """A decorator factory: query(sql) registers a function under its name, with its SQL if there is any."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query


def pick(values, key, step: int = 1):
    """The value at place (key / step) mod their number, as a column: cases for every row of a table."""
    at = (F.floor(F.col(key) / step) % len(values) + 1).cast("int")
    return F.element_at(F.array(*(F.lit(v) for v in values)), at)


def quoted(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def pick_sql(values, key: str, step: int = 1) -> str:
    """The SQL of pick()."""
    return f"([{', '.join(map(quoted, values))}])[({key} // {step}) % {len(values)} + 1]"


def has_sql(column: str, pattern: str) -> str:
    """SQL: whether the pattern occurs in any case. Escapes by code point are written out, as RE2 has none."""
    plain = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), pattern)
    return f"regexp_matches({column}, {quoted('(?i)' + plain)})"


def ladder_sql(steps, default) -> str:
    """SQL: the name of the first (name, condition) that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(n)}" for n, c in steps) + f" ELSE {quoted(default)} END"
