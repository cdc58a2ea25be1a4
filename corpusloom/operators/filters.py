"""Row filters on scalar columns, pushed-down filter text, and permissions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.schemas import DEFAULT_DEPARTMENTS

_RANGE = {
    "$gte": lambda c, v: c >= v, "$gt": lambda c, v: c > v, "$lte": lambda c, v: c <= v,
    "$lt": lambda c, v: c < v, "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v,
}
_TEXT = {"$gte": ">=", "$gt": ">", "$lte": "<=", "$lt": "<", "$eq": "=", "$ne": "<>"}


def condition(name: str, expected: object) -> Column:
    """A list: membership, null counting as empty text; a dict: a range, never of null, unknown operators without
    effect; else null-safe equality. An empty list matches nothing."""
    c = F.col(name)
    if isinstance(expected, (list, tuple)):
        has_none = any(v is None for v in expected)
        values = [v for v in expected if v is not None]
        known = F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)
        return known | c.isNull() if has_none or "" in values else known
    if isinstance(expected, dict):
        parts = [_RANGE[op](c, v) for op, v in expected.items() if op in _RANGE]
        return reduce(lambda a, b: a & b, parts, c.isNotNull())
    return c.eqNullSafe(F.lit(expected))


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    for name, expected in filters.items():
        df = df.filter(condition(name, expected))
    return df


def _quoted(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else json.dumps(v)


def pushdown_text(filters: dict) -> str:
    """The filter as SQL text for where(), of comparisons that a Parquet scan takes over; null and empty values, also in
    lists, are left out, as are empty lists. Where nothing is left the text is empty."""
    out = []
    for name, expected in filters.items():
        column = f"`{name}`"
        if isinstance(expected, dict):
            out += [f"{column} {_TEXT[op]} {_quoted(v)}" for op, v in expected.items() if op in _TEXT and v not in (None, "")]
        elif isinstance(expected, (list, tuple)):
            values = [v for v in expected if v not in (None, "")]
            out += [f"{column} in ({', '.join(map(_quoted, values))})"] if values else []
        elif expected not in (None, ""):
            out.append(f"{column} = {_quoted(expected)}")
    return " and ".join(out)


def pushed(df: DataFrame, filters: dict) -> DataFrame:
    text = pushdown_text(filters)
    return df.where(text) if text else df


def permitted(filters: dict, allowed: list[str] | None = None, superuser: bool = False) -> dict:
    """filters with the user's departments, cut down to those asked for; an empty cut matches nothing."""
    if superuser:
        return filters
    mine = list(DEFAULT_DEPARTMENTS if allowed is None else allowed)
    asked = filters.get("department")
    if asked is not None:
        asked = asked if isinstance(asked, (list, tuple)) else [asked]
        mine = [d for d in mine if d in asked]
    return {**filters, "department": mine}


def owned(df: DataFrame, user_id: int, superuser: bool = False) -> DataFrame:
    return df if superuser else df.filter(F.col("user_id") == user_id)


def expired(df: DataFrame, now: Column, hours: int = 24, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
