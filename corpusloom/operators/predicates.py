"""Metadata filters as Spark predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


OPERATORS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def coerced(filters: dict[str, Any]) -> dict[str, Any]:
    """The usable filters of a request: empty ones are left out, as is a year that is no number; all others read as text."""
    out: dict[str, Any] = {}
    for key, value in filters.items():
        if not value:
            continue
        try:
            out[key] = int(value) if key == "year" else str(value)
        except (TypeError, ValueError):
            continue
    return out


def predicate(where: dict[str, Any]) -> Column:
    """{'year': 2024, 'category': {'$in': [...]}}; several keys mean and; $and and $or nest."""
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, map(predicate, value)))
        elif isinstance(value, dict):
            parts += [OPERATORS[name](F.col(key), operand) for name, operand in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(Column.__and__, parts, F.lit(True))


def _keys(where: dict[str, Any]) -> set[str]:
    return set().union(*({k} if k[0] != "$" else set().union(*map(_keys, v)) for k, v in where.items()))


def filtered(df: DataFrame, where: dict[str, Any] | None = None, contains: str | None = None, text_col: str = "text", flag: str | None = None) -> DataFrame:
    """Rows that meet the filter. A filter on unknown columns or operators falls away, and the text
    condition with it; flag names a boolean column that says whether that happened."""
    usable = not where or (_keys(where) <= set(df.columns) and _known(where))
    if usable and where:
        df = df.where(predicate(where))
    if usable and contains:
        df = df.where(F.col(text_col).contains(contains))
    return df.withColumn(flag, F.lit(not usable)) if flag else df


def _known(where: dict[str, Any]) -> bool:
    return all(all(map(_known, v)) if k in ("$and", "$or") else not isinstance(v, dict) or v.keys() <= OPERATORS.keys() for k, v in where.items())
