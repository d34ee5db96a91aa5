"""Lenient JSON and the merging of metadata from several origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record types that are categories of their own.
RECORD_CATEGORIES = ("ticket", "error_log", "slack", "manual")
FIELDS = "author string, year string, category string, language string, summary string"


def lenient_json(raw: Column) -> Column:
    """struct of the five metadata fields from a model's reply: fenced, commented or with
    trailing commas; else field by field; nulls where nothing is found."""
    body = F.regexp_extract(F.regexp_replace(raw, r"```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    strict = F.from_json(mended, FIELDS)
    one = lambda k: F.nullif(F.regexp_extract(raw, rf'"{k}"\s*:\s*"?([^",}}\n]*)', 1), F.lit(""))
    each = {k: F.when(F.trim(one(k)) == "null", None).otherwise(F.trim(one(k))) for k in ("author", "year", "category", "language", "summary")}
    return F.struct(*(F.coalesce(strict[k], v).alias(k) for k, v in each.items()))


def whole_year(value: Column) -> Column:
    return value.try_cast("double").try_cast("int")


def merge(front: dict[str, Column], model: dict[str, Column]) -> dict[str, Column]:
    """Front-matter values override the model's where they are not empty; a summary never does."""
    merged = {k: F.coalesce(F.nullif(front[k].cast("string"), F.lit("")), model[k].cast("string")) if k in front else model[k].cast("string") for k in ("author", "year", "category", "language")}
    return {**merged, "year": whole_year(merged["year"]), "summary": model["summary"]}


def record_category(category: Column, doc_type: Column) -> Column:
    """The category, else the record type where it is one, else general."""
    return F.coalesce(F.nullif(category, F.lit("")), F.when(doc_type.isin(*RECORD_CATEGORIES), doc_type), F.lit("general"))
