"""Context, citations, chat history and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context(df: DataFrame, group: str, rank: str, text: str, source: str, year: str, limit: int = 8000) -> DataFrame:
    """One context for each group: ranked blocks under a source header, cut at limit."""
    head = F.concat(F.lit("[source: "), F.coalesce(source, F.lit("unknown")), F.coalesce(F.concat(F.lit(" ("), F.col(year).cast("string"), F.lit(")")), F.lit("")), F.lit("]\n"))
    block = F.struct(F.col(rank).alias("rank"), F.concat(head, F.coalesce(text, F.lit(""))).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n")
    return df.groupBy(group).agg(joined.alias("context")).withColumn("context", F.when(F.length("context") > limit, F.concat(F.substring("context", 1, limit), F.lit("..."))).otherwise(F.col("context")))


def citations(source: Column) -> Column:
    """Aggregate: distinct sources as sorted list lines, '- N/A' for none."""
    names = F.array_sort(F.collect_set(F.coalesce(source, F.lit("unknown"))))
    return F.when(F.size(names) == 0, "- N/A").otherwise(F.array_join(F.transform(names, lambda s: F.concat(F.lit("- "), s)), "\n"))


def last_messages(df: DataFrame, conversation: str, *order, text: str, question: str | None = None, n: int = 10) -> DataFrame:
    """The last n messages of each conversation, without those that repeat the current question;
    the cut comes first, so fewer than n may remain."""
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(*order))
    last = df.withColumn("place", place).where(F.col("place") <= n)
    return last.where(~F.col(text).eqNullSafe(F.col(question))) if question else last


def hint_hits(cases: DataFrame, hints: str, names: DataFrame, name: str) -> DataFrame:
    """The cases with hit: whether any of their hints is contained in any name, whatever the case.
    Distinct names stream past the distinct hints, which the evaluation set bounds."""
    hint = cases.select(F.explode(hints).alias("hint")).distinct()
    held = names.select(F.lower(name).alias("name")).distinct().join(F.broadcast(hint), F.expr("contains(name, lower(hint))")).select("hint").distinct()
    found = held.agg(F.collect_set("hint").alias("held"))  # a subset of the hints
    return cases.join(F.broadcast(found)).withColumn("hit", F.coalesce(F.arrays_overlap(hints, "held"), F.lit(False))).drop("held")


def route_label(routes: Column) -> Column:
    """The one route all hits came by, 'mixed' for several, 'none' for none."""
    return F.when(F.size(routes) == 0, "none").when(F.size(routes) > 1, "mixed").otherwise(routes[0])
