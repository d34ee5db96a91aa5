"""Keyword retrieval: query terms, body scores, postings with BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import compact
from corpusloom.session import materialize

_TERM = re.compile(r"[a-zA-Z0-9_+-]{2,}|[一-鿿]{2,}")
_ASCII = re.compile(r"[a-zA-Z0-9_+-]+")


def query_terms(query: str, expansions: dict[str, list[str]] | None = None) -> list[str]:
    """Terms of a query, longest first: words, CJK runs with their 2- to 4-grams, and the
    caller's expansions of markers found in it."""
    terms = set()
    for token in _TERM.findall(query.lower()):
        terms.add(token)
        if len(token) >= 4 and not token.isascii():
            terms |= {token[i : i + n] for n in (2, 3, 4) for i in range(len(token) - n + 1)}
    for marker, more in (expansions or {}).items():
        if marker in query.lower():
            terms |= set(more)
    return sorted(terms, key=lambda t: (-len(t), t))


def occurrences(body: Column, term: str, tokens: Column | None = None) -> Column:
    """How often a term occurs: as a whole token where it is ASCII, else as a substring."""
    if _ASCII.fullmatch(term):
        tokens = ascii_tokens(body) if tokens is None else tokens
        return F.size(tokens) - F.size(F.array_remove(tokens, term))
    return ((F.length(body) - F.length(F.replace(body, F.lit(term), F.lit("")))) / len(term)).cast("int")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-z0-9_+-]+)"), F.lit(1))


def staged(df: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """The columns a score reads, each computed once: compact body, its tokens, the source and its tokens."""
    low = df.withColumn("_low", F.lower(F.coalesce(text_col, F.lit("")))).withColumn("_name", F.lower(F.coalesce(source_col, F.lit(""))))
    return low.withColumns({"_body": compact(F.col("_low")), "_tokens": ascii_tokens(F.col("_low")), "_names": ascii_tokens(F.col("_name"))})


STAGED = ("_low", "_name", "_body", "_tokens", "_names")


def keyword_score(query: str, terms: list[str], topics: list[tuple[list[str], dict[str, float]]] = ()) -> Column:
    """Score of a staged text: four times the query's length where it holds the whole query, each
    term's weight times at most four hits, half the weight for a hit in the source. A text
    without any hit scores zero whatever its source. topics are (markers of the query, bonus of
    each marker of the text): they count where the query shows one of theirs."""
    body, name, whole = F.col("_body"), F.col("_name"), re.sub(r"\s+", "", query.lower())
    inner = F.when(body.contains(whole), 4.0 * len(whole)).otherwise(0.0) if len(whole) >= 2 else F.lit(0.0)
    outer = F.lit(0.0)
    for term in terms:
        weight = max(len(term), 2)
        inner = inner + F.least(occurrences(body, term, F.col("_tokens")), F.lit(4)) * float(weight)
        outer = outer + F.when(occurrences(name, term, F.col("_names")) > 0, weight * 0.5).otherwise(0.0)
    for markers, bonuses in topics:
        if any(m in whole for m in markers):
            for marker, bonus in bonuses.items():
                inner = inner + F.when(body.contains(marker), float(bonus)).otherwise(0.0)
    return F.when(inner > 0, inner + outer).otherwise(0.0)


def rank_score(raw: Column) -> Column:
    """Bounded, lower is better."""
    return F.round(1 / (1 + raw), 4)


def keyword_search(
    df: DataFrame, query: str, k: int, *, id_col: str, text_col: str = "text", source_col: str = "source", expansions: dict[str, list[str]] | None = None, topics: list[tuple[list[str], dict[str, float]]] = ()
) -> DataFrame:
    """The k best rows by keyword score with ties by source and id; nulls read as ''."""
    scored = staged(df, text_col, source_col).withColumn("raw_score", keyword_score(query, query_terms(query, expansions), topics)).drop(*STAGED)
    # Rows without a hit sort last: the condition stays above the limit and is not computed twice.
    return scored.orderBy(F.desc("raw_score"), source_col, id_col).limit(k).where("raw_score > 0")


def _hits(tokens: str, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf, length): the inverted index of lower-case ASCII tokens."""
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    rows = df.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn("length", F.size("tokens"))
    return rows.select("id", "length", F.explode("tokens").alias("token")).groupBy("id", "token", "length").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, id_col: str, text_col: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best rows by BM25 over the given tokens; statistics over all rows, texts tokenised once."""
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    counts = materialize(rows.select("id", F.size("tokens").alias("length"), *(_hits("tokens", t).alias(f"tf_{i}") for i, t in enumerate(terms))), "keywords-counts")
    stats = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _bm25_part(F.col(f"tf_{i}"), F.col(f"df_{i}"), k1, b)
    # One row of statistics: its size is proven.
    return counts.join(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def _bm25_part(tf: Column, df: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))


def search_many(index: DataFrame, queries: DataFrame, query_col: str, text_col: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of every query by BM25.

    index is the written result of postings: candidates of a query are the texts that share a
    token with it, met by a join on the token. Statistics are over the texts with a token. Queries
    with null text or without a token get no row; scores are compared at six decimals, ties by id.
    """
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]{2,})"), F.lit(1)))).alias("token")
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query_id"), tokens).distinct()
    stats = index.select("id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    met = index.join(asked.select("token").distinct(), "token", "left_semi")
    known = met.groupBy("token").agg(F.count("*").alias("df"))
    hits = asked.join(known, "token").join(met, "token").join(F.broadcast(stats))
    scores = hits.groupBy("query_id", "id").agg(F.round(F.sum(_bm25_part(F.col("tf"), F.col("df"), k1, b)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def like_terms(terms: list[str], english: bool = True) -> list[str]:
    """The terms worth a substring search: two long ones of other scripts, three of three signs,
    four of two, four English ones, ten at most."""
    other = [t for t in terms if not t.isascii()]
    chosen = other[:2] + [t for t in other if len(t) == 3][:3] + [t for t in other if len(t) == 2][:4] + ([t for t in terms if t.isascii()][:4] if english else [])
    return list(dict.fromkeys(chosen))[:10]


def candidates(df: DataFrame, query: str, *, id_col: str, text_col: str = "text", topic: list[str] = (), guidance: list[str] = ()) -> DataFrame:
    """(id, route): the texts a query may mean, each by the first route that finds it:
    0 a shared token, 1 a substring, 2 one of the topic terms together with one of guidance."""
    terms = query_terms(query)
    words = list(dict.fromkeys(re.findall(r"[a-z0-9_]{2,}", query.lower())))[:8]
    low = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).where("low is not null")
    held = low.withColumn("tokens", F.regexp_extract_all("low", F.lit("([a-z0-9_]{2,})"), F.lit(1)))
    within = lambda some: reduce(Column.__or__, (F.col("low").contains(t.lower()) for t in some), F.lit(False))
    routes = (F.arrays_overlap("tokens", F.array(*map(F.lit, words))) if words else F.lit(False), within(like_terms(terms)), within(topic) & within(guidance))
    route = F.when(routes[0], 0).when(routes[1], 1).when(routes[2], 2)
    return held.select("id", route.alias("route")).where("route is not null").groupBy("id").agg(F.min("route").alias("route"))
