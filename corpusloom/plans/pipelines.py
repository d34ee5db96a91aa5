"""End-to-end plans: documents to chunks, and a question through the retrieval cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.metadata import record_category, whole_year
from corpusloom.functions.text import block_starts, clean_text, guess_category, placed_chunks, text_blocks


def chunks(documents: DataFrame, *keep: str, text_col: str = "text", size: int = 700, overlap: int = 120) -> DataFrame:
    """One row for each chunk with the kept columns, chunk_id and offsets; one narrow stage."""
    staged = documents.select(*keep, clean_text(F.col(text_col)).alias("_text"))
    staged = staged.withColumn("_blocks", text_blocks(F.col("_text"), size)).withColumn("_starts", block_starts(F.col("_blocks")))
    cut = F.posexplode(placed_chunks(F.col("_text"), F.col("_blocks"), F.col("_starts"), size, overlap, 40)).alias("chunk_id", "chunk")
    return staged.select(*keep, cut).select(*keep, "chunk_id", "chunk.text", "chunk.char_start", "chunk.char_end")


STRATEGIES = ("merge", "model_only", "record_only")


def process_documents(rows: DataFrame, strategy: str = "merge") -> DataFrame:
    """The rows (origin, key, name, doc_type, created_at, front, record, model) with one set of metadata.

    front, record and model are structs of author, year, category, language and summary as text; a
    null struct is absent. merge: records (a doc_type or a created_at) take their own values, other
    documents the front matter over the model's. model_only: the model's alone. record_only: no
    model; with front matter its values, and 'general' where it has no category (an empty one
    stays), else records their own. Where nothing is given the category follows the file name,
    the language is zh, the summary empty; empty authors and year 0 read as null.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    is_record = F.coalesce(F.col("doc_type") != "", F.lit(False)) | F.coalesce(F.col("created_at") != "", F.lit(False))
    given = lambda origin, k: F.nullif(F.col(origin)[k], F.lit(""))
    own_category = record_category(F.col("record")["category"], F.col("doc_type"))
    values = {}
    for k in ("author", "year", "category", "language", "summary"):
        record = own_category if k == "category" else given("record", k)
        if strategy == "merge":
            values[k] = F.when(is_record, record).otherwise(given("model", k) if k == "summary" else F.coalesce(given("front", k), given("model", k)))
        elif strategy == "model_only":
            values[k] = given("model", k)
        else:
            front = F.coalesce(F.col("front")[k], F.lit("general")) if k == "category" else given("front", k)
            values[k] = F.when(F.col("front").isNotNull(), front).otherwise(F.when(is_record, record))
    year = F.nullif(whole_year(values["year"]), F.lit(0))
    return rows.select(
        "origin", "key", values["author"].alias("author"), year.alias("year"), F.coalesce(values["category"], guess_category(F.col("name"))).alias("category"),
        F.coalesce(values["language"], F.lit("zh")).alias("language"), F.coalesce(values["summary"], F.lit("")).alias("summary"),
    )


def cascade(routes: list[DataFrame], query: str, id_col: str, k: int) -> DataFrame:
    """Hits (query, id, score: lower is better) of the first route that has any for a query; the k best of each query.
    All routes are one union ranked by route, so that the choice is made per query in one plan."""
    every = None
    for place, hits in enumerate(routes):
        part = hits.select(query, id_col, "score").withColumn("route", F.lit(place))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(query).agg(F.min("route").alias("route"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("score", id_col))
    return every.join(first, [query, "route"]).withColumn("place", rank).where(F.col("place") <= k)
