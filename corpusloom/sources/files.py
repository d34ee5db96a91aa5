"""Reading documents from folders and writing results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import safe_name, strip, year_of

RECORD = "doc_id string, doc_type string, title string, content string, author string, category string, created_at string, is_resolved boolean, _corrupt_record string"
# Fixed value: the form of a header.
_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"


def read_texts(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(source, path, text, front_matter) of the .md and .txt files that are not empty;
    the header between --- lines leaves the text whether or not it parses. A missing folder gives no rows."""
    raw = _found(lambda: spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.{[mM][dD],[tT][xX][tT]}").withColumns({"source": F.col("_metadata.file_name"), "path": F.col("_metadata.file_path")}))
    raw = spark.createDataFrame([], "value string, source string, path string") if raw is None else raw
    rows = raw.select("source", "path", strip(F.col("value")).alias("text")).where("text <> ''")
    front = F.regexp_extract("text", _FRONT, 1)
    return rows.select("source", "path", strip(F.regexp_replace("text", _FRONT, "")).alias("text"), front_matter(front).alias("front_matter"))


def _found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The data, or None where the folder is missing."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def front_matter(header: Column) -> Column:
    """map of the top-level 'key: value' lines; null where there is no header."""
    lines = F.filter(F.split(header, "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    return F.when(header != "", F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1), "[\"']", ""))))))


def read_records(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(source, path, text, meta) of the JSON Lines records with content; bad lines are skipped.
    A record without an id is named after a hash of its content: lines of split files have no number."""
    raw = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.jsonl").json(folder)
    return record_documents(raw.withColumn("path", F.col("_metadata.file_path")).where("_corrupt_record is null"))


def record_documents(raw: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    name = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.hex(F.xxhash64("content")))
    meta = F.struct("doc_type", "title", "author", "category", "created_at", "is_resolved", year_of(F.col("created_at")).alias("year"))
    return raw.where(strip(F.col("content")) != "").select(F.concat_ws("_", stem, name).alias("source"), "path", F.col("content").alias("text"), meta.alias("meta"))


def write_markdown(df: DataFrame, folder: str, title: str, body: str, *fields: str) -> None:
    """One Markdown text for each row, in folders by file name."""
    bullets = [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col(title)), F.lit(""), *bullets, F.lit(""), F.col(body))
    df.select(text.alias("value"), safe_name(F.col(title)).alias("name")).write.partitionBy("name").text(folder)


def write_results(summary: DataFrame, results: DataFrame, folder: str) -> None:
    """A one-row summary and the rows behind it as JSON Lines under one folder."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    results.write.mode("overwrite").json(f"{folder}/results")
