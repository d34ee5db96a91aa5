"""The training-text queries, their SQL where SQL can say it, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import garbled, languages, leakage, lookalike, mixing, neardup, neighbours, sentences
from corpusloom.llm.sql import ORACLE_SQL as ORACLE_SQL
from corpusloom.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.similar_pairs(load(spark, sf_dir, "embedding_objects"), "vec_id", "embedding", k=10, min_similarity=0.94, window=128)
    return pairs.select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth id, out of all vectors."""
    near = neighbours.most_similar(load(spark, sf_dir, "embedding_objects"), "vec_id", "embedding", 10, query="id % 100 = 0")
    return near.select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.look_alike_pairs(load(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document whose text stands for its look-alike class."""
    classes = lookalike.canonical_classes(load(spark, sf_dir, "documents"), "doc_id", "text")
    return classes.select(F.col("id").alias("doc_id"), F.col("class_id").alias("canonical_doc_id"))


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p8_found": p8_found, "p8_canonical": p8_canonical}


def _near_duplicates_of(spark: SparkSession, sf_dir: str, task, **options) -> DataFrame:
    """The task over the three fields, each table with its own keys."""
    parts = []
    for tab, key, field, k in (("documents", "doc_id", "text", 8), ("questions", "question_id", "body", 8), ("articles", "article_id", "title", 3)):
        found = task(load(spark, sf_dir, tab).select(key, field), key, field, k=k, threshold=0.6, **options)
        parts.append(found.withColumn("tab", F.lit(tab)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near_duplicates_of(spark, sf_dir, neardup.near_duplicate_pairs)
    return pairs.select("tab", F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its near-duplicate group and its number of links."""
    return _near_duplicates_of(spark, sf_dir, neardup.near_duplicate_groups).select("tab", F.col("key").alias("row_key"), "group_id", "links")


def p5_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups by weighted shingles: each counts as often as it occurs (probability Jaccard)."""
    return _near_duplicates_of(spark, sf_dir, neardup.near_duplicate_groups, weighted=True).select("tab", F.col("key").alias("row_key"), "group_id", "links")


QUERIES |= {"p5_found": p5_found, "p5_groups": p5_groups, "p5_weighted": p5_weighted}


def _decoded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_key"), "text")
    articles = load(spark, sf_dir, "articles").select(F.lit("articles").alias("tab"), F.col("article_id").try_cast("long").alias("row_key"), F.col("description").alias("text"))
    return documents.unionByName(articles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_records(_decoded_fields(spark, sf_dir))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected records with their text restored as far as it can be."""
    return garbled.restore(_decoded_fields(spark, sf_dir))


QUERIES |= {"p2_found": p2_found, "p2_restored": p2_restored}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "sentence_sample").select("doc_id"), "doc_id", "left_semi")
    units = sentences.sentences(sample, "doc_id", "text", "source")
    return units.select(F.col("id").alias("doc_id"), "char_start", "char_end")


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    units = sentences.sentences(load(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return units.select(F.col("id").alias("doc_id"), "char_start", "char_end", "sentence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.found_labels(load(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return found.select(F.col("id").alias("doc_id"), "lang_code", "role")


def p4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of its passages in other languages."""
    rows = languages.label_passages(load(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return rows.select(F.col("id").alias("doc_id"), "role", "lang_code", F.round("confidence", 6).alias("confidence"), "first_unit", "last_unit")


QUERIES |= {"p3_found": p3_found, "p3_units": p3_units, "p4_found": p4_found, "p4_passages": p4_passages}


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_cases"), "item_id", "passage", "question")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("kind = 'run'").select(F.col("id").alias("doc_id"), "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into, as a run or paraphrased, and the best cover."""
    counts = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("kind") == "run").alias("documents"), F.count_if(F.col("kind") == "paraphrase").alias("paraphrases"), F.round(F.max("covered"), 6).alias("best_cover"))
    return load(spark, sf_dir, "eval_cases").select("item_id").join(counts, "item_id", "left").na.fill(0, ["documents", "paraphrases"])


QUERIES |= {"p6_found": p6_found, "p6_items": p6_items}


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.curriculum(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", TOKENIZER)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of every mix with their repeats and training positions."""
    return _mix(spark, sf_dir)[0].select("mix_name", "source", F.col("id").alias("doc_id"), "epoch", "tokens", F.round("position", 9).alias("position"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual token shares of every mix and source."""
    return _mix(spark, sf_dir)[1].select("mix_name", "source", "target_share", "tokens", "documents", F.round("actual_share", 9).alias("actual_share"), "most_repeats")


QUERIES |= {"p7_mix": p7_mix, "p7_shares": p7_shares}
