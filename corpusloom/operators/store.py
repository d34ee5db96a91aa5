"""The chunk store: upsert, new rows only, statistics, ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by the given columns; rows with a null key are dropped."""
    rest = [c for c in df.columns if c != key]
    value = F.max_by(F.struct(*rest), F.struct(*order)).alias("v")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(value).select(key, "v.*")


def upsert(spark, folder: str, rows: DataFrame, key: str, version: str, buckets: int = 64) -> None:
    """Merges rows into the store at folder by key, the latest version winning; creates it if absent.

    Rows live in buckets of the key's hash; only touched buckets are rewritten, as a new
    generation beside the old one. A one-file pointer then names the generation of every bucket.
    Readers follow the last complete pointer, so a crash at any step leaves the state before;
    calling again with the same rows gives the state after. Null keys are dropped.
    """
    last = _pointer(spark, folder)
    number = 0 if last is None else last.first()["number"]
    fresh = rows.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most so many buckets
    if not touched and last is not None:
        return
    old = None if last is None else _stored(spark, folder, last.where(F.col("bucket").isin(touched)))
    merged = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
    last_wins(merged, key, version).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/generation={number + 1}")
    now = spark.createDataFrame([(b, number + 1) for b in touched], "bucket int, generation int")
    if last is not None:
        now = now.unionByName(last.select("bucket", "generation").where(~F.col("bucket").isin(touched)))
    now.coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointer/number={number + 1}")


def _pointer(spark, folder: str) -> DataFrame | None:
    """(number, bucket, generation) of the last complete pointer; null before the first upsert."""
    try:
        every = spark.read.parquet(f"{folder}/pointer")
    except AnalysisException:
        return None
    number = every.agg(F.max("number")).first()[0]
    return None if number is None else every.where(F.col("number") == number)


def _stored(spark, folder: str, pointer: DataFrame) -> DataFrame | None:
    # One row a bucket: bounded by the number of buckets.
    places = [(r.bucket, r.generation) for r in pointer.select("bucket", "generation").collect()]
    if not places:
        return None
    return spark.read.option("basePath", f"{folder}/rows").option("mergeSchema", True).parquet(*(f"{folder}/rows/generation={g}/bucket={b}" for b, g in places)).drop("generation")


def read_store(spark, folder: str) -> DataFrame:
    """The current rows of the store; a missing store raises ValueError."""
    last = _pointer(spark, folder)
    rows = None if last is None else _stored(spark, folder, last)
    if rows is None:
        raise ValueError(f"no store at {folder}")
    return rows.drop("bucket")


def drop_collection(spark, table: str, confirm: bool = False) -> None:
    if not confirm:
        raise ValueError("dropping a collection needs confirm=True")
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def corpus_stats(df: DataFrame, source_col: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct(source_col).alias("source_count"))


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group; partial limits run before the shuffle."""
    place = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def with_ordinal(df: DataFrame, *order: str, name: str = "doc_idx") -> DataFrame:
    """A gapless global index in the given order: range-sorted partitions and their offsets,
    never one window over everything."""
    from corpusloom.session import materialize

    placed = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordinal")
    sizes = placed.groupBy("part").count()
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("place", place).join(F.broadcast(offsets.select("part", "offset")), "part").withColumn(name, F.col("offset") + F.col("place")).drop("part", "place", "offset")


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, median): exact, without one group's values in one task. A quantile sketch with
    a proven rank error brackets the middle; only the few values inside the bracket are ranked. Null values are left out."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", [0.499, 0.501], 10_000).alias("q"))
    met = rows.join(F.broadcast(stats.withColumnRenamed("g", "h")), F.expr("g <=> h"))  # a row a group
    # Values below the bracket are counted, those inside by value.
    counts = met.where(F.col("v") <= F.col("q")[1]).groupBy("g", "n", "mean", F.when(F.col("v") >= F.col("q")[0], F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    seen = F.sum("c").over(Window.partitionBy("g").orderBy(F.asc_nulls_first("v")))
    placed = counts.withColumn("seen", seen)
    low = F.min(F.when(F.col("seen") >= F.floor((F.col("n") + 1) / 2), F.col("v")))
    high = F.min(F.when(F.col("seen") >= F.floor(F.col("n") / 2) + 1, F.col("v")))
    return placed.groupBy("g").agg(F.max("mean").alias("mean"), ((low + high) / 2).alias("median")).withColumnRenamed("g", group)


def first_found(df: DataFrame, key: str, preference: Column, *order) -> DataFrame:
    """One row for each key: the one of the least preference, then of the least order columns."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(preference, *order)).alias("v")
    return df.groupBy(key).agg(best).select(key, "v.*")
