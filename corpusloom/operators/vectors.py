"""Exact vector search: one query, many queries, and the two-route merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null where lengths differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - dot(a, b) / norm)


def nearest(df: DataFrame, query: list[float], k: int, *, vec_col: str = "embedding", id_col: str = "vec_id", max_distance: float | None = None) -> DataFrame:
    """The k rows nearest to one query vector; Spark keeps k rows a task and merges them."""
    rows = df.withColumn("distance", cosine_distance(F.col(vec_col), F.array(*map(F.lit, query)))).where("distance is not null")
    rows = rows.where(F.col("distance") <= max_distance) if max_distance is not None else rows
    return rows.orderBy("distance", id_col).limit(k)


QUERIES_AT_ONCE = 2_048  # query vectors that a task holds; more are taken in further passes


def nearest_many(df: DataFrame, queries: DataFrame, k: int, *, dim: int, vec_col: str = "embedding", id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
    """(query_id, id, distance, rank): the k rows nearest to every query vector, exactly.

    Queries are compared in blocks of bounded size; a task keeps k rows a query and Spark merges
    them. Vectors that are null, of another length than dim, zero or not finite take no part.
    Distances are compared at nine decimals, ties by id.
    """
    spark, found = df.sparkSession, None
    schema = "query_id long, id long, distance double"
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == block).select(F.col(query_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        asked = spark.sparkContext.broadcast(_unit_rows(part.where("id is not null and vec is not null").toArrow(), dim))

        def search(batches, asked=asked):
            names, wanted = asked.value
            best_d, best_i = np.full((len(names), 0), 2.0), np.zeros((len(names), 0), np.int64)
            for batch in batches:
                ids, x = _unit_rows(batch, dim)
                for at in range(0, len(ids), 2_048):
                    own = ids[at : at + 2_048]
                    d = np.hstack([best_d, np.round(1 - wanted @ x[at : at + 2_048].T, 9)])
                    i = np.hstack([best_i, np.broadcast_to(own, (len(names), len(own)))])
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_i.shape[1])), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query_id", "id", "distance"])

        hits = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null").mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _unit_rows(batch: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of (id, vec)."""
    rows = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True) if len(v) == dim and None not in v]
    x = np.array([v for _, v in rows], float).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.array([i for i, _ in rows], np.int64)[good], x[good] / norm[good][:, None]


def similarity(distance: Column) -> Column:
    """A vector distance as a percentage, never below zero."""
    return F.greatest(F.lit(0.0), 1 - distance / 2) * 100


def two_routes(df: DataFrame, query: list[float], k: int, preferred: Column, **options) -> DataFrame:
    """The k nearest of the preferred rows and of all rows, merged: of rows with the same text the
    preferred route's stays even if another is nearer, then the k best remain."""
    first = nearest(df.where(preferred), query, k, **options).withColumn("route", F.lit(0))
    both = first.unionByName(nearest(df, query, k, **options).withColumn("route", F.lit(1)))
    place = Window.partitionBy("text").orderBy("route", "distance", options.get("id_col", "vec_id"))
    kept = both.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
    return kept.orderBy("distance", options.get("id_col", "vec_id")).limit(k)
