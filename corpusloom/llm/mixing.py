"""Problem 7: mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time that integrates to its target
share. Its integral is the source's cumulative token demand; inverting it at a
document's place in the source's token sequence gives the document's training
position, and the plan is range-sorted by position. Small sources repeat in whole
epochs up to their cap; the total is the largest for which every share is met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096  # parts of a source whose running sums are taken apart from one another
LEAN = 0.5  # how far a weight may drift from its share over the training, as a share of it


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str):
    """A column function: tokens of a text under the byte-level vocabulary file at path."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)), na_action="ignore").astype("Int64")

    return count


def curriculum(documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, *, lean: float = LEAN, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(plan, shares) for the mixes of targets (mix_name, source, target_share, max_repeats).

    plan: mix_name, source, id, epoch, tokens, position (0 to 1), sorted by mix and position.
    shares: one row for each mix and source with its actual tokens and share.

    A document of a null source, with a null id or without a token takes no part. A source
    without documents gets nothing and its share is spread over the others in proportion;
    shares reports it with zero. A null share or cap counts as zero. The last document of a
    source is taken if more than half of it fits its demand: a source misses its quota by half a document at most. Repeated ids are documents of their own.
    """
    counted = materialize(
        documents.where(F.col(source_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), token_counts(tokenizer)(text_col).alias("tokens"))
        .where("tokens > 0").withColumn("dice", F.xxhash64("id", "source", F.lit(seed))).withColumn("bucket", F.pmod("dice", F.lit(BUCKETS))),
        "mix-tokens",
    )
    # Running token sums: buckets first, then within a bucket, so that no source meets in one task.
    buckets = counted.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("dice", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(offsets.select("source", "bucket", "offset"), ["source", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))

    held = buckets.groupBy("source").agg(F.sum("size").alias("available"))
    wanted = targets.select("mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    mix = Window.partitionBy("mix_name")
    usable = wanted.join(held, "source").where("target_share > 0 and max_repeats > 0").withColumn("share", F.col("target_share") / F.sum("target_share").over(mix))
    total = F.min(F.col("max_repeats") * F.col("available") / F.col("share")).over(mix)
    # The weight of a source at time t is share + drift * (t - 1/2); the drifts of a mix sum to nothing.
    rank = (F.row_number().over(mix.orderBy("source")) - 1) / F.greatest(F.count("*").over(mix) - 1, F.lit(1)) * 2 - 1
    demand = usable.withColumn("total", total).withColumn("side", rank)
    demand = demand.withColumn("drift", F.col("share") * (F.col("side") - F.sum(F.col("share") * F.col("side")).over(mix)) * F.lit(lean))
    demand = materialize(demand.withColumn("quota", F.col("share") * F.col("total")), "mix-demand")

    copies = placed.join(demand, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    copies = copies.withColumn("from", F.col("epoch") * F.col("available") + F.col("start")).where(F.col("from") + F.col("tokens") / 2 <= F.col("quota"))
    # Demand up to t, over total: (share - drift/2) t + drift/2 t^2; its inverse at the copy's middle.
    y = (F.col("from") + F.col("tokens") / 2) / F.col("total")
    b = F.col("share") - F.col("drift") / 2
    position = 2 * y / (b + F.sqrt(F.greatest(b * b + 2 * F.col("drift") * y, F.lit(0.0))))
    chosen = copies.select("mix_name", "source", "id", F.col("epoch").cast("long").alias("epoch"), "tokens", position.alias("position"))
    taken = chosen.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("id").alias("documents"), (F.max("epoch") + 1).alias("most_repeats"))
    shares = wanted.join(taken, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(mix)), F.lit(0.0)))
    return chosen.orderBy("mix_name", "position", "id", "epoch"), shares
