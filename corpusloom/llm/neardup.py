"""Problem 5: near-duplicate records with small edits.

Every record is a weighted set of character shingles. ProbMinHash gives each set
a signature whose registers agree with the probability Jaccard similarity (equal
to plain Jaccard for sets). Bands of registers are joined to find candidates and
every candidate is verified on the exact shingle sets. Exact copies are collapsed
to a class before banding, so a group of copies costs one signature's join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mix, plain_letters, shingle_hashes
from corpusloom.session import materialize

BANDS, ROWS = 64, 5  # a pair at 0.6 meets with probability 0.994, at 0.7 with 0.99999


def probminhash(elements: np.ndarray, owner: np.ndarray, count: int, registers: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (count x registers) of the weighted sets given as flat arrays.

    The elements' arrivals form Poisson processes of rate weight: each round adds an
    exponential waiting time to every living element and offers it to a random
    register. An element dies once its time lies beyond the largest register of its
    set, as no later arrival can win. A repeated element changes nothing when
    weights are absent; a set without elements keeps a signature of zeros.
    """
    best = np.full(count * registers, np.inf)
    winner = np.zeros(count * registers, np.uint64)
    time = np.zeros(len(elements))
    turn = 0
    base = owner * registers
    while len(elements):
        turn += 1
        draw = mix(elements + np.uint64(turn * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        wait = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40)
        time = time + (wait if weights is None else wait / weights)
        slot = base + (((draw & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        winner[slot[won]] = elements[won]
        alive = time < best.reshape(count, registers).max(axis=1)[owner]
        elements, owner, base, time = elements[alive], owner[alive], base[alive], time[alive]
        weights = None if weights is None else weights[alive]
    return winner.reshape(count, registers)


def _signed(rows: DataFrame, k: int, weighted: bool, bands: int, width: int) -> DataFrame:
    """(key, cls, check, bands): 64-bit band hashes of each record with at least one shingle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                hashes, owner = shingle_hashes(part.column("norm").to_pylist(), k)
                weights = None
                if weighted and len(hashes):
                    pairs, counts = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1, return_counts=True)
                    owner, hashes, weights = pairs[0].astype(np.int64), pairs[1], counts.astype(np.float64)
                registers = probminhash(hashes, owner, part.num_rows, bands * width, weights).reshape(part.num_rows, bands, width)
                band = np.zeros((part.num_rows, bands), np.uint64)
                for i in range(width):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + registers[:, :, i])
                # The band's place is part of its hash: one number names a bucket.
                flat = pa.array(mix(band ^ (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32))).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * bands, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("cls"), part.column("check"), lists], ["key", "cls", "check", "bands"])

    return rows.mapInArrow(sign, "key long, cls long, check int, bands array<long>")


def probability_jaccard(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> float:
    """The similarity that ProbMinHash estimates: for each common element i of the weighted sets
    1 / sum over all j of max(x_j / x_i, y_j / y_i), added up. p and q are sorted and distinct."""
    common, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xs, ys = x[i], y[j]
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    xs, ys = xs[order], ys[order]
    # Elements of one set alone count always; of the common ones those of a greater ratio by x, the others by y.
    above = x.sum() - np.cumsum(xs)
    below = y.sum() - ys.sum() + np.cumsum(ys)
    return float((1.0 / (above / xs + below / ys)).sum())


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, weighted: bool) -> DataFrame:
    """Pairs whose exact shingle sets, or counted shingles, reach the threshold."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for at in range(0, len(a), 256):
            # Every text of the stretch is hashed once; the join has brought equal ones together.
            x, y = a[at : at + 256], b[at : at + 256]
            codes, unique = pd.factorize(pd.concat([x, y], ignore_index=True))
            hashes, owner = shingle_hashes(unique.tolist(), k)
            bounds = np.searchsorted(owner, np.arange(len(unique) + 1))
            sets = [np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(len(unique))]
            for i, (one, two) in enumerate(zip(codes[: len(x)], codes[len(x) :], strict=True)):
                (p, m), (q, n) = sets[one], sets[two]
                if weighted:
                    out[at + i] = probability_jaccard(p, m.astype(float), q, n.astype(float))
                else:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    out[at + i] = both / max(1, len(p) + len(q) - both)
        return pd.Series(out)

    a = texts.select(F.col("rep").alias("a"), F.col("norm").alias("x"))
    b = texts.select(F.col("rep").alias("b"), F.col("norm").alias("y"))
    return pairs.join(a, "a").join(b, "b").withColumn("similarity", similarity("x", "y")).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, k: int = 8, threshold: float = 0.6, weighted: bool = False, bands: int = BANDS, width: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between class representatives, and
    members (key, rep) of every record with a class.

    A class holds the records whose letters and digits are equal (by 96 bits of two
    hashes). Null ids or texts and texts shorter than one shingle belong to no class. A
    repeated key counts once for each different text. An empty table gives empty results. No
    bucket is capped; whole texts are read. With weighted=True shingles count as often as they
    occur: signatures and verification follow the probability Jaccard similarity of the counts.
    """
    rows = df.select(F.col(id_col).cast("long").alias("key"), plain_letters(F.col(text_col)).alias("norm")).where(F.col("key").isNotNull() & (F.length("norm") >= k))
    rows = rows.withColumn("cls", F.xxhash64("norm")).withColumn("check", F.hash("norm"))
    # A number for each row, fixed by the write: a class is named by its least one, as a key may hold several texts.
    signed = materialize(_signed(rows, k, weighted, bands, width).withColumn("row", F.monotonically_increasing_id()), "neardup-signed")
    reps = signed.groupBy("cls", "check").agg(F.min("row").alias("rep"), F.first("bands").alias("bands"))
    # No repartition before the join: adaptive execution may then split a hot bucket.
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    met = banded.alias("p").join(banded.alias("q"), F.expr("p.bucket = q.bucket and p.rep < q.rep")).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()
    candidates = materialize(met, "neardup-candidates")
    first = signed.groupBy("cls", "check").agg(F.min(F.struct(F.col("row").alias("rep"), "key")).alias("first")).select("cls", "check", "first.*")
    members = signed.select("key", "cls", "check").join(first.drop("key"), ["cls", "check"]).select("key", "rep").distinct()
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = first.join(wanted, "rep", "left_semi")
    texts = materialize(rows.join(own, ["key", "cls", "check"]).select("rep", "norm").distinct(), "neardup-texts")
    return _verified(candidates, texts, k, threshold, weighted), members


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """All pairs (a < b) of different keys at or above the threshold, copies included."""
    links, members = near_duplicates(df, id_col, text_col, **options)
    links, members = materialize(links, "neardup-links"), materialize(members, "neardup-members")
    left = members.select(F.col("key").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("key").alias("y"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    shared = members.groupBy("rep").count().where("count > 1").select("rep")
    again = members.join(shared, "rep", "left_semi")
    within = again.alias("p").join(again.alias("q"), F.expr("p.rep = q.rep and p.key < q.key")).select(F.col("p.key").alias("x"), F.col("q.key").alias("y"))
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(key, group_id, links): every record with a class, the least key of its connected
    group, and how many other classes its class is linked to. A key with several texts is
    one row: the least of their groups and the sum of their links."""
    links, members = near_duplicates(df, id_col, text_col, **options)
    links, members = materialize(links, "neardup-links"), materialize(members, "neardup-members")
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "neardup-label")
    while True:
        # Take the least label among the neighbours, then the label of that label: paths halve each round.
        seen = edges.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = label.join(seen, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = near.select(F.col("a").alias("label"), F.col("label").alias("further"))
        moved = materialize(near.join(jump, "label", "left").select("a", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "neardup-label")
        label = moved.select("a", "label")
        if moved.where("old <> label").isEmpty():
            break
    degree = edges.groupBy("a").count()
    own = members.select("key", F.col("rep").alias("a"))
    own = own.join(label, "a", "left").join(degree, "a", "left").select("key", F.coalesce("label", "a").alias("label"), F.coalesce("count", F.lit(0)).alias("links"))
    least = own.groupBy("label").agg(F.min("key").alias("group_id"))
    return own.join(least, "label").groupBy("key").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))
