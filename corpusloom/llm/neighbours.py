"""Problem 1: the most similar vectors for every vector.

Each vector is projected several times onto a few principal directions, every
projection is shifted and quantised, and its Hilbert key orders the collection.
Equal vectors stand in the orderings once, by their least id, and are ranked as members
of their class at the end.
Each ordering is cut into ranges; every range takes along the ends of the ranges beside
it, so that no window stops at an edge. A window sliding over each sorted range compares
the vectors that ask with their neighbours on the curve: the cost of a vector is bounded by
curves x 2 x window comparisons. The windows of all curves are merged and reranked on exact cosines.

Between the two steps vectors travel as one byte a dimension; the rounding error
of each is kept beside it, so the similarity bound before the rerank never drops
a pair that the exact cosine would keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

DIMS, BITS = 12, 5  # 60-bit keys
MOMENT_PARTS = 8
ASK_AT_ONCE = 256  # asking rows compared in one step: bounds the block of similarities
CUT_SAMPLE = 50_000  # about so many vectors place the cuts between ranges; they decide balance, not results


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows (given length, finite, not all zero) as unit vectors, and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    fit = np.flatnonzero((lengths == dim) & ~np.asarray(column.is_null()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = values[offsets[fit][:, None] + np.arange(dim)].astype(np.float64) if len(fit) else np.zeros((0, dim))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x, fit = x[good], fit[good]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True), fit


def _principal(vectors: DataFrame, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions of all unit vectors; only dim x dim sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x, _ = _matrix(batch.column("vec"), dim)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for m in batch.column("m").to_pylist():
                total += np.frombuffer(m).reshape(dim + 1, dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = vectors.select("vec").mapInArrow(moments, "m binary").repartition(MOMENT_PARTS).mapInArrow(add, "m binary").collect()
    total = sum((np.frombuffer(r.m).reshape(dim + 1, dim + 1) for r in parts), np.zeros((dim + 1, dim + 1)))
    n = max(total[dim, dim], 1.0)
    mean = total[dim, :dim] / n
    spread, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    order = np.argsort(spread)[::-1][:count]
    return mean, axes[:, order] * 1.0, int(total[dim, dim])


def hilbert_key(q: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of q (n x m, integers of so many bits) on the m-dimensional
    Hilbert curve: Skilling's transform, then the bits of all axes interleaved."""
    axes = [q[:, i].astype(np.int64) for i in range(q.shape[1])]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(len(axes)):
            on = (axes[i] & level) != 0
            swap = (axes[0] ^ axes[i]) & low
            first = np.where(on, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = np.where(on, axes[i], axes[i] ^ swap)
            axes[0] = first
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    level = top
    while level > 1:
        flip = np.where(axes[-1] & level, flip ^ (level - 1), flip)
        level >>= 1
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ flip) >> bit) & 1)
    return key


def _leaders(s: np.ndarray, count: int) -> np.ndarray:
    """Which entries are among the largest so many of their row."""
    if s.shape[1] <= count:
        return np.ones(s.shape, bool)
    return s >= -np.partition(-s, count - 1, axis=1)[:, count - 1 : count]


def _orderings(mean: np.ndarray, axes: np.ndarray, curves: int, seed: int):
    """Per curve a rotation of the leading directions, its axis order and its shift."""
    rng = np.random.default_rng(seed)
    wide, dims = axes.shape[1], min(DIMS, axes.shape[1])
    for c in range(curves):
        if c % 2:
            turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, :dims]
            way = axes @ turn
        else:
            way = axes[:, :dims][:, rng.permutation(dims)]
        yield way, rng.uniform(0, 0.5, way.shape[1])


def most_similar(
    df: DataFrame, id_col: str, vec_col: str, k: int = 10, *, dim: int = 64, min_similarity: float | None = None, curves: int = 8, window: int = 4096, query: str | None = None, seed: int = 7
) -> DataFrame:
    """(id, neighbour, similarity, rank): up to k most similar other vectors for each vector.

    Vectors that are null, of another length than dim, all zero or not finite and
    rows with a null id are not usable: they neither ask nor answer. Equal
    similarities rank by neighbour id, so repeated vectors give a fixed result; a
    repeated id counts once. With min_similarity only pairs at or above it are kept. query
    is a SQL condition on id for the rows that ask; all rows answer, and the same windows
    on the same curves are compared whether few rows ask or all. Each window passes on the 2k
    best of a vector by the rounded values, the 3k best over all curves are reranked. An
    empty table gives no rows. Extra columns are ignored.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    asks = F.expr(query) if query else F.lit(True)
    members = _classes(vectors, asks)
    single = vectors.join(members, "id", "left").where("first is null or first = id").select("id", "vec", (F.coalesce("asked", F.lit(False)) | asks).alias("asks"))
    mean, axes, count = _principal(vectors, dim, min(2 * DIMS, dim))
    orders = list(_orderings(mean, axes, curves, seed))
    half = 4.0 / np.sqrt(dim)  # of the quantised range: unit vectors spread by about 1/sqrt(dim) an axis

    def places(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """On each curve the keys of the vectors; within a cell a projection of the curve's own decides."""
        for way, shift in orders:
            y = (x - mean) @ way
            cells = np.clip((y / (2 * half) + 0.5 + shift) / 1.5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield hilbert_key(cells, BITS), y[:, 0].astype(np.float32)

    cuts = _cuts(single, places, dim, curves, count, window)
    ranges = max((len(c[0]) for c in cuts), default=0) + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column("vec"), dim)
            if not len(x):
                continue
            ids = batch.column("id").to_numpy()[rows]
            asking = batch.column("asks").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(bool)
            scale = np.abs(x).max(axis=1, keepdims=True) / 127
            small = np.rint(x / scale).astype(np.int8)
            error = (np.linalg.norm(x - small * scale, axis=1) * 1.001 + 1e-6).astype(np.float32)
            for c, (key, tie) in enumerate(places(x)):
                # The range of each row, and the ranges beside it that need the row for their windows.
                after = [_behind(key, tie, *cut) for cut in cuts[c]]
                own = after[1]
                copies = [(np.arange(len(x)), own, asking)]
                for moved in (after[0], after[2]):
                    extra = np.flatnonzero(moved != own)
                    copies.append((extra, moved[extra], np.zeros(len(extra), bool)))
                at, slot, asked = (np.concatenate(z) for z in zip(*copies, strict=True))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(at), [None, pa.py_buffer(np.ascontiguousarray(small[at]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((c * ranges + slot).astype(np.int64)), pa.array(key[at]), pa.array(tie[at]), pa.array(ids[at]), pa.array(asked), packed, pa.array(scale[at, 0].astype(np.float32)), pa.array(error[at])],
                    ["slot", "key", "tie", "id", "asks", "small", "scale", "err"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of both sides for the rows that ask, each once a full window follows it."""
        held: tuple[np.ndarray, ...] | None = None
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("small")
            x = np.frombuffer(raw.buffers()[2], np.int8)[raw.offset * dim : (raw.offset + len(raw)) * dim].reshape(-1, dim).astype(np.float32)
            x *= batch.column("scale").to_numpy()[:, None]
            now = (batch.column("slot").to_numpy(), batch.column("id").to_numpy(), batch.column("err").to_numpy(), x, batch.column("asks").to_numpy(zero_copy_only=False))
            held = now if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
            ready = len(held[0]) - window
            if ready - done >= window:
                yield from answer(held, done, ready)
                start = max(0, ready - window)
                held, done = tuple(a[start:] for a in held), ready - start
        if held is not None:
            yield from answer(held, done, len(held[0]))

    def answer(held: tuple[np.ndarray, ...], first: int, last: int) -> Iterator[pa.RecordBatch]:
        slot, ids, err, x, asks = held
        rows = first + np.flatnonzero(asks[first:last])
        while len(rows):
            own = rows[: min(ASK_AT_ONCE, int(np.searchsorted(rows, rows[0] + window)))]
            rows = rows[len(own) :]
            lo, hi = max(0, own[0] - window), min(len(ids), own[-1] + window + 1)
            other = np.arange(lo, hi)[None, :]
            ok = (np.abs(other - own[:, None]) <= window) & (slot[lo:hi][None, :] == slot[own][:, None]) & (ids[lo:hi][None, :] != ids[own][:, None])
            s = x[own] @ x[lo:hi].T
            if min_similarity is not None:
                e, f = err[own][:, None], err[lo:hi][None, :]
                ok &= s + e + f + e * f >= min_similarity
                full = np.flatnonzero(ok.sum(axis=1) > 2 * k)
                ok[full] &= _leaders(np.where(ok[full], s[full], -2), 2 * k)
            else:
                s = np.where(ok, s, -2)
                ok &= _leaders(s, 2 * k)
            a, b = np.nonzero(ok)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[a]]), pa.array(ids[lo + b]), pa.array(s[a, b].astype(np.float32))], ["a", "b", "s"])

    lines = single.mapInArrow(keyed, "slot long, key long, tie float, id long, asks boolean, small binary, scale float, err float")
    # A partition for each range: what a task reads does not grow with the table.
    lines = lines.repartition(curves * ranges, "slot").sortWithinPartitions("slot", "key", "tie", "id")
    near = lines.mapInArrow(windows, "a long, b long, s float").groupBy("a", "b").agg(F.max("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    near = near.withColumn("place", place).where(F.col("place") <= 3 * k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(near.distinct(), "neighbours")
    return _rerank(pairs, vectors, members, dim, k, min_similarity, query)


def _behind(key: np.ndarray, tie: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """How many of the cuts (sorted by key, tie) lie at or before each place."""
    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    for i in np.flatnonzero(hi > lo):
        lo[i] += np.searchsorted(ties[lo[i] : hi[i]], tie[i], "right")
    return lo


def _cuts(single: DataFrame, places, dim: int, curves: int, count: int, window: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per curve the cuts between its ranges, as (key, tie), and beside them the cuts moved
    forward and back by more than a window: what lies between belongs to two ranges.

    The cuts come from a bounded sample; ranges hold many windows, so the copies are few.
    """
    share = max(1, round(count / CUT_SAMPLE))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column("vec"), dim)
            for c, (key, tie) in enumerate(places(x)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), pa.array(tie)], ["curve", "key", "tie"])

    rows = max(16 * window, 65_536)
    ranges = max(1, -(-count // rows))
    # So many sampled places span a window for all but a vanishing share of the cuts.
    span = int(window / share + 5 * np.sqrt(window / share) + 5)

    def placed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["key", "tie"])
        at = np.arange(1, ranges) * len(own) // ranges
        moved = [own.iloc[np.clip(at + d, 0, len(own) - 1)].assign(side=side) for side, d in enumerate((span, 0, -span))]
        return pd.concat(moved)[["curve", "side", "key", "tie"]]

    drawn = single.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(sampled, "curve int, key long, tie float")
    found = drawn.groupBy("curve").applyInPandas(placed, "curve int, side int, key long, tie float").collect()
    out = []
    for c in range(curves):
        sides = [sorted((r.key, r.tie) for r in found if r.curve == c and r.side == side) for side in range(3)]
        out.append([(np.array([k for k, _ in side], np.int64), np.array([t for _, t in side], np.float32)) for side in sides])
    return out


def _classes(vectors: DataFrame, asks: Column) -> DataFrame:
    """(id, first, asked): the ids of vectors that occur more than once, the least id of the
    same vector and whether any of them asks."""
    ids = vectors.select("id", F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    found = ids.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(asks).alias("asked")).where("first < last")
    return materialize(ids.join(found, ["h", "g"]).select("id", "first", "asked").distinct(), "neighbours-classes")


def _rerank(pairs: DataFrame, vectors: DataFrame, members: DataFrame, dim: int, k: int, min_similarity: float | None, query: str | None) -> DataFrame:
    """Exact cosines of the pairs of first ids, and the k best of each id."""
    # Members of a class are neighbours of each other; of no class are more than its k + 1 least ids needed.
    pairs = pairs.unionByName(members.where("id = first and asked").select(F.col("id").alias("a"), F.col("id").alias("b")))
    least = Window.partitionBy("first").orderBy("id")
    few = members.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).select(F.col("first").alias("neighbour"), F.col("id").alias("member"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    double = F.transform("vec", lambda v: v.cast("double"))
    unit = vectors.join(needed, "id", "left_semi").select("id", double.alias("vec"))
    unit = unit.where(F.size("vec") == dim).dropDuplicates(["id"]).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)))
    # Classes of vectors that are not usable have no pairs: their norms are zero, infinite or NaN.
    unit = materialize(unit.where((F.col("norm") > 0) & (F.col("norm") < float("inf"))), "neighbours-vectors")
    a = unit.select(F.col("id").alias("a"), F.col("vec").alias("u"), F.col("norm").alias("p"))
    b = unit.select(F.col("id").alias("b"), F.col("vec").alias("v"), F.col("norm").alias("q"))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", (dot / (F.col("p") * F.col("q"))).alias("similarity"))
    if min_similarity is not None:
        scored = scored.where(F.col("similarity") >= min_similarity)
    one, two = (F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour")) for x, y in ("ab", "ba"))
    way = F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two)))
    both = scored.select(way.alias("w"), "similarity").select("w.*", "similarity")
    if query:
        asking = members.where("id = first and asked").select("id")
        both = both.where(query).unionByName(both.where(f"not coalesce({query}, false)").join(asking, "id", "left_semi"))
    both = both.join(few, "neighbour", "left").select("id", F.coalesce("member", "neighbour").alias("neighbour"), "similarity")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    # One more than asked for: each member leaves itself out.
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("near"))
    rest = lists.withColumnRenamed("id", "first").join(members.where("id <> first").select("id", "first"), "first").select("id", "near")
    lists = lists.unionByName(rest)
    if query:
        lists = lists.where(query)
    near = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    rows = lists.select("id", F.posexplode(near).alias("place", "x"))
    return rows.select("id", "x.neighbour", "x.similarity", (F.col("place") + 1).alias("rank"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, *, k: int = 10, min_similarity: float = 0.94, **options) -> DataFrame:
    """Distinct pairs (id_a < id_b) where one is among the k most similar of the other."""
    near = most_similar(df, id_col, vec_col, k, min_similarity=min_similarity, **options)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
