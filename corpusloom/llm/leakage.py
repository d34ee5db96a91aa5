"""Problem 6: evaluation passages inside training documents.

Latent semantic retrieval: the TF-IDF vectors of corpus passages are factored by a
distributed randomised SVD. Segments of every evaluation passage and windows of every
document are projected into its leading directions, and the cosine there chooses the
candidate passages of a document. Each candidate is verified by the longest common run
in original order; a candidate without such a run is a paraphrase if most of the passage
follows in order (longest common subsequence) and the terms that answer its question occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import fold_lookalikes
from corpusloom.session import materialize

MAX_ITEMS = 5_000  # evaluation items searched for in one pass; more take further passes
COVER = 0.5  # share of the passage a leak holds
ANSWERED = 0.8  # share of an item's answer that a paraphrase holds
RANK = 32  # directions of the latent space
SAMPLE = 5_000  # about so many distinct texts fit the directions; all texts are searched
NEAR = 0.8  # latent cosine of a window and a segment that makes a candidate
BLOCK = 32  # terms of a corpus passage
PARTS = 16  # tasks that share the factoring of the sample
AT_ONCE = 4_096  # terms projected in one step: bounds the memory of a task
DOCS, TERMS = 64, 65_536  # documents searched in one step, and their terms: a longer text is a step of its own
PLACES = 1 << 20  # places in passages that are looked at in one step, unless one document has more
# Only letters and digits become terms: these are the characters the fold changes among them.
# (Java asks for the outer range first, so that most characters are tested once.)
_FOLDED = r"[\u00ad\u0370-\uffef&&[­Ͱ-ԯᅟ-ᅠ឴-឵​-‏⁠-⁯⺀-⿟豈-﫿︀-️﻿０-９Ａ-Ｚａ-ｚｦ-ﾟ]]"
_TERM = re.compile(r"[A-Za-z0-9À-ɏͰ-ӿऀ-ॿ]+|[⺀-鿿ぁ-ヿ฀-๿豈-﫿]")


def _terms(text: str) -> list[str]:
    """Words; for scripts without spaces, single characters."""
    return _TERM.findall(text)


def _normal(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, text) lower-cased with look-alike characters folded."""
    text = F.col(text_col)
    plain = F.when(text.rlike(_FOLDED), fold_lookalikes(text)).otherwise(text)
    return df.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias(name), F.lower(plain).alias("text"))


def _longest_run(passage: list[int], window: list[int]) -> tuple[int, int]:
    """Start and size in the passage of the longest run that the window repeats in order,
    where a changed term may stand between two equal stretches of two or more terms."""
    place: dict[int, list[int]] = {}
    for j, term in enumerate(window):
        place.setdefault(term, []).append(j)
    best, ends = (0, 0), {}
    for i, term in enumerate(passage):
        now = {}
        for j in place.get(term, ()):
            # (start in the passage, equal terms, equal terms since the last change)
            start, same, fresh = ends.get((i - 1, j - 1), (i, 0, 0))
            if not same:
                for di, dj in ((2, 2), (2, 1), (1, 2), (3, 3), (3, 2), (2, 3), (3, 1), (1, 3)):
                    s, n, f = ends.get((i - di, j - dj), (i, 0, 0))
                    if f >= 2 and n > same:
                        start, same, fresh = s, n, 0
            now[(i, j)] = (start, same + 1, fresh + 1)
            if i + 1 - start > best[1]:
                best = (start, i + 1 - start)
        ends = {k: v for k, v in ends.items() if k[0] >= i - 2} | now
    return best


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _groups(sizes: list[int], rows: int, total: int) -> Iterator[slice]:
    """Neighbours by so many at most and, but for a single one, of so much in total."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin == rows or held + n > total):
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if len(sizes):
        yield slice(begin, len(sizes))


def _spread(first: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of all keys, one key after the other: those of k are values[first[k] : first[k + 1]]."""
    count = first[keys + 1] - first[keys]
    return values[np.repeat(first[keys] - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _once(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, term): every term of a document, by numbers below width, once."""
    key = np.repeat(np.arange(len(docs)), [len(t) for t in docs]) * width + np.concatenate(docs)
    return np.divmod(_distinct(key), width)


class _Runs:
    """Where a document may hold the share cover of a passage: a test that loses no run of _longest_run.

    Every stretch of a run but the last has two equal terms or more, and at most two terms
    of the passage and of the document lie between stretches. So the neighbouring pairs that
    both share start at most four terms apart in either, from the run's first term to at most
    five terms before its end. Terms are numbers; those of no passage are all the number beyond.
    """

    def __init__(self, passages: list[np.ndarray], beyond: int, cover: float):
        self.beyond = beyond
        self.step = max(map(len, passages), default=0) + 8
        least = [next((s for s in range(1, len(p) + 1) if s / len(p) >= cover), len(p) + 1) for p in passages]
        self.reach = np.array([max(0, s - 5) for s in least], np.int64)
        self.pairs = [-(-(s - 1) // 4) for s in least]
        # One term alone is a run of passages this short.
        self.tiny = {p: passages[p] for p, s in enumerate(least) if s < 2}
        self.own = [self._pairs(p) for p in passages]
        pair = np.concatenate([*self.own, np.zeros(0, np.int64)])
        at = np.concatenate([*(p * self.step + np.arange(len(x)) for p, x in enumerate(self.own)), np.zeros(0, np.int64)])
        order = np.argsort(pair, kind="stable")
        self.count = max(1, len(passages))
        self.codes, self.first = np.unique(pair[order], return_index=True)
        self.first = np.append(self.first, len(pair))
        self.at = at[order]
        self.own = [np.unique(np.searchsorted(self.codes, x)) for x in self.own]

    def _pairs(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:-1].astype(np.int64) * (self.beyond + 1) + numbers[1:]

    def _reached(self, group: np.ndarray, known: np.ndarray) -> np.ndarray:
        """group * count + passage, in order, wherever the pairs of a group (by their place)
        follow each other in the passage over a long enough stretch."""
        group, known = np.divmod(_distinct(group * len(self.codes) + known), len(self.codes))
        own, at = np.unique(group, return_index=True)
        places = np.add.reduceat(self.first[known + 1] - self.first[known], at)
        ends = np.append(at, len(group))
        found = [self._reach(group[ends[x.start] : ends[x.stop]], known[ends[x.start] : ends[x.stop]]) for x in _groups(places.tolist(), len(own), PLACES)]
        return np.concatenate(found)

    def _reach(self, group: np.ndarray, known: np.ndarray) -> np.ndarray:
        whole = self.count * self.step
        base = np.repeat(group * whole, self.first[known + 1] - self.first[known])
        at = np.sort((_spread(self.first, self.at, known) + base).astype(np.int32 if (group[-1] + 1) * whole < 2**31 else np.int64))
        cut = np.flatnonzero(np.diff(at) > 4)
        lo, hi = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
        owner = (lo // self.step).astype(np.int64)
        return _distinct(owner[hi - lo >= self.reach[owner % self.count]])

    def __call__(self, numbers: np.ndarray, among: set[int]) -> dict[int, list[tuple[int, int]]]:
        """For each of the passages among the stretches of the document that may hold enough of it."""
        wanted = np.zeros((1, self.count), bool)
        wanted[0, list(among)] = True
        return {p: spans for (_, p), spans in self.spans([numbers], wanted).items()}

    def spans(self, docs: list[np.ndarray], wanted: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For each wanted (document, passage) the stretches of the document that may hold enough of the passage."""
        found = {(d, p): [(0, len(docs[d]))] for p in self.tiny for d in np.flatnonzero(wanted[:, p]).tolist() if np.isin(self.tiny[p], docs[d]).any()}
        sizes = np.array([len(t) for t in docs])
        ends = np.cumsum(sizes)
        code = self._pairs(np.concatenate(docs))
        if not len(code) or not len(self.codes):
            return found
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[place] == code
        last = ends[:-1] - 1  # the last term of a document and the first of the next are no pair
        same[last[(last >= 0) & (last < len(same))]] = False
        shared = np.flatnonzero(same)
        if not len(shared):
            return found
        place, doc = place[shared], np.repeat(np.arange(len(docs)), sizes)[shared]
        first = np.searchsorted(doc, np.arange(len(docs) + 1))
        stretches: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        reached = self._reached(doc, place)
        for d, p in zip(*(x.tolist() for x in np.divmod(reached[wanted.ravel()[reached]], self.count)), strict=True):
            if (d, p) in found:
                continue
            here, own = place[first[d] : first[d + 1]], self.own[p]
            mine = np.flatnonzero(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here)
            at = shared[first[d] : first[d + 1]][mine] - (ends[d] - sizes[d])
            cut = np.flatnonzero(np.diff(at) > 4) + 1
            stretches += [(d, p, at[lo:hi], here[mine[lo:hi]]) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(mine)], strict=True) if hi - lo >= max(1, self.pairs[p])]
        if stretches:
            group = np.repeat(np.arange(len(stretches)), [len(x) for *_, x in stretches])
            held = set(self._reached(group, np.concatenate([x for *_, x in stretches])).tolist())
            for i, (d, p, at, _) in enumerate(stretches):
                if i * self.count + p in held:
                    found.setdefault((d, p), []).append((int(at[0]), int(at[-1]) + 5))
        return found


def _common_in_order(passage: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one bit a term of the passage."""
    at: dict[int, int] = {}
    for i, term in enumerate(passage):
        at[term] = at.get(term, 0) | 1 << i
    full = (1 << len(passage)) - 1
    free = full
    for term in text:
        met = free & at.get(term, 0)
        free = ((free + met) | (free - met)) & full
    return len(passage) - free.bit_count()


def _size(length: int) -> int:
    """Terms of a segment: the largest power of two within a quarter of the passage."""
    return 2 ** int(math.log2(max(1, length // 4)))


def _add_up(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that the PARTS tasks hand over as bytes; bounded by the items of a pass."""
    total = np.zeros(shape)
    for row in parts.collect():
        total += np.frombuffer(row.m, np.float32).reshape(shape)
    return total


def _gram(blocks: DataFrame, basis: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A'A basis for the unit TF-IDF rows A of the corpus passages: one pass over the blocks."""
    width = basis.shape[1]
    held = blocks.sparkSession.sparkContext.broadcast((basis.astype(np.float32), scale.astype(np.float32)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, idf = held.value
        out = np.zeros(q.shape, np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy()
            term = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            first, row = offsets[:-1] - offsets[0], np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            value = idf[term] / np.sqrt(np.add.reduceat(idf[term] ** 2, first))[row]
            order = np.argsort(term, kind="stable")
            own, at = np.unique(term[order], return_index=True)
            for lo in range(0, width, 16):
                y = np.add.reduceat(q[term, lo : lo + 16] * value[:, None], first)
                out[own, lo : lo + 16] += np.add.reduceat(y[row[order]] * value[order][:, None], at)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])

    return _add_up(blocks.mapInArrow(multiply, "m binary"), basis.shape)


def _numbered(texts: DataFrame, number: dict[str, int]) -> DataFrame:
    """(id, terms): every text as the numbers of its terms (32-bit, as bytes), written once;
    terms of no passage are all the number beyond."""
    numbers, beyond = texts.sparkSession.sparkContext.broadcast(number), len(number)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                terms = _terms(text)
                out.append(np.fromiter(map(numbers.value.get, terms, repeat(beyond)), np.int32, len(terms)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "terms"])

    return materialize(texts.mapInArrow(convert, "id long, terms binary"), "leak-terms")


def latent_space(texts: DataFrame, passages: list[np.ndarray], count: int, *, rank: int = RANK, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(projection, idf, kept): for each of the count passage terms its weighted row in the latent
    space and its inverse document frequency, and the share of the sampled passages' energy that the space keeps.

    Document frequencies are counted over all texts (id, terms). The directions are those of a
    randomised SVD of the TF-IDF corpus passages, in the terms that occur in evaluation passages
    (no other takes part in a cosine), fitted on about so many distinct texts and on the evaluation passages.
    """
    spark = texts.sparkSession

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(count + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            docs = [np.frombuffer(t, np.int32) for t in batch.column("terms").to_pylist()]
            for part in _groups([len(t) for t in docs], DOCS, TERMS):
                held += np.bincount(_once(docs[part], count + 1)[1], minlength=count + 1)
        held[count] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count + 1)), pa.array(held)], ["term", "n"])

    found = texts.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(count + 1)
    for r in found:  # one row a passage term: bounded by the evaluation set
        df[r.term] = r.n
    idf = np.log((df[count] + 1) / (df[:count] + 1)) + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for terms in batch.column("terms").to_pylist():
                held = np.frombuffer(terms, np.int32)
                held = held[held < count]
                out += [held[i : i + BLOCK] for i in range(0, len(held), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["terms"])

    share = max(1, round(df[count] / sample))
    drawn = texts.select("terms", F.xxhash64("terms").alias("h")).where(F.pmod("h", F.lit(share)) == 0).groupBy("h").agg(F.first("terms").alias("terms"))
    own = spark.createDataFrame([(p.astype(np.int32).tobytes(),) for p in passages], "terms binary")
    rows = materialize(drawn.select("terms").unionByName(own).repartition(PARTS).mapInArrow(blocks, "terms array<int>"), "leak-passages")
    # Subspace iteration: each pass multiplies by A'A, the last one gives the Ritz values.
    basis = np.random.default_rng(11).normal(size=(count, min(count, rank + 16)))
    for _ in range(2):
        basis = np.linalg.qr(_gram(rows, basis, idf))[0]
    image = _gram(rows, basis, idf)
    energy, turn = np.linalg.eigh(basis.T @ image)
    order = np.argsort(energy)[::-1][:rank]
    kept = float(energy[order].sum() / max(1, rows.where("size(terms) > 0").count()))
    return (basis @ turn[:, order] * idf[:, None]).astype(np.float32), idf, kept


class _Search:
    """Latent cosines of a few documents' windows with the segments of all passages."""

    def __init__(self, projection: np.ndarray, passages: list[np.ndarray], near: float):
        self.rows = np.vstack([projection, np.zeros((1, projection.shape[1]), np.float32)])
        self.near = near
        sizes = np.array([_size(len(p)) for p in passages])
        self.segments = {}
        for size in np.unique(sizes).tolist():
            # As far apart as a half of the passage allows that is to hold a whole segment.
            owner = [(p, at) for p in np.flatnonzero(sizes == size).tolist() for at in range(0, len(passages[p]) - size + 1, max(1, len(passages[p]) // 2 - size))]
            vectors = np.stack([self.rows[passages[p][at : at + size]].sum(axis=0) for p, at in owner])
            own, first = np.unique([p for p, _ in owner], return_index=True)
            self.segments[size] = own, first, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).T
        self.longest = max(self.segments, default=1)
        self.count = len(passages)

    def __call__(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, cosine, share) of all candidates: the best cosine of a passage's segments and
        the share of them that are near, documents by term numbers."""
        # Long documents are taken in overlapping slices: memory is bounded, no window is lost.
        slices = [(d, terms[lo : lo + AT_ONCE + self.longest]) for d, terms in enumerate(docs) for lo in range(0, max(1, len(terms)), AT_ONCE)]
        best = {size: np.empty((len(slices), vectors.shape[1]), np.float32) for size, (_, _, vectors) in self.segments.items()}
        for part in _groups([len(t) for _, t in slices], len(slices), AT_ONCE):
            self._compare([t for _, t in slices[part]], {size: x[part] for size, x in best.items()})
        owner, parts = np.array([d for d, _ in slices]), []
        for size, (own, first_of, _) in self.segments.items():
            cosine = best[size].T.copy()
            share = np.add.reduceat((cosine >= self.near).astype(np.float32), first_of, axis=0) / np.diff([*first_of, len(cosine)])[:, None]
            cosine = np.maximum.reduceat(cosine, first_of, axis=0)
            column, at = np.nonzero(share)
            parts.append((owner[at] * self.count + own[column], cosine[column, at], share[column, at]))
        key, cosine, share = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, cosine, share = key[order], cosine[order], share[order]
        if len(slices) > len(docs):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            key, cosine, share = key[first], *(np.maximum.reduceat(x, first) if len(first) else x for x in (cosine, share))
        return *np.divmod(key, self.count), cosine, share

    def _compare(self, group: list[np.ndarray], best: dict[int, np.ndarray]) -> None:
        """Fills for each size of segments the best cosine of any window (by slice, by segment)."""
        sizes = np.array([len(t) for t in group])
        ends = np.cumsum(sizes)
        sums = np.zeros((self.rows.shape[1], ends[-1] + 1), np.float32)
        np.cumsum(self.rows[np.concatenate(group)].T.copy(), axis=1, out=sums[:, 1:])
        sums = sums.T.copy()
        for size, (_, _, vectors) in self.segments.items():
            step = max(1, size // 2)
            count = np.maximum(1, -(-(sizes - size) // step) + 1)
            first = np.cumsum(count) - count
            place = np.arange(count.sum()) - np.repeat(first, count)
            stop = np.repeat(ends, count)
            start = np.minimum(np.repeat(ends - sizes, count) + place * step, np.maximum(stop - size, np.repeat(ends - sizes, count)))
            windows = sums[np.minimum(start + size, stop)] - sums[start]
            windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-6)
            cosines = windows @ vectors
            # By slice: over neighbouring columns this takes half the time of reduceat.
            for row, lo, hi in zip(best[size], first.tolist(), (first + count).tolist(), strict=True):
                np.max(cosines[lo:hi], axis=0, out=row)


def leaks(
    documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, question_col: str | None = None, *, cover: float = COVER, rank: int = RANK, near: float = NEAR
) -> DataFrame:
    """(id, item_id, kind, covered, in_order, answered, cosine): the documents that hold an item's passage.

    kind is 'run' where the document repeats at least the share cover of the passage as one run;
    else 'paraphrase' where that share of the passage's segments is near, at least that share follows
    in order and ANSWERED of the answer (terms of the passage that its question lacks, the rarer half)
    occurs in one stretch of twice the passage's length. Candidates are all
    passages of which a segment has a latent cosine of at least near with a window of the document.
    All documents and whole texts are searched, MAX_ITEMS items in a pass. Null ids, texts and
    passages, and passages without a term, give no row; a repeated id counts once for an item,
    with its best cover. Extra columns are ignored.
    """
    asked = F.col(question_col) if question_col else F.lit(None).cast("string")
    tests = _normal(items, item_col, passage_col, "item_id")
    questions = _normal(items.withColumn("_question", F.coalesce(asked, F.lit(""))), item_col, "_question", "item_id").groupBy("item_id").agg(F.min("text").alias("question"))
    tests = tests.dropDuplicates(["item_id", "text"]).join(questions, "item_id", "left")
    passes = max(1, math.ceil(tests.count() / MAX_ITEMS))
    texts = _normal(documents, id_col, text_col, "id")
    found = None
    for i in range(passes):
        held = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        part = _leaks_of(texts, [(r.item_id, terms, set(_terms(r.question or ""))) for r in held if (terms := _terms(r.text))], cover, rank, near)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("covered", "in_order", "answered", "cosine")).alias("b")).select("id", "item_id", "b.*")
    return best.select("id", "item_id", F.when(F.col("covered") >= cover, "run").otherwise("paraphrase").alias("kind"), "covered", "in_order", "answered", "cosine")


def _leaks_of(texts: DataFrame, passages: list[tuple[int, list[str], set[str]]], cover: float, rank: int, near: float) -> DataFrame:
    schema = "id long, item_id long, covered double, in_order double, answered double, cosine double"
    if not passages:
        return texts.sparkSession.createDataFrame([], schema)
    number: dict[str, int] = {}
    for _, terms, _ in passages:
        for t in terms:
            number.setdefault(t, len(number))
    beyond = len(number)
    tests = [np.array([number[t] for t in terms]) for _, terms, _ in passages]
    texts = _numbered(texts, number)
    projection, weight, _ = latent_space(texts, tests, beyond, rank=rank)
    # The answer: what the question does not say, the rarer half.
    answers = []
    for (_, _, question), test in zip(passages, tests, strict=True):
        rest = sorted(set(test.tolist()) - {number.get(t) for t in question}, key=lambda t: (-weight[t], t))
        answers.append(frozenset(rest[: -(-len(rest) // 2)]))
    held = texts.sparkSession.sparkContext.broadcast(([item for item, _, _ in passages], tests, projection, answers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tests, projection, answers = held.value
        runs, latent = _Runs(tests, beyond, cover), _Search(projection, tests, near)
        lists = [t.tolist() for t in tests]
        sizes = np.array([len(a) for a in answers])
        # The passages whose answers hold a term.
        term, owner = np.array([t for a in answers for t in a], np.int64), np.repeat(np.arange(len(answers)), sizes)
        order = np.argsort(term, kind="stable")
        owner, first = owner[order], np.searchsorted(term[order], np.arange(beyond + 2))

        def answered(docs: list[np.ndarray]) -> np.ndarray:
            """How many terms of each passage's answer each document has."""
            doc, term = _once(docs, beyond + 1)
            hits = np.repeat(doc, first[term + 1] - first[term]) * len(answers) + _spread(first, owner, term)
            return np.bincount(hits, minlength=len(docs) * len(answers)).reshape(len(docs), len(answers))

        for batch in batches:
            found: list[tuple] = []
            texts = [(key, np.frombuffer(t, np.int32)) for key, t in zip(batch.column("id").to_pylist(), batch.column("terms").to_pylist(), strict=True) if t]
            for part in _groups([len(t) for _, t in texts], DOCS, TERMS):
                keys, docs = zip(*texts[part], strict=True)
                doc, passage, cosine, share = latent(docs)
                wanted = np.zeros((len(docs), len(tests)), bool)
                wanted[doc, passage] = True
                spans, told = runs.spans(docs, wanted), answered(docs)
                may = np.zeros(wanted.shape, bool)
                for at in spans:
                    may[at] = True
                # A paraphrase is near in most of the passage, not in one segment.
                checked = may[doc, passage] | (share.astype(float) >= cover) & (told[doc, passage] >= ANSWERED * sizes[passage])
                for d, p, cosine_of, near_of in zip(*(x[checked].tolist() for x in (doc, passage, cosine, share)), strict=True):
                    terms, answer, size, has = docs[d], answers[p], len(lists[p]), int(told[d, p])
                    covered = max((_longest_run(lists[p], terms[lo:hi].tolist())[1] for lo, hi in spans.get((d, p), ())), default=0) / size
                    if covered < cover and (near_of < cover or has < ANSWERED * len(answer)):
                        continue
                    least = 0 if covered >= cover else ANSWERED * len(answer)
                    stretches = (terms[at : at + 2 * size].tolist() for at in range(0, max(1, len(terms) - size), size))
                    in_order = max((_common_in_order(lists[p], x) for x in stretches if len(answer.intersection(x)) >= least), default=0) / size
                    if covered >= cover or in_order >= cover:
                        found.append((keys[d], names[p], covered, in_order, has / max(1, len(answer)), cosine_of))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return texts.mapInArrow(search, schema)
