"""Problem 2: text decoded with the wrong character encoding.

One pass counts the corpus vocabulary: words, and for scripts without spaces single
characters and neighbouring pairs. Every vocabulary word is garbled under all
encoding chains; the forms and the words are hash-joined, and a word is bad where it
is the garbled form of a more frequent word. Document tokens are hash-joined with
that table: a record with a hit is affected and its tokens are replaced by their
verified originals. The replacement character marks text that no chain can restore.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

# Fixed values: (written as, read as); two steps where a text was garbled twice.
CHAINS = tuple(
    [(("utf-8", wrong),) for wrong in ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gbk", "big5", "cp932", "cp949")]
    + [(("gbk", wrong),) for wrong in ("latin-1", "cp1252", "cp1251")]
    + [((right, wrong),) for right in ("cp1251", "koi8-r", "cp932", "big5", "tis-620") for wrong in ("latin-1", "cp1252")]
    + [(("koi8-r", "cp1251"),), (("cp1251", "koi8-r"),)]
    + [(("utf-8", one), ("utf-8", two)) for one in ("latin-1", "cp1252") for two in ("latin-1", "cp1252")]
)
_SHORT = (("gbk", "latin-1"), ("gbk", "cp1252"))  # two accented signs a character: no word looks so
VOCABULARY_AT_ONCE = 400_000  # distinct entries a task holds before it passes its counts on
SINGLE_RATIO = 5  # how much better known than its form a single character must be
_LOST = "�"
_CJK = "⺀-鿿豈-﫿＀-￯\U00020000-\U0003ffff가-힯ᄀ-ᇿ฀-๿-︰-﹏"
_WORD = re.compile(r"[A-Za-z\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
_UNSPACED = re.compile(f"[{_CJK}]+")
_THAI = re.compile("[\u0e00-\u0e7f]{4}")
_LETTERS = re.compile(r"(?:[^\W\d_]|[\xa0\xad])+")
_ASCII_LETTER = re.compile("[A-Za-z]")
_UNSEEN = re.compile("[\xa0\xad]")
_HIGH = re.compile(r"[\u0080-\U0010ffff]+")
_PLAIN = re.compile(r"[А-ЯЁ]?[а-яё]+|[ऀ-ॿ‌‍]+")
_WIDE_WRONG = ("gbk", "big5", "cp932", "cp949")
# UTF-8 lead bytes of three- and two-byte letters, and what follows them.
_SHAPE = bytes(76 if 0xE0 <= b <= 0xEF else 108 if b in (0xC3, 0xD0, 0xD1) else 99 if 0x80 <= b <= 0xBF else 120 for b in range(256))


def _page(code: str) -> dict[int, str]:
    """A one-byte code page; bytes it leaves open stay control characters, as lenient decoders do."""
    return {b: bytes([b]).decode(code, "ignore") or chr(b) for b in range(128, 256)}


_PAGES = {code: _page(code) for code in {wrong for chain in CHAINS for _, wrong in chain} - {"latin-1", *_WIDE_WRONG}}


def _read(raw: bytes, code: str) -> str:
    if code in _WIDE_WRONG:
        return raw.decode(code, "replace")
    text = raw.decode("latin-1")
    return text.translate(_PAGES[code]) if code in _PAGES else text


def garbled_forms(word: str) -> set[str]:
    """All lossless forms of the word under the chains, other than the word."""
    forms = set()
    raw: dict[str, bytes] = {}
    for chain in CHAINS:
        right, wrong = chain[0]
        if right not in raw:
            raw[right] = word.encode(right, "ignore")
            if right != "utf-8" and (raw[right].decode(right) != word or _ASCII_LETTER.search(word)):
                raw[right] = b""
        text = _read(raw[right], wrong)
        for again, last in chain[1:]:
            text = _read(text.encode(again), last)
        if not text or _LOST in text or text == word or (right != "utf-8" and len(text) < 4 and chain[0] not in _SHORT):
            continue
        if len(text) == 2 and _UNSEEN.search(text) and right != "utf-8":
            continue
        # One character's form must show a sign: two letters alone are often a word of their own.
        if len(word) > 1 or chain[0] in _SHORT or len(text) > 2 or not _LETTERS.fullmatch(text):
            forms.add(text)
    return forms


def _wide(text: str) -> bool:
    """Whether the text, written back in a wide code page, shows the shape of UTF-8 letters."""
    for code in _WIDE_WRONG:
        shape = text.encode(code, "ignore").translate(_SHAPE)
        if b"LccLcc" in shape or b"lclclc" in shape:
            return True
    return False


def _tokens(text: str) -> tuple[list[str], list[str], bool]:
    """Vocabulary entries of a text, its tokens that may be garbled, whether it holds lost characters."""
    known: list[str] = []
    asked: set[str] = set()
    wide = _wide(text)
    for word in _WORD.findall(text):
        if _UNSPACED.search(word):
            # A letter of a spaced script that became an ideograph stands among Latin letters.
            if 2 * len(_UNSPACED.sub("", word)) > len(word):
                asked.add(word)
            for run in _UNSPACED.findall(word):
                known += run
                known += map(str.__add__, run, run[1:])
                if _THAI.match(run):
                    known += [run[i : i + 4] for i in range(len(run) - 3)]
                if wide and _wide(run):
                    asked.add(run)
                    asked.update(run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1))
            word = _UNSPACED.sub(" ", word)
            rest = word.split()
        else:
            rest = (word,)
        for w in rest:
            if w.isascii():
                continue
            known.append(w)
            if _PLAIN.fullmatch(w):
                known += w
                continue
            # Every chain turns a letter, or a whole word, into signs side by side.
            for run in _HIGH.findall(w):
                known += run
                if len(run) > 1:
                    asked.update((w, run))
                if len(run) > 2:
                    asked.update(run[i : i + n] for n in (2, 3, 4, 6) for i in range(len(run) - n + 1))
    return known, list(asked), _LOST in text


def _scan(rows: DataFrame) -> DataFrame:
    """Vocabulary counts (n set) and document tokens (tab and row_key set) in one pass over
    distinct texts; extra holds what the further copies of a text add."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        copied: Counter[str] = Counter()

        def rows_of(tab, key, token, n, extra):
            return pa.RecordBatch.from_arrays([pa.array(tab, pa.string()), pa.array(key, pa.int64()), pa.array(token, pa.string()), pa.array(n, pa.int64()), pa.array(extra, pa.int64())], ["tab", "row_key", "token", "n", "extra"])

        def known_rows():
            return rows_of([None] * len(counts), [None] * len(counts), list(counts), list(counts.values()), [copied[t] for t in counts])

        for batch in batches:
            tab, key, token, extra = [], [], [], []
            for t, k, text, copies in zip(*(batch.column(c).to_pylist() for c in ("tab", "row_key", "text", "copies")), strict=True):
                if text.isascii():
                    continue
                known, asked, lost = _tokens(text)
                counts.update(known)
                for word in known if copies > 1 else ():
                    copied[word] += copies - 1
                asked += [_LOST] * lost
                tab += [t] * len(asked)
                key += [k] * len(asked)
                token += asked
                extra += [copies - 1] * len(asked)
            yield rows_of(tab, key, token, [None] * len(token), extra)
            if len(counts) > VOCABULARY_AT_ONCE:
                yield known_rows()
                counts.clear()
                copied.clear()
        yield known_rows()

    return rows.mapInArrow(scan, "tab string, row_key long, token string, n long, extra long")


def _bad_words(vocabulary: DataFrame) -> DataFrame:
    """(token, original): words that are garbled forms of a more frequent word."""

    def garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, original, n, extra = [], [], [], []
            for word, count, more in zip(*(batch.column(c).to_pylist() for c in ("token", "n", "extra")), strict=True):
                forms = garbled_forms(word)
                form += forms
                original += [word] * len(forms)
                n += [count] * len(forms)
                extra += [more] * len(forms)
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(original, pa.string()), pa.array(n, pa.int64()), pa.array(extra, pa.int64())], ["token", "original", "n", "extra"])

    return vocabulary.mapInArrow(garble, "token string, original string, n long, extra long")


def _copies(rows: DataFrame) -> DataFrame:
    """(tab, row_key, h, g, first, copies): the records whose exact text occurs again, by its
    hashes, with the first of them and how many there are."""
    keys = rows.select("tab", "row_key", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    found = keys.groupBy("h", "g").agg(F.min(F.struct("tab", "row_key")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return materialize(keys.distinct().join(found, ["h", "g"]).select("tab", "row_key", "h", "g", "first", "copies"), "garbled-copies")


def _hits(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(tab, row_key, token, original): verified garbled tokens of the first record of each
    text; original null where lost."""
    hashed = rows.select("tab", "row_key", "text", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    once = hashed.join(copies, ["tab", "row_key", "h", "g"], "left").where("first is null or (first.tab = tab and first.row_key = row_key)")
    scanned = materialize(_scan(once.select("tab", "row_key", "text", F.coalesce("copies", F.lit(1)).alias("copies"))), "garbled-scan")
    vocabulary = scanned.where("n is not null").groupBy("token").agg(F.sum("n").alias("n"), F.sum("extra").alias("extra"))
    vocabulary = materialize(vocabulary, "garbled-vocabulary")
    # Two lost characters read once more through the wrong code page are a form, too.
    lost = rows.sparkSession.createDataFrame([(_LOST * 2, 1 << 40, 0), (_LOST, 1 << 40, 0)], "token string, n long, extra long")
    forms = _bad_words(vocabulary.unionByName(lost))
    asked = scanned.where("n is null").select("tab", "row_key", "token", "extra")
    used = asked.groupBy("token").agg(F.count("*").alias("uses"), F.sum("extra").alias("more_uses"))
    # A form counts where it is no better known than its original, in distinct texts or in all
    # records: copies of the one or the other hide nothing. The best-known original wins.
    best = Window.partitionBy("token").orderBy(F.desc(F.col("n") + F.col("extra")), "original")
    ratio = F.when(F.length("original") == 1, SINGLE_RATIO).otherwise(1)
    own, own_all = F.coalesce("own", F.lit(0)), F.coalesce(F.col("own") + F.col("own_extra"), F.lit(0))
    n_all, uses_all = F.col("n") + F.col("extra"), F.col("uses") + F.col("more_uses")
    better = ((F.col("n") > own) & (F.col("n") > F.col("uses") * ratio)) | ((n_all > own_all) & (n_all > uses_all * ratio))
    bad = (
        forms.join(used, "token").join(vocabulary.select("token", F.col("n").alias("own"), F.col("extra").alias("own_extra")), "token", "left")
        .where(better)
        .withColumn("place", F.row_number().over(best)).where("place = 1").select("token", "original")
    )
    # What a lenient decoder made of any character it could not read: a form without an original.
    marks = rows.sparkSession.createDataFrame([(_LOST, None)], "token string, original string")
    return asked.join(bad.where(F.col("token") != _LOST).unionByName(marks), "token").select("tab", "row_key", "token", "original")


def _with_copies(found: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows (tab, row_key, ...) of first records, and the same for their copies."""
    others = copies.where("first.tab <> tab or first.row_key <> row_key").select("first", F.col("tab").alias("own_tab"), F.col("row_key").alias("own_key"))
    again = found.withColumn("first", F.struct("tab", "row_key")).join(others, "first").withColumns({"tab": F.col("own_tab"), "row_key": F.col("own_key")})
    return found.unionByName(again.drop("first", "own_tab", "own_key"))


def garbled_records(rows: DataFrame) -> DataFrame:
    """(tab, row_key) of the records of rows (tab, row_key, text) holding garbled text.

    Rows with a null key or text and plain ASCII texts are no case; a key counts
    once; an empty table gives no rows.
    """
    rows = rows.where("row_key is not null and text is not null")
    copies = _copies(rows)
    return _with_copies(_hits(rows, copies).select("tab", "row_key").distinct(), copies).distinct()


def restore(rows: DataFrame) -> DataFrame:
    """(tab, row_key, restored, complete): affected records with each verified garbled
    token replaced by its original, longest first from left to right; complete is false where
    lost characters, or ideographs that still read as bytes of another encoding, remain."""
    rows = rows.where("row_key is not null and text is not null")
    copies = _copies(rows)
    pairs = _hits(rows, copies).groupBy("tab", "row_key").agg(F.collect_set(F.struct("token", "original")).alias("found"))
    pairs = _with_copies(pairs, copies).groupBy("tab", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))

    @F.pandas_udf("string")
    def replaced(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, pairs in zip(text, found, strict=True):
            table = {p["token"]: p["original"] for p in pairs if p["original"] is not None}
            if table:
                pattern = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))
                t = pattern.sub(lambda m, table=table: table[m.group()].replace(_LOST * 2, _LOST), t)
            out.append(t)
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def finished(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _LOST not in t and not _wide(t)).astype(bool)

    joined = rows.join(pairs, ["tab", "row_key"]).withColumn("restored", replaced("text", "found"))
    return joined.select("tab", "row_key", "restored", finished("restored").alias("complete"))
