"""Problem 8: visually identical text with different characters.

Look-alike-mapped texts are grouped under the accent-sensitive, case-sensitive
Unicode collation in SQL, each equivalence class gets one canonical member, and
the member is joined back to every row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

# Letters of other scripts drawn like Latin letters.
LOOKALIKE_FROM = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρϲϳօɡɑ"
LOOKALIKE_TO = "aeopcyxijshdqwlABEKMHOPCTYXIJSIABEZHIKMNOPTYXovapcjoga"
# Radicals of the supplement and the unified ideographs drawn like them.
RADICALS_FROM = "⺁⺂⺃⺄⺅⺆⺈⺉⺊⺌⺎⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺫⺬⺭⺯⺰⺱⺲⺶⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳"
RADICALS_TO = "厂乛乚乙亻冂刀刂卜小兀尢巳幺彑彐忄㣺扌攵旡月歺母民氵氺灬爫爫丬牛犭王罒示礻糹纟罓罒羊耂肀聿肉臼艹艹艹虎衤覀西见角讠贝车辶辶辶邑钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟"
# Kinds of space and characters without a glyph (code point ranges, inclusive).
SPACE_RANGES = ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
INVISIBLE_RANGES = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
# full/half-width forms, radicals and compatibility ideographs.
COMPAT_RANGES = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF01, 0xFFEE), (0x2F800, 0x2FA1F))
# Blocks whose composed letters can hide a mapped base letter.
COMPOSED_RANGES = ((0x00C0, 0x024F), (0x0370, 0x052F), (0x0900, 0x0DFF), (0x1E00, 0x1FFF), (0x3040, 0x30FF))


def _each(ranges):
    for lo, hi in ranges:
        yield from map(chr, range(lo, hi + 1))


@lru_cache(maxsize=1)
def fold_table() -> dict[str, str]:
    """Character to its consistent form ('' drops it), built from the Unicode data."""
    table = {c: " " for c in _each(SPACE_RANGES)}
    table |= {c: "" for c in _each(INVISIBLE_RANGES)}
    letters = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True))
    for c in _each(COMPAT_RANGES):
        if c not in table:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                table[c] = letters.get(plain, plain)
    table |= dict(zip(RADICALS_FROM, RADICALS_TO, strict=True))
    table |= letters
    for c in _each(COMPOSED_RANGES):
        parts = unicodedata.normalize("NFD", c)
        if c not in table and parts[0] in letters:
            plain = unicodedata.normalize("NFC", letters[parts[0]] + parts[1:])
            if len(plain) == 1:
                table[c] = plain
    return table


@lru_cache(maxsize=1)
def bare_table() -> dict[str, str]:
    """The fold followed by dropping every mark: each letter to its base letter."""
    table = dict(fold_table())
    for c in _each(COMPOSED_RANGES):
        parts = unicodedata.normalize("NFD", table.get(c, c))
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            table[c] = fold_table().get(parts[0], parts[0])
    return table | {c: "" for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.combining(c)}


def _translate(col: Column, table: dict[str, str]) -> Column:
    kept = [c for c, to in table.items() if to]
    gone = [c for c, to in table.items() if not to]
    return F.translate(col, "".join(kept + gone), "".join(table[c] for c in kept))


def fold_lookalikes(col: Column) -> Column:
    """One consistent form up to canonical equivalence: widths, spaces, invisible
    characters, compatibility ideographs and look-alike letters. Null stays null."""
    return _translate(F.replace(col, F.lit("ำ"), F.lit("ํา")), fold_table())


def coarse_key(text: Column) -> Column:
    """A key equal for all texts that the collation may hold equal (marks dropped):
    it only decides which rows meet, the collation decides whether they match."""
    bare = _translate(F.replace(text, F.lit("ำ"), F.lit("ํา")), bare_table())
    return F.xxhash64(F.when(text.rlike(r"[^\x00-\x7f]"), bare).otherwise(text))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) without nulls, and its written (id, text_hash, coarse)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows, materialize(rows.select("id", F.xxhash64("text").alias("text_hash"), coarse_key(F.col("text")).alias("coarse")), "lookalike")


def _spread(keyed: DataFrame) -> DataFrame:
    """Per key the range of text hashes; copies collapse before the shuffle."""
    return keyed.groupBy("coarse").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.min("id").alias("first_id"))


def canonical_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, class_id, text_hash, is_canonical.

    class_id is the id of the class's canonical member: a member already in the
    consistent form if there is one, then the least id. Rows with null id or text
    are left out; an empty text is a text like any other; exact copies share a
    class. Other columns of df are not carried, so their names cannot clash.
    """
    rows, keyed = _keyed(df, id_col, text_col)
    spread = _spread(keyed)
    alike = spread.where("lo = hi").select("coarse", F.col("first_id").alias("class_id"))
    plain = keyed.join(alike, "coarse").select("id", "class_id", "text_hash")
    return plain.unionByName(_collated(rows, keyed, spread))


def look_alike_members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, text_hash) of the rows whose coarse key holds differing texts."""
    rows, keyed = _keyed(df, id_col, text_col)
    return _collated(rows, keyed, _spread(keyed))


def _collated(rows: DataFrame, keyed: DataFrame, spread: DataFrame) -> DataFrame:
    met = keyed.join(spread.where("lo <> hi").select("coarse"), "coarse", "left_semi")
    members = rows.join(met, "id").withColumn("folded", fold_lookalikes(F.col("text")))
    members = members.select("coarse", "id", "text_hash", (F.col("text") != F.col("folded")).alias("changed"), "folded")
    return rows.sparkSession.sql(
        """
        SELECT m.id, c.canonical.id AS class_id, m.text_hash
        FROM {members} m JOIN (
            SELECT coarse, folded COLLATE UNICODE AS look, min(struct(changed, id)) AS canonical
            FROM {members} GROUP BY coarse, folded COLLATE UNICODE
        ) c ON m.coarse = c.coarse AND m.folded COLLATE UNICODE = c.look
        """,
        members=materialize(members, "lookalike-met"),
    )


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts differ but look the same.

    The differing texts of a class are paired first, their rows are joined to them after:
    copies of one text never meet each other. A pair of rows is given once, whatever
    the number of rows of an id; null ids and texts have no pair.
    """
    members = materialize(look_alike_members(df, id_col, text_col).select("class_id", "text_hash", "id").distinct(), "lookalike-members")
    texts = members.select("class_id", "text_hash").distinct()
    met = texts.alias("p").join(texts.alias("q"), F.expr("p.class_id = q.class_id and p.text_hash < q.text_hash"))
    met = met.select("p.class_id", F.col("p.text_hash").alias("hash_a"), F.col("q.text_hash").alias("hash_b"))
    a = members.select("class_id", F.col("text_hash").alias("hash_a"), F.col("id").alias("x"))
    b = members.select("class_id", F.col("text_hash").alias("hash_b"), F.col("id").alias("y"))
    both = met.join(a, ["class_id", "hash_a"]).join(b, ["class_id", "hash_b"]).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
