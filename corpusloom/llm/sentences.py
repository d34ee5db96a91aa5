"""Problem 3: sentence units across languages and scripts, in SQL expressions only.

Marks that do not end a sentence (decimals, file names, URLs, initials, abbreviations,
everything inside quotations) are masked by private-use placeholders of the same
length. Script-specific patterns then turn the white space at a boundary into a break
character, or insert a zero-width cut where the script writes none. Offsets follow
from the lengths of the pieces, and the text of a unit is read from the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import running_starts

STRETCH = 4096  # code points; the text is kept in stretches to read units from
# Placeholders: opening and closing quote, masked mark, break (one character), cut (no character).
OPEN, CLOSE, MASK, BREAK, CUT = "\ue010", "\ue011", "\ue020", "\ue001", "\ue002"

# Abbreviations that never end a sentence, by language.
ABBREVIATIONS = (
    "Dr Prof Mr Mrs Ms St No Nos Fig Figs Sec Eq vs approx cf Vol pp p ed e.g i.e Gen Gov Lt Col Sgt Rev Hon Jr Sr "
    "Nr Abs Abb Vgl vgl bzw ca z d h u Hr Fr Bd Kap Str Tab Tel geb evtl ggf inkl zzgl "
    "M MM Mme Mlle fig chap art env éd "
    "Sra Srta Dra pág págs aprox núm art cap Ud Uds EE "
    "डॉ प्रो श्री "
    "т е г гг др рис Рис см См стр Стр проф Проф им ул тыс млн млрд акад табл гл"
)
# German month names after an ordinal day.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# How a Chinese or Japanese sentence goes on after a quotation with an end mark.
GOES_ON = "然后|我们照|没有人|没人|有人|于是|随后|接着|这样|说|问|答|道|写|喊|的|地|后|并|就|也|是|和|与|等|と|って|が|を|は|に|の|で|も|など|という"

_END = ".!?。！？｡।॥"
_CJK = r"\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f"
_CLOSERS = CLOSE + r")\]）】》’'"


def _quotes(text: Column) -> Column:
    """Balanced quotations get uniform marks; one inside another keeps its own."""
    inside = f"(?![^{OPEN}{CLOSE}]*{CLOSE})"
    for left, right, barred in (("「", "」", "「」"), ("『", "』", "『』"), ("„", "[“”]", "„“”"), ("“", "”", "“”"), ("«", "»", "«»"), ('"', '"', '"')):
        stop = BREAK if left != '"' else BREAK + r"\n"
        text = F.regexp_replace(text, f"{left}([^{barred}{stop}]*){right}{inside}", f"{OPEN}$1{CLOSE}")
    return text


def unit_pieces(text: Column, by_line: Column) -> Column:
    """The consecutive pieces of a text; joined, and without the breaks' meaning, they are the text.
    by_line says whether every line is a unit of its own."""
    hard = r"(?m)\n(?=\s*$|\s*\n|[ \t]*(?:#{1,6}|[-*+•])[ \t])|(?<=\n)\n|\n(?=```)"
    blocks = F.regexp_replace(text, hard, BREAK)
    line = rf"(?:#{{1,6}}|[-*+•])[ \t][^\n{BREAK}]*"
    blocks = F.regexp_replace(blocks, rf"((?:^|[\n{BREAK}])[ \t]*{line})\n", f"$1{BREAK}")
    blocks = F.split(F.when(by_line, F.translate(text, "\n", BREAK)).otherwise(blocks), f"(?<={BREAK})")
    whole = lambda b: by_line | b.rlike(rf"^\s*{line}") | ~b.rlike(rf"[{_END}฀-๿]")
    return F.flatten(F.transform(blocks, lambda b: F.when(whole(b), F.array(b)).otherwise(F.split(break_marks(b), f"(?<={BREAK})|{CUT}"))))


def break_marks(marked: Column) -> Column:
    """A block of running text with a BREAK for each separating white space and a CUT at each bare boundary."""
    marked = _quotes(marked)
    inside = rf"(?=[^{OPEN}{CLOSE}{BREAK}]*{CLOSE})"
    marked = F.when(marked.contains(CLOSE), F.regexp_replace(marked, f"[{_END}]{inside}", MASK)).otherwise(marked)
    words = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS.split())
    marked = F.regexp_replace(marked, rf"\.(?=[^\s{BREAK}{_CLOSERS}.!?])|(?<=\.)\.(?=\.)|\.(?=\.)", MASK)
    marked = F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}_])((?:{words}|\p{{Lu}}))\.(?=\s)", f"$1{MASK}")
    marked = F.regexp_replace(marked, rf"(?<=\b\d{{1,2}})\.(?=\s(?:{MONTHS}))", MASK)
    # Spaced scripts: end marks, closers, white space, then anything but a small letter or punctuation.
    marked = F.regexp_replace(marked, rf"([.!?।॥][.!?।॥]*[{_CLOSERS}]*)\s(?=\s*[^\s\p{{Ll}},;:.!?)\]])", f"$1{BREAK}")
    marked = F.regexp_replace(marked, rf"({MASK}{CLOSE}[)\]）]*)\s(?=\s*(?:[\p{{Lu}}\p{{N}}¿¡{OPEN}{_CJK}]))", f"$1{BREAK}")
    # Scripts without spaces: after the end marks and closers, unless the sentence plainly goes on.
    marked = F.regexp_replace(marked, rf"([。！？｡][。！？｡!?]*[{_CLOSERS}]*)(?![{_CLOSERS}。！？｡，、；：,;:{BREAK}]|$)", f"$1{CUT}")
    marked = F.regexp_replace(marked, rf"({MASK}{CLOSE})(?![\s{_CLOSERS}。！？｡，、；：,.;:!?…—{BREAK}\p{{Ll}}]|$|{GOES_ON})(?=[{_CJK}\p{{Lu}}\p{{N}}{OPEN}])", f"$1{CUT}")
    # Hindi stops without white space, Thai white space between letters.
    marked = F.regexp_replace(marked, r"([।॥])(?=[\p{L}\p{N}])", f"$1{CUT}")
    return F.regexp_replace(marked, r"(?<=[฀-๿])\s(?=\s*[฀-๿])", BREAK)


def sentences(df: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """(id, char_start, char_end, sentence): the units of every text with code point offsets.

    Lines are units where source_col is 'slack' (null counts as another source).
    Null and blank texts give no unit; a repeated id gives the units of each row;
    texts of any length are read whole. Private-use characters of the placeholders
    found in a text are read as white space. Extra columns are ignored.
    """
    by_line = F.coalesce(F.col(source_col) == "slack", F.lit(False)) if source_col else F.lit(False)
    own = "".join((OPEN, CLOSE, MASK, BREAK, CUT))
    rows = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("stretches"), unit_pieces(F.translate(text_col, own + "\r", " " * 6), by_line).alias("pieces")
    )
    # Lengths are added up inside the row: no shuffle.
    starts = running_starts(F.transform("pieces", F.length))
    # An expression, not a column, is exploded: on a column Spark would put a filter that splits every text again.
    units = F.zip_with("pieces", starts, lambda piece, start: F.struct(piece.alias("piece"), start.alias("start")))
    unit = rows.select("id", "stretches", F.explode(units).alias("u"))
    blank = rf"[\s\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff{BREAK}]"
    head = F.regexp_replace(F.col("u.piece"), f"^{blank}+", "")
    start = F.col("u.start") + F.length("u.piece") - F.length(head)
    size = F.length(F.regexp_replace(head, f"{blank}+$", ""))
    unit = unit.select("id", "stretches", start.alias("s"), (start + size).alias("e")).where("e > s")
    # A unit is read from the few stretches it lies in, not from the start of its text.
    first, last = F.floor(F.col("s") / STRETCH).cast("int"), F.floor((F.col("e") - 1) / STRETCH).cast("int")
    near = F.array_join(F.slice("stretches", first + 1, last - first + 1), "")
    sentence = F.substring(near, F.col("s") - first * STRETCH + 1, F.col("e") - F.col("s"))
    return unit.select("id", F.col("s").cast("long").alias("char_start"), F.col("e").cast("long").alias("char_end"), sentence.alias("sentence"))
