"""Column functions for cleaning, splitting and chunking text, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order they are decoded, so "&amp;lt;" ends as "<".
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&#39;", "'"))
# File name prefixes and their categories.
CATEGORY_PREFIXES = (("wiki_", "wiki"), ("notice", "notice"), ("faq", "faq"), ("case_study", "case_study"), ("report", "report"), ("term_", "term"))
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = "\ue000"  # a cut between sentences


def strip(text: Column) -> Column:
    """Removes every Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def with_value(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body's inner functions use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_starts(sizes: Column) -> Column:
    """The sum of all sizes before each. Sums run inside stretches of 256 and over the stretches,
    so that an array grown step by step stays short however many sizes there are."""

    def grown(first: Column, some: Column) -> Column:
        return F.aggregate(some, F.array(first), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

    def joined(runs: Column) -> Column:
        firsts = grown(F.lit(0), F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda total, n: total + n)))
        inside = F.zip_with(F.slice(firsts, 1, F.size(runs)), runs, lambda first, run: F.slice(grown(first, run), 1, F.size(run)))
        return F.flatten(inside)

    def stretches(s: Column) -> Column:
        last = F.floor(F.greatest(F.size(s) - 1, F.lit(0)) / 256).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(s, i * 256 + 1, 256))

    return with_value(with_value(sizes, stretches), joined)


def clean_text(text: Column) -> Column:
    """Tags to spaces, entities decoded, control characters dropped, white space merged."""
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    text = F.regexp_replace(text, r"[\r\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.regexp_replace(text, rf"[{_SPACE}&&[^\n\t ]]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(text)


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return _kept(F.split(text, r"\n\s*\n"))


def split_sentences(text: Column) -> Column:
    """Cuts after CJK end marks and line breaks, after ! and ?, and after a full stop that
    white space and a capital or digit follow."""
    marked = F.regexp_replace(text, r"([。！？\n!?])\s*", f"$1{_MARK}")
    return _kept(F.split(F.regexp_replace(marked, r"\.\s+(?=[A-Z\d])", f".{_MARK}"), _MARK))


def greedy_blocks(parts: Column, size: int) -> Column:
    """Joins neighbouring parts with a space while they fit into size characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(" "), part))
        fits = (state["open"] == "") | (F.length(joined) <= size)
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunk_text(text: Column, size: int = 700, overlap: int = 120, least: int = 40) -> Column:
    """array<struct<text, char_start, char_end>> of a cleaned text.

    Paragraphs are split into sentences and merged greedily; a block beyond size is cut
    into windows that overlap. Offsets count the blocks joined by one character. Pieces
    under least characters are dropped; if none is left the whole text is one chunk.
    Null and blank texts give an empty array.
    """
    if size <= 0 or overlap < 0 or size <= overlap:
        raise ValueError("size must be positive and larger than a non-negative overlap")
    blocks = text_blocks(text, size)
    return placed_chunks(text, blocks, block_starts(blocks), size, overlap, least)


def text_blocks(text: Column, size: int) -> Column:
    return F.flatten(F.transform(paragraphs(text), lambda p: greedy_blocks(split_sentences(p), size)))


def block_starts(blocks: Column) -> Column:
    return running_starts(F.transform(blocks, lambda b: F.length(b) + 1))


def placed_chunks(text: Column, blocks: Column, starts: Column, size: int, overlap: int, least: int) -> Column:
    """The chunks of chunk_text from its intermediate columns; as columns of their own they are computed once."""
    placed = F.zip_with(F.slice(starts, 1, F.greatest(F.size(blocks), F.lit(1))), blocks, lambda at, b: F.struct(at.alias("at"), b.alias("b")))

    def windows(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(x["b"]) - 1, F.lit(0)), F.lit(size - overlap))
        cut = F.transform(starts, lambda s: F.struct(strip(F.substring(x["b"], s + 1, F.lit(size))).alias("text"), (x["at"] + s).alias("char_start"), (x["at"] + F.least(s + size, F.length(x["b"]))).alias("char_end")))
        whole = F.array(F.struct(x["b"].alias("text"), x["at"].alias("char_start"), (x["at"] + F.length(x["b"])).alias("char_end")))
        return F.when(F.length(x["b"]) <= size, whole).otherwise(cut)

    pieces = F.filter(F.flatten(F.transform(placed, windows)), lambda c: F.length(c["text"]) >= least)
    all_of_it = F.array(F.struct(text.alias("text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end")))
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(blank, F.slice(all_of_it, 1, 0)).otherwise(F.when(F.size(pieces) > 0, pieces).otherwise(all_of_it))


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), rf"[{_SPACE}]+", "")


def guess_category(name: Column) -> Column:
    chosen = F.lit("general")
    for prefix, category in reversed(CATEGORY_PREFIXES):
        chosen = F.when(F.lower(name).startswith(prefix), category).otherwise(chosen)
    return chosen


def html_to_markdown(html: Column) -> Column:
    """Code blocks, headings and line structure as Markdown, other tags to spaces.

    The text is cut into tags and what lies between; a table says what each tag becomes.
    """
    marks = {"pre": "\n```\n", "/pre": "\n```\n", "code": "`", "/code": "`", "br": "\n", "p": "\n", "/p": "\n"}
    for level in range(1, 7):
        marks |= {f"h{level}": "\n" + "#" * level + " ", f"/h{level}": "\n"}
    table = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    tag = lambda x: F.lower(F.regexp_extract(x, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    pieces = F.regexp_extract_all(html, F.lit("(<[^>]+>|[^<]+|<)"), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^<[^>]+>$"), F.coalesce(F.try_element_at(table, tag(x)), F.lit(" "))).otherwise(decode_entities(x))), "")
    lines = F.regexp_replace(F.regexp_replace(joined, r"[ \t]{2,}|\t", " "), r"\n(?:[ \t]*\n){2,}", "\n\n")
    return strip(lines)


def article_body(html: Column) -> Column:
    """Markdown of the first article element, else of the element marked as the content, else ''."""
    article = F.try_element_at(F.split(html, r"(?i)<article\b[^>]*>", 2), F.lit(2))
    # How the content element is marked.
    content = F.try_element_at(F.split(html, r"(?i)<div\b[^>]*\b(?:article_content|content_views)\b[^>]*>", 2), F.lit(2))
    inside = F.coalesce(F.split(article, "(?i)</article>")[0], F.split(content, r"(?i)</div>\s*(?=<(?:div|section|aside|footer)\b|</(?:body|main)|$)", 2)[0])
    return F.coalesce(html_to_markdown(inside), F.lit(""))


def strip_html(text: Column) -> Column:
    return strip(F.regexp_replace(decode_entities(text), "<[^>]+>", ""))


def safe_name(title: Column, length: int = 80, default: str = "document", ascii_only: bool = False) -> Column:
    """A file name of lower-case letters, digits, _ and -; ascii_only drops all other scripts."""
    kept = "[^a-z0-9_-]" if ascii_only else r"[^\p{L}\p{N}_-]"
    name = F.regexp_replace(F.regexp_replace(F.lower(strip(title)), rf"[{_SPACE}]+", "_"), kept, "")
    return F.coalesce(F.nullif(F.substring(name, 1, length), F.lit("")), F.lit(default))


def plain_url(url: Column) -> Column:
    """The URL without its query string."""
    return F.split(url, r"\?")[0]


def year_of(date: Column) -> Column:
    """The year of a date in one of the accepted formats, else the first 19xx or 20xx, else null."""
    formats = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = F.coalesce(*(F.year(F.try_to_timestamp(F.trim(date), F.lit(f))) for f in formats))
    return F.coalesce(parsed, F.regexp_extract(date, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int"))


def snippet(text: Column, size: int = 400) -> Column:
    """The first characters on one line, with dots where the text goes on."""
    one_line = F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > size, F.concat(one_line, F.lit("..."))).otherwise(one_line)


def escape_html(text: Column) -> Column:
    """Text as HTML: the five special characters as entities, line ends as breaks."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def plain_title(title: Column) -> Column:
    """Letters, digits, _ and - of any script; spaces become _, all else is dropped."""
    return F.replace(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("_"))


def strip_html_inline(text: Column) -> Column:
    """One line of text: code in backticks (blocks in three), other tags and white space to single spaces."""
    table = F.create_map(*[F.lit(x) for pair in (("code", "`"), ("/code", "`"), ("pre", " ``` "), ("/pre", " ``` ")) for x in pair])
    pieces = F.regexp_extract_all(decode_entities(text), F.lit("(<[^>]+>|[^<]+|<)"), F.lit(1))
    marked = F.transform(pieces, lambda x: F.when(x.rlike("^<[^>]+>$"), F.coalesce(F.try_element_at(table, F.regexp_extract(x, "^<(/?(?:code|pre))>$", 1)), F.lit(" "))).otherwise(x))
    return strip(F.regexp_replace(F.array_join(marked, ""), rf"[{_SPACE}]+", " "))


# How a question names a language, and what marks an image instead of a question.
LANGUAGE_WORDS = r"(?i)中文|英文|英语|汉语|语言\s*(?:为|是|=)|language\s*[:=]|\bzh\b|\ben\b"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "tiff")
IMAGE_NAMES = ("image.png", "image.jpg", "clipboard")


def names_language(question: Column) -> Column:
    """Whether a question asks for a language, so that a language filter may apply."""
    return F.coalesce(question.rlike(LANGUAGE_WORDS), F.lit(False))


def question_error(question: Column) -> Column:
    """null for a usable question, else why not: empty, image_file, image_data or pasted_image."""
    plain = F.lower(strip(question))
    return (
        F.when(F.coalesce(plain, F.lit("")) == "", "empty")
        .when(plain.rlike(rf"\.(?:{'|'.join(IMAGE_SUFFIXES)})$"), "image_file")
        .when(strip(question).startswith("data:image") | plain.contains("![image]"), "image_data")
        .when(plain.rlike("|".join(x.replace(".", r"\.") for x in IMAGE_NAMES)), "pasted_image")
    )
