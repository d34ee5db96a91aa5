"""Problem 4: missing or wrong language labels, and passages in another language.

Script ranges narrow the candidates of every word, word statistics learnt from the
labelled documents score the rest, and a Viterbi pass with a switching penalty labels
the words of a document. Sentences take the language of most of their words; the main
language is that of most sentences, a segment a run of sentences in another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.garbled import CHAINS, _LOST, _PAGES, _WIDE_WRONG, _wide
from corpusloom.llm.lookalike import INVISIBLE_RANGES, LOOKALIKE_FROM, LOOKALIKE_TO
from corpusloom.llm.sentences import BREAK, CLOSE, OPEN, unit_pieces
from corpusloom.session import materialize

LANGUAGES = ("zh", "en", "de", "fr", "es", "ja", "ru", "hi", "th")
LATIN = ("en", "de", "fr", "es")
# Three-letter codes of the nine languages, both forms where there are two.
THREE_LETTERS = {"zho": "zh", "chi": "zh", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "jpn": "ja", "rus": "ru", "hin": "hi", "tha": "th"}
NO_LABEL = ("", "und", "unknown")
READS_WELL = 0.25  # score a character
SWITCH = 6.0  # log-score a change of language must gain
COPIES = 3  # how often one text counts in the word model
WORDS_AT_ONCE = 32_768  # words whose paths are found together; a longer text stands alone
SURE = 1.5  # log-score a sentence needs to count

_TOKEN = re.compile(r"(?P<letters>[A-Za-zÀ-ɏͰ-ӿ]+)|(?P<han>[一-鿿㐀-䶿々]+)|(?P<kana>[぀-ヿ]+)|(?P<deva>[ऀ-ॿ]+)|(?P<thai>[฀-๿]+)")
_ODD = re.compile("[\u0300-\u036f\u2e80-\u2fdf\u3099\u309a\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]")
_GARBLED = re.compile("[\x80-\x9fÃÂÐÑâ├√┬ĂŃ][\x80-ÿĀ-ž‚-™–-›├-╬┬⌐-⌠∂-≥¢-¿]|[РС][^\\sА-Яа-яёЁ\\w]|[²-þ]{4}|�|[А-Я]{2}[а-я]?[А-Я]{3}")
_INVISIBLE = {c: None for lo, hi in INVISIBLE_RANGES for c in range(lo, hi + 1)}
_TO_LATIN = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
_HIGH = re.compile("[\u0080-\U0010ffff]+")
# A letter drawn like a Latin one, inside a word that has Latin letters too.
_DISGUISED = re.compile(f"[A-Za-z][{LOOKALIKE_FROM}]|[{LOOKALIKE_FROM}][A-Za-z]")
# Fenced code (to a blank line where the fence stays open), code in a line, tags and entities are in no language.
_CODE = re.compile(rf"```.*?```|```[^\n{BREAK}]*(?:\n[^\n{BREAK}]+)*|`[^`\n{BREAK}]+`|<[A-Za-z/][^<>]{{0,200}}>|&#?\w{{2,8}};", re.S)
_QUOTED = re.compile(f"{OPEN}[^{CLOSE}]*{CLOSE}")
_ASCII = bytes(range(128))
_IDEOGRAPHS = re.compile("[\u2e80-\uffef]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")


def plain_code(label: Column) -> Column:
    """A two-letter code of the nine for any spelling of a label; null where it names none."""
    head = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)", 1)
    codes = THREE_LETTERS | {x: x for x in LANGUAGES}
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[head]


def word_model(df: DataFrame, text_col: str, label_col: str, *, sample: int = 20_000, words: int = 20_000) -> dict[str, np.ndarray]:
    """Log-scores of Latin-script words for each language of LATIN.

    Fitted on a bounded sample of labelled rows (about so many, by hash of the text; copies of
    a text count COPIES times at most) and on its most frequent words; other words score nothing.
    """
    labelled = df.select(F.col(text_col).alias("text"), plain_code(F.col(label_col)).alias("code")).where(F.col("text").isNotNull() & F.col("code").isin(*LATIN))
    share = max(1, round(labelled.count() / sample))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}_\d.])([a-zß-ɏ]+)(?![\p{L}_\d])"), F.lit(1))).alias("word")
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).groupBy(F.xxhash64("text"), "code").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(COPIES)).cast("int").alias("n"))
    drawn = drawn.select("code", F.explode(F.array_repeat("text", F.col("n"))).alias("text"))
    counts = drawn.select("code", word).groupBy("word").pivot("code", list(LATIN)).count().na.fill(0)
    rows = counts.withColumn("n", sum(F.col(x) for x in LATIN)).where("n >= 3").coalesce(4).orderBy(F.desc("n"), "word").limit(words).collect()
    table = np.array([[r[x] for x in LATIN] for r in rows], np.float64).reshape(-1, len(LATIN))
    total = table.sum(axis=0, keepdims=True)
    # A language without labelled rows has no evidence to offer.
    rate = np.where(total > 0, (table + 0.1) / (total + 1.0), 0.0)
    score = np.clip(np.log(np.maximum(rate, 1e-12) / np.maximum(rate.mean(axis=1, keepdims=True), 1e-12)), -2.5, 1.5)
    return {r.word: s for r, s in zip(rows, score, strict=True)}


class _Words:
    """Turns a piece of text into word numbers and weights; scores has a row for each number."""

    def __init__(self, model: dict[str, np.ndarray]):
        n = len(LANGUAGES)
        at = {x: i for i, x in enumerate(LANGUAGES)}
        rows = [np.zeros(n)]
        # A script's row: what a character says for and against each language.
        self.script = {}
        for name, scores in (("han", {"zh": 0.5, "ja": 0.2}), ("kana", {"ja": 0.9}), ("deva", {"hi": 0.8}), ("thai", {"th": 0.8}), ("cyrillic", {"ru": 0.8})):
            row = np.full(n, -0.4)
            for code, value in scores.items():
                row[at[code]] = value
            self.script[name] = len(rows)
            rows.append(row)
        self.word = {}
        for word, score in model.items():
            row = np.full(n, -0.8)
            row[[at[x] for x in LATIN]] = score
            self.word[word] = len(rows)
            rows.append(row)
        self.scores = np.array(rows)

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        if _ODD.search(text):
            text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
        numbers, weights = [], []
        disguised = not text.isascii() and _DISGUISED.search(text)
        if text.count(_LOST) > 2:
            # Lost letters keep their layout: unbroken runs stand for Chinese, words of them for Russian.
            runs = [r for r in _HIGH.findall(text) if r.count(_LOST) * 3 > len(r)]
            if sum(map(len, runs)) * 3 > len(text):
                name = "han" if max(map(len, runs)) > 14 else "cyrillic"
                return [self.script[name]] * len(runs), [float(min(len(r), 12)) for r in runs]
        for match in _TOKEN.finditer(text):
            kind, token = match.lastgroup, match.group()
            if kind != "letters":
                numbers.append(self.script[kind])
                weights.append(min(len(token), 12))
                continue
            number = self.word.get(token.lower(), 0)
            if not number and not token.isascii():
                latin = token.translate(_TO_LATIN) if disguised else token
                if latin != token and not _CYRILLIC.search(latin):
                    number = self.word.get(latin.lower(), 0)
                elif _CYRILLIC.search(token):
                    numbers.append(self.script["cyrillic"])
                    weights.append(min(len(token), 12))
                    continue
            numbers.append(number)
            weights.append(1.0)
        return numbers, weights

    def says(self, piece: str) -> tuple[list[int], list[float]]:
        """Word numbers and weights of a sentence; quotations in it count only where the rest says too little."""
        if OPEN in piece and not self.suspicious(piece):
            numbers, weights = self(self.readable(_QUOTED.sub(" ", piece)))
            if numbers and (self.scores[numbers] * np.array(weights)[:, None]).sum(axis=0).max() >= SURE:
                return numbers, weights
        return self(self.readable(piece))

    def known(self, text: str) -> float:
        """How well the text reads: the best language's score a character."""
        numbers, weights = self(text)
        if not numbers:
            return 0.0
        return float((self.scores[numbers] * np.array(weights)[:, None]).sum(axis=0).max()) / max(8, len(text))

    @staticmethod
    def suspicious(text: str) -> bool:
        return not text.isascii() and bool(_GARBLED.search(text) or _wide(text))

    def readable(self, text: str) -> str:
        """The text itself, or what it stands for where it was decoded wrongly."""
        if not self.suspicious(text):
            return text
        best, best_score = text, self.known(text)
        least = (False, best_score * 1.2 + 0.01)
        # Text that reads well can only be ideographs of a wide code page.
        foreign = text.replace(_LOST, "")
        ideographs = 3 * len(_IDEOGRAPHS.findall(foreign)) > 2 * sum(map(len, _HIGH.findall(foreign)))
        chains = CHAINS if best_score < READS_WELL and _GARBLED.search(text) else _WIDE_CHAINS if _wide(text) else ()
        for chain in chains:
            other, sure = text, True
            for right, wrong in reversed(chain):
                raw = _unread(other, wrong)
                other = raw.decode(right, "ignore") if len(raw) >= 0.7 * len(other) else ""
                back = other.encode(right, "ignore")
                # Bytes that are letters of UTF-8 are no text of another code page, however well it reads;
                # a wide page loses some of them and needs more to show it.
                wide, high = wrong in _WIDE_WRONG, len(raw.translate(None, _ASCII))
                fits = ideographs and high >= 12 if wide else high > 1
                sure = sure and right == "utf-8" and fits and len(back.translate(None, _ASCII)) >= (0.6 if wide else 0.8) * high
                if len(back) < 0.8 * len(raw) and not sure:
                    other = ""  # most of it cannot have come this way
            if not other or other == text:
                continue
            score = self.known(other)
            if score > 0 and (sure, score) > least:
                best, least = other, (sure, score if sure else score * 1.2 + 0.01)
        return best


def _no_code(text: str) -> str:
    """The text with blanks for what is in no language, of the same length."""
    return _CODE.sub(lambda m: " " * len(m.group()), text) if "`" in text or "<" in text or "&" in text else text


_WIDE_CHAINS = [c for c in CHAINS if c[0][1] in _WIDE_WRONG]
_BACK = {code: {ord(c): b for b, c in page.items()} for code, page in _PAGES.items()}


def _unread(text: str, wrong: str) -> bytes:
    text = text.replace(_LOST, "")
    if wrong in _BACK:
        back = _BACK[wrong]
        return text.translate(back).encode("latin-1", "ignore")
    return text.encode(wrong, "ignore")


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word: scores is texts x words x languages, padded with zeros."""
    texts, steps, _ = scores.shape
    value = np.zeros((texts, scores.shape[2]))
    came = np.empty((steps, texts, scores.shape[2]), np.int8)
    own = np.arange(scores.shape[2], dtype=np.int8)[None, :]
    for t in range(steps):
        top = value.argmax(axis=1)
        jump = value[np.arange(texts), top][:, None] - switch
        came[t] = np.where(jump > value, top[:, None], own)
        value = np.maximum(value, jump) + scores[:, t]
    path = np.empty((texts, steps), np.int8)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        path[:, t] = state
        state = came[t][np.arange(texts), state]
    return path


def label_passages(df: DataFrame, id_col: str, text_col: str, label_col: str, source_col: str | None = None, *, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, role, lang_code, confidence, first_unit, last_unit, label): for every text its
    'main' language and each 'segment', a run of two or more sentences in another one.

    Confidence is the share of the evidence that speaks for the language. Null texts and
    texts without any evidence give no row; a repeated id gives rows for each text.
    Headings, bullets and sentences without evidence neither make nor break a run; code,
    tags and, where the rest of the sentence suffices, quotations are no evidence.
    Unit numbers count the pieces of unit_pieces; they are null where one language
    alone has evidence and the text was not cut.
    """
    model = word_model(df, text_col, label_col) if model is None else model
    names = ["id", "role", "lang_code", "confidence", "first_unit", "last_unit", "label"]
    schema = "id long, role string, lang_code string, confidence double, first_unit long, last_unit long, label string"
    by_line = F.coalesce(F.col(source_col) == "slack", F.lit(False)) if source_col else F.lit(False)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), by_line.alias("by_line"), F.col(label_col).alias("label"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with evidence for one language only are done; the others keep their text."""
        words = _Words(model)
        for batch in batches:
            ids, raw, lines, labels = (batch.column(c).to_pylist() for c in ("id", "text", "by_line", "label"))
            read = [words(t if not words.suspicious(t) else "\n".join(map(words.readable, t.split("\n")))) for t in map(_no_code, raw)]
            order = sorted(range(len(raw)), key=lambda i: len(read[i][0]))
            one: list = [None] * len(raw)
            sure = [0.0] * len(raw)
            mixed = [False] * len(raw)
            for part in _alike([i for i in order if read[i][0]], lambda i: len(read[i][0])):
                scores, path = _paths([read[i] for i in part], words)
                for row, i in enumerate(part):
                    size = len(read[i][0])
                    gain = np.bincount(path[row, :size], np.maximum(scores[row, np.arange(size), path[row, :size]], 0), len(LANGUAGES))
                    best = int(gain.argmax())
                    one[i], sure[i] = LANGUAGES[best] if gain[best] > 0 else None, float(gain[best] / max(gain.sum(), 1e-9))
                    mixed[i] = bool(np.sort(gain)[-2] >= SURE)
            kept = [t if m else None for t, m in zip(raw, mixed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.string()), pa.array(sure, pa.float64()), pa.array(kept, pa.string()), pa.array(lines, pa.bool_()), pa.array(labels, pa.string())], ["id", "lang_code", "confidence", "text", "by_line", "label"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model)
        for batch in batches:
            docs = []
            for i, k, l in zip(*(batch.column(c).to_pylist() for c in ("id", "pieces", "label")), strict=True):
                numbers, weights, unit = [], [], []
                text, end = _no_code("".join(k)), 0
                for u, piece in enumerate(k):
                    start, end = end, end + len(piece)
                    n, w = words.says(text[start:end])
                    numbers += n
                    weights += w
                    unit += [u] * len(n)
                if numbers:
                    docs.append((i, k, l, numbers, weights, unit))
            docs.sort(key=lambda d: len(d[3]))
            out = []
            for part in _alike(docs, lambda d: len(d[3])):
                out += _decide(part, words)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    surveyed = materialize(texts.mapInArrow(survey, "id long, lang_code string, confidence double, text string, by_line boolean, label string"), "languages")
    done = surveyed.where("text is null and lang_code is not null").select("id", F.lit("main").alias("role"), "lang_code", "confidence", F.lit(None).cast("long").alias("first_unit"), F.lit(None).cast("long").alias("last_unit"), "label")
    pieces = surveyed.where("text is not null").select("id", unit_pieces(F.col("text"), F.col("by_line")).alias("pieces"), "label")
    return done.unionByName(pieces.mapInArrow(label, schema))


def _alike(ordered: list, length) -> Iterator[list]:
    """Groups of texts of like length (sorted by it): padded to the longest, a group is bounded in words."""
    group: list = []
    for one in ordered:
        if group and (len(group) + 1) * length(one) > WORDS_AT_ONCE:
            yield group
            group = []
        group.append(one)
    if group:
        yield group


def _paths(texts: list[tuple], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Scores and best languages of the words of a few texts of like length."""
    scores = np.zeros((len(texts), max(len(t[0]) for t in texts), len(LANGUAGES)))
    for row, (numbers, weights) in enumerate(texts):
        scores[row, : len(numbers)] = words.scores[numbers] * np.array(weights)[:, None]
    return scores, viterbi(scores, SWITCH)


def _decide(docs: list[tuple], words: _Words) -> list[tuple]:
    """The rows of a few documents of like length."""
    n = len(LANGUAGES)
    scores, path = _paths([(d[3], d[4]) for d in docs], words)
    out = []
    for row, (key, pieces, label, numbers, _, unit) in enumerate(docs):
        size, unit = len(numbers), np.array(unit)
        won = np.zeros((len(pieces), n))
        gain = np.maximum(scores[row, np.arange(size), path[row, :size]], 0)
        np.add.at(won, (unit, path[row, :size]), gain)
        total = won.sum(axis=1)
        lang = np.where(total >= SURE, won.argmax(axis=1), -1)
        if (lang < 0).all():
            lang = np.where(total > 0, won.argmax(axis=1), -1)
        seen = lang[lang >= 0]
        if not len(seen):
            continue
        # Most sentences; the evidence breaks a tie.
        main = max(range(n), key=lambda x: (np.sum(seen == x), won[:, x].sum()))
        out.append((key, "main", LANGUAGES[main], float(won[:, main].sum() / max(total.sum(), 1e-9)), 0, len(pieces) - 1, label))
        run: list[int] = []
        plain = [u for u in range(len(pieces)) if lang[u] >= 0 and not re.match(r"\s*(?:#{1,6}|[-*+•])\s", pieces[u])] + [-1]
        for u in plain:
            if run and (u < 0 or lang[u] != lang[run[-1]]):
                if lang[run[0]] != main and len(run) > 1:
                    code, part = lang[run[0]], slice(run[0], run[-1] + 1)
                    out.append((key, "segment", LANGUAGES[code], float(won[part, code].sum() / max(total[part].sum(), 1e-9)), run[0], run[-1], label))
                run = []
            run.append(u)
    return out


def found_labels(df: DataFrame, id_col: str, text_col: str, label_col: str, source_col: str | None = None) -> DataFrame:
    """(id, lang_code, role): the main language where the label is missing or names another
    one, and one row for each language of a segment."""
    rows = label_passages(df, id_col, text_col, label_col, source_col)
    code = plain_code(F.col("label"))
    missing = F.coalesce(F.lower(F.trim("label")), F.lit("")).isin(*NO_LABEL)
    wrong = missing | (F.coalesce(code, F.lit("")) != F.col("lang_code"))
    return rows.where((F.col("role") == "segment") | wrong).select("id", "lang_code", "role").distinct()
