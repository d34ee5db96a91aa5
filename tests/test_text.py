import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as T


def value(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_clean(spark):
    got = value(spark, T.clean_text(F.col("t")), "<b>a</b>&amp;lt;\r\n\n\n\nb\t c", " x　", None, "")
    assert got == ["a <\n\nb c", "x", None, ""]


def test_sentences(spark):
    got = value(spark, T.split_sentences(F.col("t")), "一。二！三", "v1.0.0 is out. Next 2. B", "")
    assert got == [["一。", "二！", "三"], ["v1.0.0 is out.", "Next 2.", "B"], []]


def test_running_starts(spark):
    sizes = F.transform(F.col("n"), lambda n: n.cast("int"))
    df = spark.createDataFrame([(0, [*range(1, 1001)]), (1, []), (2, None), (3, [5])], "i int, n array<int>").orderBy("i")
    assert [r[0] for r in df.select(T.running_starts(sizes)).collect()] == [[n * (n + 1) // 2 for n in range(1000)], [], None, [0]]


def test_chunks(spark):
    column = F.transform(T.chunk_text(F.col("t"), 100, 20, 10), lambda c: F.struct(F.length(c["text"]), c["char_start"], c["char_end"]))
    got = value(spark, column, "a" * 250, "short", "", None)
    assert [tuple(c) for c in got[0]] == [(100, 0, 100), (100, 80, 180), (90, 160, 250), (10, 240, 250)]
    assert [tuple(c) for c in got[1]] == [(5, 0, 5)]
    assert got[2] == [] and got[3] == []
    with pytest.raises(ValueError):
        T.chunk_text(F.col("t"), 10, 10)


def test_names_and_dates(spark):
    assert value(spark, T.guess_category(F.col("t")), "WIKI_a.md", "faq.md", "x") == ["wiki", "faq", "general"]
    assert value(spark, T.safe_name(F.col("t")), " A b/c ", "///") == ["a_bc", "document"]
    assert value(spark, T.year_of(F.col("t")), "18-12-2024", "2024/06/10", "tomorrow", "some year 2023 here", None) == [2024, 2024, None, 2023, None]
    assert value(spark, T.escape_html(F.col("t")), "<a>\n") == ["&lt;a&gt;<br>"]


def test_html(spark):
    got = value(spark, T.article_body(F.col("t")), "x<article><h2>T</h2><p>a&lt;b</p></article>", "none")
    assert got == ["## T\n\na<b", ""]
    div = '<div id="article_content" class="x"><h1>A</h1>one<br/>two<pre><code>x &lt; 1</code></pre></div> <section>no</section>'
    assert value(spark, T.article_body(F.col("t")), div) == ["# A\none\ntwo\n```\n`x < 1`\n```"]
    inline = value(spark, T.strip_html_inline(F.col("t")), "<p>a\n<code>b</code> &amp; <pre>c</pre></p>", None, "")
    assert inline == ["a `b` & ``` c ```", None, ""]


def test_questions(spark):
    got = value(spark, T.question_error(F.col("t")), " ok? ", " ", None, "my.PNG", "data:image/x", "see ![Image](a)", "from Clipboard")
    assert got == [None, "empty", "empty", "image_file", "image_data", "image_data", "pasted_image"]
    assert value(spark, T.names_language(F.col("t")), "用中文回答", "Language: x", "open", "in en please", None) == [True, True, False, True, False]
    assert value(spark, T.safe_name(F.col("t"), 5, "question", True), "Ab C中 dE", "中") == ["ab_c_", "question"]
    assert value(spark, T.plain_title(F.col("t")), "a b/中-c_?", None) == ["a_b中-c_", None]


def test_metadata(spark):
    got = value(spark, M.lenient_json(F.col("t")), '```json\n{"author": "Bob", "year": 2025,}\n```', 'prose "category": "faq" more', "")
    assert (got[0].author, got[0].year) == ("Bob", "2025")
    assert got[1].category == "faq" and got[2].author is None


def test_snippet_and_html_escape(spark):
    df = spark.createDataFrame([(1, "a\nb<c>&'\""), (2, None), (3, ""), (4, "x" * 401)], "id long, text string")
    rows = {r.id: (r.s, r.h) for r in df.select("id", T.snippet(F.col("text")).alias("s"), T.escape_html(F.col("text")).alias("h")).collect()}
    assert rows[1] == ("a b<c>&'\"", "a<br>b&lt;c&gt;&amp;&#x27;&quot;") and rows[2] == (None, None) and rows[3] == ("", "")
    assert rows[4][0] == "x" * 400 + "..."
