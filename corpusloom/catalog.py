"""The registered queries on the given tables and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as T
from corpusloom.operators import answers, keywords, predicates, store, vectors
from corpusloom.plans.pipelines import cascade, chunks, process_documents
from corpusloom.session import load, materialize
from corpusloom.streaming.ingest import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUESTION = "scheduler acceptance test 检索服务"
TOKENS = ["scheduler", "acceptance", "handbook"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


_S = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _sql_entities(x: str) -> str:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&#160;", " "), ("&#39;", "''")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _sql_clean(x: str) -> str:
    x = _sql_entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = rf"regexp_replace({x}, '[\r\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    x = rf"regexp_replace({x}, '[\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')"
    return _sql_strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_sentences(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '([。！？\n!?])\s*', '\1' || chr(57344), 'g'), '\.\s+([A-Z\d])', '.' || chr(57344) || '\1', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(57344)), lambda s: {_sql_strip('s')}), lambda s: s <> '')"


def _sql_paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n\s*\n'), lambda p: {_sql_strip('p')}), lambda p: p <> '')"


def _sql_blocks(parts: str, size: int) -> str:
    return f"""list_transform(list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform({parts}, lambda s: {{'done': []::VARCHAR[], 'open': s}})),
        lambda a, b: CASE WHEN a.open = '' THEN {{'done': a.done, 'open': b.open}} WHEN length(a.open) + 1 + length(b.open) <= {size} THEN {{'done': a.done, 'open': a.open || ' ' || b.open}}
        ELSE {{'done': list_append(a.done, a.open), 'open': b.open}} END), lambda x: x)"""


@query(f"SELECT doc_id, {_sql_clean('text')} AS text FROM documents")
def clean_documents(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(f"SELECT article_id, {_sql_clean('description')} AS description FROM articles")
def clean_descriptions(spark, d):
    return load(spark, d, "articles").select("article_id", T.clean_text(F.col("description")).alias("description"))


@query(f"SELECT question_id, tag, {_sql_strip('regexp_replace(' + _sql_entities('body') + ', ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS body FROM questions")
def strip_question_html(spark, d):
    return load(spark, d, "questions").select("question_id", "tag", T.strip_html(F.col("body")).alias("body"))


@query(f"SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM (SELECT doc_id, {_sql_sentences(_sql_clean('text'))} AS s FROM documents)")
def sentence_split(spark, d):
    parts = F.posexplode(T.split_sentences(T.clean_text(F.col("text")))).alias("place", "sentence")
    return load(spark, d, "documents").select("doc_id", parts).select("doc_id", F.col("place").cast("long").alias("place"), "sentence")


@query(f"SELECT doc_id, unnest(range(len(p))) AS place, unnest(p) AS paragraph FROM (SELECT doc_id, {_sql_paragraphs(_sql_clean('text'))} AS p FROM documents)")
def paragraph_split(spark, d):
    parts = F.posexplode(T.paragraphs(T.clean_text(F.col("text")))).alias("place", "paragraph")
    return load(spark, d, "documents").select("doc_id", parts).select("doc_id", F.col("place").cast("long").alias("place"), "paragraph")


@query(
    f"""WITH paras AS (SELECT doc_id, unnest(range(len(p))) AS pi, unnest(p) AS para FROM (SELECT doc_id, {_sql_paragraphs(_sql_clean('text'))} AS p FROM documents)),
    folded AS (SELECT doc_id, pi, {_sql_blocks(_sql_sentences('para'), 700)} AS st FROM (SELECT *, 1 FROM paras)),
    blocks AS (SELECT doc_id, pi, unnest(range(len(b))) AS bi, unnest(b) AS block FROM (SELECT doc_id, pi, list_append(st.done, st.open) AS b FROM folded)),
    placed AS (SELECT doc_id, block, coalesce(sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY pi, bi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pi, bi) AS n FROM blocks),
    cut AS (SELECT doc_id, n, block AS text, pos AS char_start, pos + length(block) AS char_end FROM placed WHERE length(block) <= 700
      UNION ALL SELECT doc_id, n, {_sql_strip('substring(block, s + 1, 700)')}, pos + s, pos + least(s + 700, length(block)) FROM (SELECT *, unnest(range(0, length(block), 580)) AS s FROM placed WHERE length(block) > 700)),
    kept AS (SELECT * FROM cut WHERE length(text) >= 40),
    every AS (SELECT doc_id, text, char_start, char_end FROM kept
      UNION ALL SELECT doc_id, t, 0, length(t) FROM (SELECT doc_id, {_sql_clean('text')} AS t FROM documents) WHERE t <> '' AND doc_id NOT IN (SELECT doc_id FROM kept))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS chunk_id, text, char_start, char_end FROM every""".replace("list_transform(list_reduce", "(list_reduce").replace(" END), lambda x: x)", " END))")
)
def chunk_documents(spark, d):
    return chunks(load(spark, d, "documents"), "doc_id").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", *_long("char_start", "char_end"))


_SQL_GUESS = "CASE " + " ".join(f"WHEN starts_with(lower(name), '{p}') THEN '{c}'" for p, c in (("wiki_", "wiki"), ("notice", "notice"), ("faq", "faq"), ("case_study", "case_study"), ("report", "report"), ("term_", "term"))) + " ELSE 'general' END"


@query(
    f"""SELECT category, count(*) AS documents FROM (SELECT {_SQL_GUESS} AS category FROM (SELECT regexp_extract(path, '([^/]+)$', 1) AS name FROM documents)) GROUP BY category"""
)
def guess_category(spark, d):
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return load(spark, d, "documents").select(T.guess_category(name).alias("category")).groupBy("category").agg(F.count("*").alias("documents"))


@query("SELECT article_id, string_split(url, '?')[1] AS url, regexp_extract(url, '/article/details/(\\d+)', 1) AS detail_id FROM articles")
def url_normalise(spark, d):
    return load(spark, d, "articles").select("article_id", T.plain_url(F.col("url")).alias("url"), F.regexp_extract("url", r"/article/details/(\d+)", 1).alias("detail_id"))


_BODY = f"regexp_replace(lower(coalesce(text, '')), '{_S}+', '', 'g')"


def _sql_count(target: str, term: str) -> str:
    if term.isascii():
        return f"len(list_filter(regexp_extract_all({target}, '[a-z0-9_+-]+'), lambda t: t = '{term}'))"
    return f"((length({target}) - length(replace({target}, '{term}', ''))) // {len(term)})"


def _sql_keyword(question: str) -> str:
    inner = [f"CASE WHEN contains(body, '{question.lower().replace(' ', '')}') THEN {4.0 * len(question.replace(' ', ''))} ELSE 0 END"]
    outer = ["0"]
    for term in ("scheduler", "acceptance", "test", "检索服务", "检索服", "索服务", "检索", "索服", "服务"):
        weight = max(len(term), 2)
        inner.append(f"least({_sql_count('low' if term.isascii() else 'body', term)}, 4) * {float(weight)}")
        outer.append(f"CASE WHEN {_sql_count('name', term)} > 0 THEN {weight * 0.5} ELSE 0 END")
    return f"""SELECT doc_id, source, raw_score, round(1 / (1 + raw_score), 4) AS score FROM (
      SELECT doc_id, source, (CASE WHEN inner_score > 0 THEN inner_score + outer_score ELSE 0 END)::DOUBLE AS raw_score FROM (
        SELECT doc_id, source, ({" + ".join(inner)}) AS inner_score, ({" + ".join(outer)}) AS outer_score
        FROM (SELECT doc_id, source, {_BODY} AS body, lower(coalesce(text, '')) AS low, lower(coalesce(source, '')) AS name FROM documents))) WHERE raw_score > 0
      ORDER BY raw_score DESC, source NULLS FIRST, doc_id LIMIT 20"""


@query(_sql_keyword(QUESTION))
def keyword_topk(spark, d):
    hits = keywords.keyword_search(load(spark, d, "documents"), QUESTION, 20, id_col="doc_id")
    return hits.select("doc_id", "source", "raw_score", keywords.rank_score(F.col("raw_score")).alias("score"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_+-]+'), lambda t: t = 'scheduler'))::BIGINT AS ascii_hits, ((length(text) - length(replace(text, '数据', ''))) // 2)::BIGINT AS cjk_hits FROM documents")
def term_frequency(spark, d):
    return load(spark, d, "documents").select("doc_id", keywords.occurrences(F.lower("text"), "scheduler").cast("long").alias("ascii_hits"), keywords.occurrences(F.col("text"), "数据").cast("long").alias("cjk_hits"))


@query(
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS tokens FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(tokens) AS length, "
    + ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf_{i}" for i, t in enumerate(TOKENS))
    + " FROM t), s AS (SELECT count(*) AS n, avg(length) AS mean, "
    + ", ".join(f"count(*) FILTER (tf_{i} > 0) AS df_{i}" for i in range(len(TOKENS)))
    + " FROM c) SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, "
    + " + ".join(f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(TOKENS)))
    + " AS score FROM c, s) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"
)
def bm25_topk(spark, d):
    return keywords.bm25(load(spark, d, "documents"), "doc_id", "text", TOKENS, 50).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT token, count(*) AS documents, sum(tf)::BIGINT AS hits FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents) GROUP BY doc_id, token) GROUP BY token")
def posting_totals(spark, d):
    return keywords.postings(load(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("hits"))


_QUERY_VECTOR = [((i * 37) % 19 - 9) / 20 for i in range(64)]
_SQL_VECTOR = "[" + ", ".join(map(str, _QUERY_VECTOR)) + "]::DOUBLE[]"
_SQL_NEAR = f"SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], {_SQL_VECTOR}) AS distance FROM embeddings"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round(distance, 6) AS distance FROM ({_SQL_NEAR}) ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark, d):
    return _shown(vectors.nearest(load(spark, d, "embeddings"), _QUERY_VECTOR, 10))


@query(f"SELECT vec_id, label, round(distance, 6) AS distance FROM ({_SQL_NEAR}) WHERE label = 3 OR label IN (1, 2) ORDER BY distance, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    rows = predicates.filtered(load(spark, d, "embeddings"), {"$or": [{"label": 3}, {"label": {"$in": [1, 2]}}]})
    return _shown(vectors.nearest(rows, _QUERY_VECTOR, 10))


@query(f"SELECT vec_id, label, round(distance, 6) AS distance FROM ({_SQL_NEAR}) WHERE distance <= 0.9 ORDER BY distance, vec_id LIMIT 25")
def vector_max_distance(spark, d):
    return _shown(vectors.nearest(load(spark, d, "embeddings"), _QUERY_VECTOR, 25, max_distance=0.9))


@query(
    f"""WITH n AS (SELECT *, 'group ' || (vec_id // 2) AS text FROM ({_SQL_NEAR})),
    b AS (SELECT *, 0 AS route FROM (SELECT * FROM n WHERE label < 3 ORDER BY distance, vec_id LIMIT 10) UNION ALL SELECT *, 1 FROM (SELECT * FROM n ORDER BY distance, vec_id LIMIT 10))
    SELECT vec_id, label, round(distance, 6) AS distance, route::BIGINT AS route FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY text ORDER BY route, distance, vec_id) = 1) ORDER BY distance, vec_id LIMIT 10"""
)
def dual_route_topk(spark, d):
    rows = load(spark, d, "embeddings").withColumn("text", F.concat(F.lit("group "), F.floor(F.col("vec_id") / 2).cast("string")))
    hits = vectors.two_routes(rows, _QUERY_VECTOR, 10, F.col("label") < 3)
    return hits.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.col("route").cast("long").alias("route"))


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first_by_text(spark, d):
    return load(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 500")
def source_list(spark, d):
    return load(spark, d, "documents").where("source is not null").select("source").distinct().orderBy("source").limit(500)


@query("SELECT count(*) AS total, count(DISTINCT source) AS source_count FROM documents")
def corpus_stats(spark, d):
    return store.corpus_stats(load(spark, d, "documents"), "source")


@query("SELECT source, category, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, category)")
def corpus_rollup(spark, d):
    return load(spark, d, "documents").rollup("source", "category").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT question_id, title, score::BIGINT AS score FROM questions WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY fetched_at DESC, tag DESC, score DESC, title DESC) = 1")
def upsert_last_wins(spark, d):
    rows = load(spark, d, "questions").select("question_id", "title", "score", "fetched_at", "tag")
    return store.last_wins(rows, "question_id", "fetched_at", "tag", "score", "title").select("question_id", "title", F.col("score").cast("long").alias("score"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM sentence_sample s WHERE s.doc_id = d.doc_id)")
def new_docs_anti(spark, d):
    return store.only_new(load(spark, d, "documents"), load(spark, d, "sentence_sample"), "doc_id").select("doc_id", "source")


@query("SELECT tag, question_id, score::BIGINT AS score, row_number() OVER (PARTITION BY tag ORDER BY score DESC, question_id) AS place FROM questions WHERE answer_count >= 1 AND score >= 3 QUALIFY place <= 10")
def top_questions_per_tag(spark, d):
    rows = load(spark, d, "questions").where("answer_count >= 1 and score >= 3")
    return store.top_per_group(rows, "tag", 10, F.desc("score"), "question_id").select("tag", "question_id", *_long("score", "place"))


@query("SELECT author, doc_id, created_at, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, doc_id DESC, content DESC) AS place FROM (SELECT DISTINCT author, doc_id, created_at, content FROM tickets WHERE author IS NOT NULL AND created_at IS NOT NULL AND doc_id IS NOT NULL AND content IS NOT NULL) QUALIFY place <= 10")
def history_last_n(spark, d):
    rows = load(spark, d, "tickets").select("author", "doc_id", "created_at", "content").where("author is not null and created_at is not null and doc_id is not null and content is not null").distinct()
    return store.top_per_group(rows, "author", 10, F.desc("created_at"), F.desc("doc_id"), F.desc("content")).select("author", "doc_id", "created_at", *_long("place"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5),
    j AS (SELECT category, string_agg('[source: ' || coalesce(source, 'unknown') || coalesce(' (' || metadata.year || ')', '') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS c FROM r GROUP BY category)
    SELECT category, CASE WHEN length(c) > 8000 THEN substring(c, 1, 8000) || '...' ELSE c END AS context FROM j"""
)
def context_assembly(spark, d):
    rows = load(spark, d, "documents").withColumn("year", F.col("metadata.year"))
    best = store.top_per_group(rows, "category", 5, F.desc("n_chars"), "doc_id")
    return answers.context(best, "category", "place", "text", "source", "year")


@query("SELECT category, string_agg('- ' || s, chr(10) ORDER BY s) AS citations FROM (SELECT DISTINCT category, coalesce(source, 'unknown') AS s FROM documents) GROUP BY category")
def citation_list(spark, d):
    return load(spark, d, "documents").select("category", "source").distinct().groupBy("category").agg(answers.citations(F.col("source")).alias("citations"))


@query("SELECT event_type, count(*) AS events, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def event_props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    return hourly(load(spark, d, "events"), "ts", "value", "event_type").select("hour", "event_type", "events", F.round("total", 4).alias("total"))


@query(
    r"""SELECT year, count(*) AS documents FROM (SELECT coalesce(
    year(coalesce(try_strptime(trim(created_at), '%Y-%m-%d'), try_strptime(trim(created_at), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(created_at), '%Y/%m/%d'), try_strptime(trim(created_at), '%d-%m-%Y'))),
    TRY_CAST(nullif(regexp_extract(created_at, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS BIGINT)) AS year FROM documents) GROUP BY year"""
)
def year_from_date(spark, d):
    rows = load(spark, d, "documents").select(T.year_of(F.col("created_at")).cast("long").alias("year"))
    return rows.groupBy("year").agg(F.count("*").alias("documents"))


@query(
    """SELECT e.category, count(*) AS cases, count(*) FILTER (hit) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS recall FROM (
    SELECT category, EXISTS (SELECT 1 FROM (SELECT DISTINCT category AS s FROM documents UNION SELECT DISTINCT source FROM documents) x WHERE len(list_filter(expected_source_hint, lambda h: contains(lower(x.s), lower(h)))) > 0) AS hit FROM eval_cases) e GROUP BY e.category"""
)
def eval_recall(spark, d):
    documents = load(spark, d, "documents")
    names = documents.select(F.explode(F.array("category", "source")).alias("s"))
    cases = answers.hint_hits(load(spark, d, "eval_cases"), "expected_source_hint", names, "s")
    return cases.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"))


@query("SELECT event_type, round(avg(value), 4) AS mean_value, CASE WHEN avg(value) > median(value) THEN 'mean' ELSE 'median' END AS larger FROM events GROUP BY event_type")
def latency_summary(spark, d):
    found = store.exact_median(load(spark, d, "events"), "event_type", "value")
    return found.select("event_type", F.round("mean", 4).alias("mean_value"), F.when(F.col("mean") > F.col("median"), "mean").otherwise("median").alias("larger"))


@query("SELECT doc_type, coalesce(nullif(category, ''), CASE WHEN doc_type IN ('ticket', 'error_log', 'slack', 'manual') THEN doc_type END, 'general') AS category, count(*) AS records FROM tickets GROUP BY 1, 2")
def record_metadata(spark, d):
    rows = load(spark, d, "tickets").select("doc_type", M.record_category(F.col("category"), F.col("doc_type")).alias("category"))
    return rows.groupBy("doc_type", "category").agg(F.count("*").alias("records"))


@query(f"SELECT doc_id, title, regexp_replace({_sql_strip('title')}, '\\s+', '_', 'g') AS name, length(content) AS chars FROM tickets WHERE {_sql_strip('content')} <> '' AND title IS NOT NULL".replace("regexp_replace(" + _sql_strip("title") + ", '\\s+', '_', 'g')", f"coalesce(nullif(substring(regexp_replace(regexp_replace(lower({_sql_strip('title')}), '{_S}+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), 1, 80), ''), 'document')"))
def record_names(spark, d):
    rows = load(spark, d, "tickets").where((T.strip(F.col("content")) != "") & F.col("title").isNotNull())
    return rows.select("doc_id", "title", T.safe_name(F.col("title")).alias("name"), F.length("content").cast("long").alias("chars"))


@query("SELECT doc_id, row_number() OVER (ORDER BY path, doc_id) - 1 AS doc_idx FROM documents")
def document_ordinal(spark, d):
    return store.with_ordinal(load(spark, d, "documents").select("doc_id", "path"), "path", "doc_id").select("doc_id", *_long("doc_idx"))


@query("SELECT source, count(*) AS documents, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS longest FROM documents WHERE (category = 'faq' OR category = 'wiki') AND contains(text, '2024') GROUP BY source")
def filtered_profile(spark, d):
    rows = predicates.filtered(load(spark, d, "documents"), {"$or": [{"category": "faq"}, {"category": "wiki"}]}, contains="2024")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("longest"))


@query("SELECT o_orderpriority, count(*) AS orders, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderpriority")
def order_profile(spark, d):
    orders = load(spark, d, "orders").where("o_orderdate >= timestamp '1995-01-01'").select("o_orderkey", "o_orderpriority")
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.sum("n").alias("orders"), F.round(F.sum("q"), 2).alias("quantity"))


@query("SELECT article_id, CASE WHEN length(description) > 400 THEN replace(substring(description, 1, 400), chr(10), ' ') || '...' ELSE replace(description, chr(10), ' ') END AS snippet FROM articles")
def snippets(spark, d):
    return load(spark, d, "articles").select("article_id", T.snippet(F.col("description")).alias("snippet"))


@query(
    """SELECT question_id, tag, replace(replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS html FROM questions"""
)
def html_escape(spark, d):
    return load(spark, d, "questions").select("question_id", "tag", T.escape_html(F.col("title")).alias("html"))


@query(
    """SELECT doc_id, coalesce(nullif(author, ''), metadata.author) AS author, coalesce(nullif(category, ''), metadata.category) AS category,
    metadata.year::BIGINT AS year, coalesce(nullif(lang, ''), metadata.language) AS language, metadata.summary AS summary FROM documents"""
)
def merge_metadata(spark, d):
    model = {k: F.col(f"metadata.{k}") for k in ("author", "year", "category", "language", "summary")}
    merged = M.merge({"author": F.col("author"), "category": F.col("category"), "language": F.col("lang")}, model)
    return load(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in merged.items())).withColumn("year", F.col("year").cast("long"))


@query("SELECT tag, question_id, score::BIGINT AS score FROM (SELECT DISTINCT unnest(tags) AS tag, question_id, score FROM questions) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, question_id DESC) = 1")
def best_question_per_tag(spark, d):
    rows = load(spark, d, "questions").select(F.explode("tags").alias("tag"), "question_id", "score")
    best = rows.groupBy("tag").agg(F.max(F.struct("score", "question_id")).alias("b"))
    return best.select("tag", "b.question_id", F.col("b.score").cast("long").alias("score"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def all_sources(spark, d):
    return load(spark, d, "documents").where("source is not null").select("source").distinct()


@query("SELECT count(*) AS total, count(DISTINCT source) AS source_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, coalesce(max(doc_id), 0)::BIGINT AS largest_id FROM documents")
def store_summary(spark, d):
    """Totals, the sources (a few names: they are the result) and the largest id."""
    rows = load(spark, d, "documents")
    names = rows.where("source is not null").select("source").distinct().agg(F.count("*").alias("source_count"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("largest_id")).join(F.broadcast(names))


@query("SELECT source, count(*) OVER () AS matched FROM (SELECT DISTINCT source FROM documents WHERE contains(lower(source), 'wiki')) ORDER BY source LIMIT 80")
def sources_like(spark, d):
    found = load(spark, d, "documents").where(F.lower("source").contains("wiki")).select("source").distinct()
    return found.join(F.broadcast(found.agg(F.count("*").alias("matched")))).orderBy("source").limit(80)


@query(r"SELECT item_id, regexp_matches(lower(question), '中文|英文|英语|汉语|语言\s*(为|是|=)|language\s*[:=]|\bzh\b|\ben\b') AS names_language FROM eval_cases")
def language_gate(spark, d):
    return load(spark, d, "eval_cases").select("item_id", T.names_language(F.col("question")).alias("names_language"))


@query(
    f"""SELECT question_id, tag, fetched_at, CASE WHEN coalesce(q, '') = '' THEN 'empty' WHEN regexp_matches(lower(q), '[.](png|jpg|jpeg|gif|bmp|webp|svg|tiff)$') THEN 'image_file'
    WHEN starts_with(q, 'data:image') OR contains(lower(q), '![image]') THEN 'image_data' WHEN regexp_matches(lower(q), 'image[.]png|image[.]jpg|clipboard') THEN 'pasted_image' END AS error
    FROM (SELECT *, {_sql_strip('body')} AS q FROM questions)"""
)
def question_errors(spark, d):
    return load(spark, d, "questions").select("question_id", "tag", "fetched_at", T.question_error(F.col("body")).alias("error"))


@query("SELECT category, count(*) AS documents, max(n_chars) AS longest FROM documents WHERE metadata.year = 2024 AND metadata.language = 'zh' GROUP BY category")
def coerced_filters(spark, d):
    """A request's filters as they arrive: the year as text, one empty, one that is no year."""
    where = predicates.coerced({"year": "2024", "author": "", "language": "zh"}) | predicates.coerced({"year": "soon"})
    rows = predicates.filtered(load(spark, d, "documents").select("category", "n_chars", "metadata.year", "metadata.language"), where)
    return rows.groupBy("category").agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest"))


@query("SELECT count(*) AS documents, true AS fell_back FROM documents")
def filter_fallback(spark, d):
    rows = predicates.filtered(load(spark, d, "documents"), {"no_such_column": 1}, contains="x", flag="fell_back")
    return rows.groupBy("fell_back").agg(F.count("*").alias("documents"))


@query(f"SELECT vec_id, round(greatest(0, 1 - distance / 2) * 100, 4) AS similarity FROM ({_SQL_NEAR}) WHERE distance IS NOT NULL")
def vector_similarity(spark, d):
    rows = load(spark, d, "embeddings").withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, _QUERY_VECTOR))))
    return rows.where("distance is not null").select("vec_id", F.round(vectors.similarity(F.col("distance")), 4).alias("similarity"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_distance(e, embedding::DOUBLE[]), 9) AS distance FROM q, embeddings)
    SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s WHERE distance IS NOT NULL QUALIFY rank <= 10"""
)
def vector_topk_many(spark, d):
    """The ten nearest of every hundredth vector, against all rows."""
    rows = load(spark, d, "embeddings")
    hits = vectors.nearest_many(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, dim=64)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS tokens FROM documents), p AS (SELECT id, token, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(tokens) AS length, unnest(tokens) AS token FROM t) GROUP BY id, token),
    s AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t WHERE len(tokens) > 0), a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_]{2,}')) AS token FROM eval_cases),
    f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
    r AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM a JOIN f USING (token) JOIN p USING (token), s GROUP BY query_id, id)
    SELECT query_id AS item_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 5"""
)
def questions_bm25(spark, d):
    """The five best documents of every evaluation question, on the inverted index."""
    index = materialize(keywords.postings(load(spark, d, "documents"), "doc_id", "text"), "postings")
    hits = keywords.search_many(index, load(spark, d, "eval_cases"), "item_id", "question", 5)
    return hits.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_TOPIC, _GUIDANCE = ["索引", "cache"], ["检查", "先", "check"]


@query(
    """SELECT doc_id, CASE WHEN list_has_any(tokens, ['scheduler', 'acceptance', 'test']) THEN 0
    WHEN contains(low, '检索服务') OR contains(low, '检索服') OR contains(low, '索服务') OR contains(low, '检索') OR contains(low, '服务') OR contains(low, '索服') OR contains(low, 'scheduler') OR contains(low, 'acceptance') OR contains(low, 'test') THEN 1 ELSE 2 END::BIGINT AS route
    FROM (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS tokens FROM documents WHERE text IS NOT NULL)
    WHERE list_has_any(tokens, ['scheduler', 'acceptance', 'test']) OR regexp_matches(low, '检索|服务|索服|scheduler|acceptance|test') OR (regexp_matches(low, '索引|cache') AND regexp_matches(low, '检查|先|check'))"""
)
def candidate_routes(spark, d):
    found = keywords.candidates(load(spark, d, "documents"), QUESTION, id_col="doc_id", topic=_TOPIC, guidance=_GUIDANCE)
    return found.select(F.col("id").alias("doc_id"), F.col("route").cast("long").alias("route"))


_TOPICS = [(["scheduler", "调度"], {"重启": 30.0, "backoff": 80.0}), (["quota"], {"limit": 100.0})]


@query(
    f"""SELECT doc_id, 4 * 9 * CASE WHEN contains(body, 'scheduler') THEN 1 ELSE 0 END + least({_sql_count('low', 'scheduler')}, 4) * 9 + CASE WHEN contains(body, '重启') THEN 30 ELSE 0 END + CASE WHEN contains(body, 'backoff') THEN 80 ELSE 0 END
    + CASE WHEN {_sql_count('name', 'scheduler')} > 0 THEN 4.5 ELSE 0 END AS raw_score
    FROM (SELECT doc_id, {_BODY} AS body, lower(coalesce(text, '')) AS low, lower(coalesce(source, '')) AS name FROM documents)
    WHERE contains(body, 'scheduler') OR {_sql_count('low', 'scheduler')} > 0 OR contains(body, '重启') OR contains(body, 'backoff')"""
)
def topic_scores(spark, d):
    """Every document's score with the bonuses of the topics that the query shows."""
    rows = keywords.staged(load(spark, d, "documents"), "text", "source").select("doc_id", keywords.keyword_score("scheduler", ["scheduler"], _TOPICS).alias("raw_score"))
    return rows.where("raw_score > 0")


@query(
    """WITH v AS (SELECT 1 AS query_id, vec_id AS id, distance AS score FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], """
    + _SQL_VECTOR
    + """) AS distance FROM embeddings) WHERE distance <= 0.9),
    k AS (SELECT x.query_id, doc_id AS id, round(1 / (1 + (length(text) - length(replace(text, '数据', ''))) // 2), 4) AS score FROM documents, (VALUES (1), (2)) x(query_id) WHERE contains(text, '数据'))
    SELECT query_id::BIGINT AS query_id, id, round(score, 6) AS score, route::BIGINT AS route, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS place FROM (
      SELECT *, 0 AS route FROM v UNION ALL SELECT *, 1 FROM k WHERE query_id NOT IN (SELECT query_id FROM v)) QUALIFY place <= 10"""
)
def cascade_topk(spark, d):
    """Two questions: the first has vector hits, the second falls back to keywords."""
    near = load(spark, d, "embeddings").withColumn("score", vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, _QUERY_VECTOR)))).where("score <= 0.9")
    first = near.select(F.lit(1).cast("long").alias("query_id"), F.col("vec_id").alias("id"), "score")
    counted = load(spark, d, "documents").where(F.col("text").contains("数据")).select("doc_id", keywords.rank_score(keywords.occurrences(F.col("text"), "数据")).alias("score"))
    second = counted.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("query_id"), F.col("doc_id").alias("id"), "score")
    hits = cascade([first, second], "query_id", "id", 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), *_long("route", "place"))


@query(
    f"""WITH n AS (SELECT *, 'group ' || (vec_id // 2) AS text FROM ({_SQL_NEAR})),
    b AS (SELECT *, 0 AS route FROM (SELECT * FROM n WHERE label < 3 ORDER BY distance, vec_id LIMIT 10) UNION ALL SELECT *, 1 FROM (SELECT * FROM n ORDER BY distance, vec_id LIMIT 10)),
    h AS (SELECT * FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY text ORDER BY route, distance, vec_id) = 1) ORDER BY distance, vec_id LIMIT 10)
    SELECT count(*) AS hits, CASE WHEN count(DISTINCT route) = 0 THEN 'none' WHEN count(DISTINCT route) > 1 THEN 'mixed' WHEN max(route) = 0 THEN 'preferred' ELSE 'all' END AS label FROM h"""
)
def retrieval_label(spark, d):
    """By which routes the merged hits came: a summary of at most ten rows."""
    rows = load(spark, d, "embeddings").withColumn("text", F.concat(F.lit("group "), F.floor(F.col("vec_id") / 2).cast("string")))
    hits = vectors.two_routes(rows, _QUERY_VECTOR, 10, F.col("label") < 3)
    names = F.collect_set(F.when(F.col("route") == 0, "preferred").otherwise("all"))
    return hits.agg(F.count("*").alias("hits"), answers.route_label(names).alias("label"))


@query(
    """SELECT q.question_id, q.tag, a.title AS answer, a.view_num::BIGINT AS views FROM (SELECT DISTINCT question_id, tag FROM questions) q LEFT JOIN
    (SELECT * FROM articles WHERE description IS NOT NULL QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY view_num DESC, article_id DESC, title DESC) = 1) a ON q.tag = a.keyword"""
)
def question_best_article(spark, d):
    """Every question with the most viewed article of its tag, or none."""
    best = load(spark, d, "articles").where("description is not null").groupBy("keyword").agg(F.max(F.struct("view_num", "article_id", "title")).alias("b"))
    asked = load(spark, d, "questions").select("question_id", "tag").distinct()
    return asked.join(best, asked["tag"] == best["keyword"], "left").select("question_id", "tag", F.col("b.title").alias("answer"), F.col("b.view_num").cast("long").alias("views"))


@query("SELECT keyword, article_id, view_num::BIGINT AS view_num, place FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY view_num DESC, article_id, fetched_at) AS place FROM articles WHERE length(description) >= 50) WHERE place <= 8")
def articles_per_keyword(spark, d):
    rows = load(spark, d, "articles").where(F.length("description") >= 50)
    return store.top_per_group(rows, "keyword", 8, F.desc("view_num"), "article_id", "fetched_at").select("keyword", "article_id", *_long("view_num", "place"))


@query("SELECT path, doc_id, lang FROM documents WHERE lang IN ('zh', 'en') QUALIFY row_number() OVER (PARTITION BY path ORDER BY CASE lang WHEN 'zh' THEN 0 ELSE 1 END, doc_id) = 1")
def language_fallback(spark, d):
    """For every path its first Chinese document, else its first English one."""
    rows = load(spark, d, "documents").where(F.col("lang").isin("zh", "en")).select("path", "doc_id", "lang")
    return store.first_found(rows, "path", F.when(F.col("lang") == "zh", 0).otherwise(1), "doc_id")


@query(
    f"""SELECT question_id, tag, {_sql_strip("regexp_replace(regexp_replace(replace(replace(regexp_replace(" + _sql_entities('body') + ", '</?pre>', ' ``` ', 'g'), '<code>', '`'), '</code>', '`'), '<[^>]+>', ' ', 'g'), '" + _S + "+', ' ', 'g')")} AS body FROM questions"""
)
def strip_html_keep_code(spark, d):
    return load(spark, d, "questions").select("question_id", "tag", T.strip_html_inline(F.col("body")).alias("body"))


@query(
    f"""SELECT question_id, tag, coalesce(nullif(substring(regexp_replace(n, '[^a-z0-9_-]', '', 'g'), 1, 60), ''), 'question') AS question_name, coalesce(nullif(substring(regexp_replace(n, '[^a-z0-9_-]', '', 'g'), 1, 50), ''), 'article') AS article_name,
    replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' ', '_') AS plain FROM (SELECT *, regexp_replace(lower({_sql_strip('title')}), '{_S}+', '_', 'g') AS n FROM questions WHERE title IS NOT NULL)"""
)
def question_names(spark, d):
    title = F.col("title")
    return load(spark, d, "questions").where("title is not null").select(
        "question_id", "tag", T.safe_name(title, 60, "question", True).alias("question_name"), T.safe_name(title, 50, "article", True).alias("article_name"), T.plain_title(title).alias("plain")
    )


_SQL_ROWS = """SELECT 'document' AS origin, doc_id::VARCHAR AS key, regexp_extract(path, '([^/]+)$', 1) AS name, NULL AS doc_type, false AS record, author AS fa, category AS fc, lang AS fl, author IS NOT NULL OR category IS NOT NULL OR lang IS NOT NULL AS has_front,
      metadata.author AS ma, metadata.year AS my, metadata.category AS mc, metadata.language AS ml, metadata.summary AS ms, NULL AS ra, NULL AS ry, NULL AS rc FROM documents
    UNION ALL SELECT 'ticket', doc_id, 'ticket_' || coalesce(doc_id, ''), doc_type, coalesce(doc_type, '') <> '' OR coalesce(created_at, '') <> '', NULL, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, author, TRY_CAST(nullif(substring(created_at, 1, 4), '') AS INT), category FROM tickets"""
_SQL_OWN = "coalesce(nullif(rc, ''), CASE WHEN doc_type IN ('ticket', 'error_log', 'slack', 'manual') THEN doc_type END, 'general')"


def _processed(author: str, year: str, category: str, language: str, summary: str) -> str:
    return f"SELECT origin, key, {author} AS author, nullif({year}, 0)::BIGINT AS year, coalesce({category}, {_SQL_GUESS}) AS category, coalesce({language}, 'zh') AS language, coalesce({summary}, '') AS summary FROM ({_SQL_ROWS})"


def _origins(spark: SparkSession, d: str) -> DataFrame:
    """Documents with front matter and model metadata, and ticket records, as one union."""
    fields = ("author", "year", "category", "language", "summary")
    struct = lambda **k: F.struct(*(k.get(f, F.lit(None)).cast("string").alias(f) for f in fields))
    docs, tickets = load(spark, d, "documents"), load(spark, d, "tickets")
    absent = F.when(F.lit(False), struct())
    front = F.when(F.col("author").isNotNull() | F.col("category").isNotNull() | F.col("lang").isNotNull(), struct(author=F.col("author"), category=F.col("category"), language=F.col("lang")))
    left = docs.select(
        F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("key"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("created_at"),
        front.alias("front"), absent.alias("record"), struct(**{f: F.col(f"metadata.{f}") for f in fields}).alias("model"),
    )
    record = struct(author=F.col("author"), year=F.substring("created_at", 1, 4), category=F.col("category"))
    right = tickets.select(F.lit("ticket").alias("origin"), F.col("doc_id").alias("key"), F.concat(F.lit("ticket_"), F.coalesce("doc_id", F.lit(""))).alias("name"), "doc_type", "created_at", absent.alias("front"), record.alias("record"), absent.alias("model"))
    return left.unionByName(right)


def _with_long_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.col("year").cast("long"))


@query(_processed("CASE WHEN record THEN nullif(ra, '') ELSE coalesce(nullif(fa, ''), nullif(ma, '')) END", "CASE WHEN record THEN ry ELSE my END", f"CASE WHEN record THEN {_SQL_OWN} ELSE coalesce(nullif(fc, ''), nullif(mc, '')) END", "CASE WHEN NOT record THEN coalesce(nullif(fl, ''), nullif(ml, '')) END", "CASE WHEN NOT record THEN nullif(ms, '') END"))
def process_merge(spark, d):
    return _with_long_year(process_documents(_origins(spark, d), "merge"))


@query(_processed("nullif(ma, '')", "my", "nullif(mc, '')", "nullif(ml, '')", "nullif(ms, '')"))
def process_model_only(spark, d):
    return _with_long_year(process_documents(_origins(spark, d), "model_only"))


@query(_processed("CASE WHEN has_front THEN nullif(fa, '') WHEN record THEN nullif(ra, '') END", "CASE WHEN record AND NOT has_front THEN ry END", f"CASE WHEN has_front THEN coalesce(fc, 'general') WHEN record THEN {_SQL_OWN} END", "CASE WHEN has_front THEN nullif(fl, '') END", "NULL"))
def process_record_only(spark, d):
    return _with_long_year(process_documents(_origins(spark, d), "record_only"))


@query(
    """WITH e AS (SELECT e.*, e.category = 'out_of_scope' OR len(expected_source_hint) = 0 AS outside, EXISTS (SELECT 1 FROM (SELECT DISTINCT category AS s FROM documents UNION SELECT DISTINCT source FROM documents) x WHERE len(list_filter(expected_source_hint, lambda h: contains(lower(x.s), lower(h)))) > 0) AS hit FROM eval_cases e)
    SELECT count(*) AS total_queries, count(*) FILTER (NOT outside) AS in_scope, count(*) FILTER (outside) AS out_of_scope, count(*) FILTER (hit AND NOT outside) AS hits,
    round(coalesce(count(*) FILTER (hit AND NOT outside) / nullif(count(*) FILTER (NOT outside), 0), 0), 4) AS recall, count(*) FILTER (hit AND outside) AS answered_outside,
    round(coalesce(count(*) FILTER (outside AND NOT hit) / nullif(count(*) FILTER (outside), 0), 0), 4) AS outside_accuracy FROM e"""
)
def eval_summary(spark, d):
    """One row over all cases; a case without hints is out of scope, and answering it is a fault."""
    names = load(spark, d, "documents").select(F.explode(F.array("category", "source")).alias("s"))
    cases = answers.hint_hits(load(spark, d, "eval_cases"), "expected_source_hint", names, "s")
    cases = cases.withColumn("outside", F.coalesce((F.col("category") == "out_of_scope") | (F.size("expected_source_hint") == 0), F.lit(False)))
    counts = cases.agg(
        F.count("*").alias("total_queries"), F.count_if(~F.col("outside")).alias("in_scope"), F.count_if("outside").alias("out_of_scope"),
        F.count_if(F.col("hit") & ~F.col("outside")).alias("hits"), F.count_if(F.col("hit") & F.col("outside")).alias("answered_outside"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return counts.withColumns({"recall": share(F.col("hits"), F.col("in_scope")), "outside_accuracy": share(F.col("out_of_scope") - F.col("answered_outside"), F.col("out_of_scope"))})


@query("SELECT tag, string_agg(DISTINCT t, ',' ORDER BY t) AS together FROM (SELECT tag, unnest(tags) AS t FROM questions) GROUP BY tag")
def tag_sets(spark, d):
    rows = load(spark, d, "questions").select("tag", F.explode("tags").alias("t")).distinct()
    return rows.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("together"))


@query("SELECT author, doc_id, created_at, place FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, doc_id DESC, content DESC) AS place FROM (SELECT DISTINCT author, doc_id, created_at, content, title FROM tickets WHERE author IS NOT NULL AND created_at IS NOT NULL AND doc_id IS NOT NULL AND content IS NOT NULL AND title IS NOT NULL)) WHERE place <= 10 AND content IS DISTINCT FROM title")
def history_without_question(spark, d):
    """The last ten records of each author without those that only repeat their title."""
    rows = load(spark, d, "tickets").select("author", "doc_id", "created_at", "content", "title").where("author is not null and created_at is not null and doc_id is not null and content is not null and title is not null").distinct()
    kept = answers.last_messages(rows, "author", F.desc("created_at"), F.desc("doc_id"), F.desc("content"), text="content", question="title")
    return kept.select("author", "doc_id", "created_at", *_long("place"))


@query("SELECT doc_id, path FROM documents WHERE contains(text, '2024') ORDER BY doc_id LIMIT 80")
def natural_order_sample(spark, d):
    return load(spark, d, "documents").where(F.col("text").contains("2024")).select("doc_id", "path").orderBy("doc_id").limit(80)


@query(f"SELECT count(*) AS chunks, (SELECT count(*) FROM documents) AS documents, round(count(*) / (SELECT greatest(count(*), 1) FROM documents), 4) AS ratio FROM ({ORACLE_SQL['chunk_documents']})")
def chunk_ratio(spark, d):
    documents = load(spark, d, "documents")
    total = documents.agg(F.count("*").alias("documents"))
    return chunks(documents, "doc_id").agg(F.count("*").alias("chunks")).join(F.broadcast(total)).withColumn("ratio", F.round(F.col("chunks") / F.greatest("documents", F.lit(1)), 4))
