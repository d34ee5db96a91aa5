"""The SQL of those training-text queries that SQL can state, as exact all-pairs versions."""

from __future__ import annotations

from corpusloom.llm.lookalike import fold_table

# Usable vectors: 64 numbers, none missing or not finite, not all zero.
_USABLE = """
    usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embedding_objects
        WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x for x in embedding if x <> 0]) > 0
    )"""

P1_FOUND = f"""
    WITH {_USABLE},
    met AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.v, b.v) AS s FROM usable a JOIN usable b ON a.vec_id <> b.vec_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS place FROM met WHERE s >= 0.94)
    SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM placed WHERE place <= 10"""

P1_NEAREST = f"""
    WITH {_USABLE},
    met AS (
        SELECT a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS s
        FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank FROM met)
    SELECT vec_id, neighbour_id, round(s, 6) AS similarity, rank FROM placed WHERE rank <= 10"""

# Sets of runs of 8 letters or digits (3 for titles) of each record, and the pairs at 0.6 or more.
_NEAR = r"""
    field AS (
        SELECT 'documents' AS tab, doc_id AS key, text AS t, 8 AS k FROM documents
        UNION ALL SELECT 'questions', question_id, body, 8 FROM questions
        UNION ALL SELECT 'articles', try_cast(article_id AS BIGINT), title, 3 FROM articles
    ),
    plain AS (
        SELECT DISTINCT tab, key, k, regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') AS norm
        FROM field WHERE t IS NOT NULL AND key IS NOT NULL
    ),
    long_enough AS (SELECT * FROM plain WHERE length(norm) >= k),
    run AS (
        SELECT DISTINCT tab, key, substring(norm, i::BIGINT, k) AS r
        FROM (SELECT *, unnest(range(1, length(norm) - k + 2)) AS i FROM long_enough)
    ),
    size AS (SELECT tab, key, count(*) AS n FROM run GROUP BY ALL),
    common AS (
        SELECT p.tab, p.key AS a, q.key AS b, count(*) AS n
        FROM run p JOIN run q ON p.tab = q.tab AND p.r = q.r AND p.key < q.key GROUP BY ALL
    ),
    pair AS (
        SELECT c.tab, c.a, c.b FROM common c
        JOIN size x ON c.tab = x.tab AND c.a = x.key JOIN size y ON c.tab = y.tab AND c.b = y.key
        WHERE c.n / (x.n + y.n - c.n) >= 0.6
    )"""

P5_FOUND = f"WITH {_NEAR} SELECT tab, a AS key_a, b AS key_b FROM pair"

# Links are counted between classes of records with equal letters and digits.
P5_GROUPS = f"""
    WITH RECURSIVE {_NEAR},
    edge AS (SELECT tab, a, b FROM pair UNION ALL SELECT tab, b, a FROM pair),
    reach AS (
        SELECT tab, key, key AS seen FROM long_enough
        UNION SELECT r.tab, r.key, e.b FROM reach r JOIN edge e ON e.tab = r.tab AND e.a = r.seen
    ),
    grouped AS (SELECT tab, key, min(seen) AS group_id FROM reach GROUP BY ALL),
    linked AS (
        SELECT e.tab, e.a AS key, count(DISTINCT q.norm) AS links
        FROM edge e JOIN long_enough p ON p.tab = e.tab AND p.key = e.a JOIN long_enough q ON q.tab = e.tab AND q.key = e.b
        WHERE p.norm <> q.norm GROUP BY ALL
    )
    SELECT g.tab, g.key AS row_key, g.group_id, coalesce(l.links, 0) AS links
    FROM grouped g LEFT JOIN linked l ON l.tab = g.tab AND l.key = g.key"""


def _folded() -> str:
    """Texts in one form: the map of look-alikes is the operator's, composition and grouping are the engine's own."""
    table = fold_table()
    kept = [c for c, to in table.items() if to]
    quoted = ["".join(x).replace("'", "''") for x in (kept + [c for c, to in table.items() if not to], [table[c] for c in kept])]
    return f"""
    folded AS (
        SELECT doc_id, text, translate(replace(text, 'ำ', 'ํา'), '{quoted[0]}', '{quoted[1]}') AS f FROM documents WHERE text IS NOT NULL
    ),
    look AS (SELECT doc_id, text, text <> f AS changed, nfc_normalize(f) AS form FROM folded)"""


P8_FOUND = f"""
    WITH {_folded()}
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
    FROM look a JOIN look b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text"""

P8_CANONICAL = f"""
    WITH {_folded()},
    class AS (SELECT form, count(DISTINCT text) AS texts, min(doc_id) AS least, min({{'changed': changed, 'id': doc_id}}).id AS plain FROM look GROUP BY form)
    SELECT doc_id, CASE WHEN texts = 1 THEN least ELSE plain END AS canonical_doc_id FROM look JOIN class USING (form)"""

ORACLE_SQL = {
    "p1_found": P1_FOUND,
    "p1_nearest": P1_NEAREST,
    "p5_found": P5_FOUND,
    "p5_groups": P5_GROUPS,
    "p8_found": P8_FOUND,
    "p8_canonical": P8_CANONICAL,
}
