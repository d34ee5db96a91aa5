import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, keywords, predicates, store, vectors
from corpusloom.plans.pipelines import cascade, chunks, process_documents
from corpusloom.sources import files
from corpusloom.streaming.ingest import hourly, ingest, record_stream


def test_filters(spark):
    df = spark.createDataFrame([(1, "faq", 2024, "a token"), (2, "wiki", 2023, "b")], "id int, category string, year int, text string")
    ids = lambda **k: sorted(r.id for r in predicates.filtered(df, **k).collect())
    assert ids(where={"category": "faq", "year": 2024}) == [1]
    assert ids(where={"$or": [{"category": {"$in": ["faq"]}}, {"year": 2023}]}) == [1, 2]
    assert ids(where={"unknown": 1}, contains="b") == [1, 2]
    assert ids(contains="token") == [1]


def test_two_routes_keep_the_preferred_copy(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "near", 0), (2, [0.6, 0.8], "copy", 1), (3, [1.0, 0.01], "copy", 0), (4, [0.0, 0.0], "zero", 0)], "vec_id int, embedding array<double>, text string, label int")
    got = vectors.two_routes(df, [1.0, 0.0], 3, F.col("label") == 1).collect()
    assert [r.vec_id for r in got] == [1, 2]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "the scheduler, scheduler", "a"), (2, "other", "scheduler"), (3, None, None)], "id int, text string, source string")
    got = keywords.keyword_search(df, "scheduler", 5, id_col="id").collect()
    assert [(r.id, r.raw_score) for r in got] == [(1, 36.0 + 18.0)]
    assert keywords.query_terms("检索服务") == ["检索服务", "检索服", "索服务", "服务", "检索", "索服"]
    assert [r.id for r in keywords.bm25(df, "id", "text", ["scheduler"], 5).collect()] == [1]


def test_store(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "id string, version int, text string")
    assert [tuple(r) for r in store.last_wins(df, "id", "version").collect()] == [("a", 2, "y")]
    ordinal = store.with_ordinal(spark.range(50).selectExpr("49 - id AS k"), "k").orderBy("k").collect()
    assert [r.doc_idx for r in ordinal] == list(range(50))
    with pytest.raises(ValueError):
        store.drop_collection(spark, "t")


def test_answers(spark):
    df = spark.createDataFrame([("g", 1, "one", "s1", 2024), ("g", 2, "two", None, None)], "g string, rank int, text string, source string, year int")
    assert answers.context(df, "g", "rank", "text", "source", "year").first().context == "[source: s1 (2024)]\none\n\n[source: unknown]\ntwo"
    assert df.agg(answers.citations(F.col("source")).alias("c")).first().c == "- s1\n- unknown"


def test_files_and_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("---\nauthor: Ann\n---\n# T\nbody")
    (docs / "b.csv").write_text("no")
    got = files.read_texts(spark, str(docs)).collect()
    assert [(r.source, r.text, r.front_matter["author"]) for r in got] == [("a.md", "# T\nbody", "Ann")]
    records = tmp_path / "records"
    records.mkdir()
    lines = [json.dumps({"doc_id": "1", "content": "hello " * 20, "created_at": "2024-01-02"}), "broken", json.dumps({"doc_id": "2", "content": " "})]
    (records / "r.jsonl").write_text("\n".join(lines))
    assert [(r.source, r.meta.year) for r in files.read_records(spark, str(records)).collect()] == [("r_1", 2024)]
    ingest(record_stream(spark, str(records)), str(tmp_path / "chunks"), str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in store.read_store(spark, str(tmp_path / "chunks")).collect()] == ["r_1_0"]


def test_chunks_and_hours(spark):
    df = spark.createDataFrame([(1, "x" * 50)], "id int, text string")
    assert chunks(df, "id").first().char_end == 50
    events = spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 1.0 AS value")
    assert hourly(events, "ts", "value").first().events == 1


def test_files_of_any_case_and_missing_folder(spark, tmp_path):
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "A.Md").write_text("---\ntitle: 'T'\nmap:\n  inner: 1\n---\n\n\n  body \n")
    (docs / "b.tXT").write_text("plain")
    (docs / "empty.md").write_text(" \n ")
    got = {r.source: (r.text, r.front_matter) for r in files.read_texts(spark, str(tmp_path / "docs")).collect()}
    assert got["A.Md"][0] == "body" and got["A.Md"][1]["title"] == "T" and got["b.tXT"] == ("plain", None) and len(got) == 2
    assert files.read_texts(spark, str(tmp_path / "none")).count() == 0
    files.write_results(spark.range(1), spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == 3


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", [1, 2])
def test_upsert_survives_a_crash(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, version int, text string")
    state = lambda: sorted((r.id, r.text) for r in store.read_store(spark, folder).collect())
    with pytest.raises(ValueError):
        store.read_store(spark, folder)
    store.upsert(spark, folder, rows(("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")), "id", "version", 4)
    from pyspark.sql.readwriter import DataFrameWriter

    real, calls = DataFrameWriter.parquet, []

    def failing(self, path, *args, **kwargs):
        calls.append(path)
        if len(calls) == step:
            raise Crash
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    new = rows(("a", 2, "new"), ("c", 1, "c"))
    with pytest.raises(Crash):
        store.upsert(spark, folder, new, "id", "version", 4)
    monkeypatch.undo()
    assert state() == [("a", "x"), ("b", "y")]
    store.upsert(spark, folder, new, "id", "version", 4)
    store.upsert(spark, folder, rows(("a", 1, "old")), "id", "version", 4)
    assert state() == [("a", "new"), ("b", "y"), ("c", "c")]
    store.upsert(spark, folder, rows().limit(0), "id", "version", 4)
    assert len(state()) == 3


def test_exact_median(spark):
    import statistics

    data = [("a", float(i * 7919 % 10007)) for i in range(5001)] + [("b", 1.0)] * 400 + [("b", 2.0)] * 400 + [("c", 5.0), ("c", None), (None, 3.0)]
    got = {r.g: r.median for r in store.exact_median(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    assert got == {g: statistics.median([v for x, v in data if x == g and v is not None]) for g in ("a", "b", "c", None)}


def test_many_queries_at_once(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 4))
    data = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [1.0]), (103, [float("nan")] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 20)
    hits = vectors.nearest_many(df, df.select(F.col("vec_id").alias("query_id"), "embedding"), 3, dim=4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(r.query_id, r["rank"], r.id) for r in hits} == {(i, n + 1, int(j)) for i in range(60) for n, j in enumerate(np.argsort(-(u @ u[i]))[:3])}
    docs = spark.createDataFrame([(1, "cache cache miss"), (2, "cache"), (3, None), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "cache"), (2, "miss it"), (3, None), (4, "none")], "q long, question string")
    got = [(r.query_id, r.id) for r in keywords.search_many(keywords.postings(docs, "id", "text"), asked, "q", "question", 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 1)] or got == [(1, 2), (1, 1), (2, 1)]
    one = keywords.bm25(docs, "id", "text", ["miss"], 5).collect()
    assert [r.id for r in one] == [1]


def test_routes_topics_and_filters(spark):
    df = spark.createDataFrame([(1, "scheduler run", None), (2, "检索服务很慢", None), (3, "cache 先看", None), (4, None, None)], "id long, text string, source string")
    got = {r.id: r.route for r in keywords.candidates(df, "scheduler 检索服务", id_col="id", topic=["cache"], guidance=["先"]).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    hits = keywords.keyword_search(df, "scheduler", 5, id_col="id", topics=[(["scheduler"], {"run": 7.0})]).collect()
    assert [(r.id, r.raw_score) for r in hits] == [(1, 36.0 + 9.0 + 7.0)]
    assert predicates.coerced({"year": "2024", "author": "", "category": 3, "x": None}) == {"year": 2024, "category": "3"}
    flagged = predicates.filtered(df, {"id": {"$odd": 1}}, flag="fell_back").collect()
    assert len(flagged) == 4 and all(r.fell_back for r in flagged)
    assert [r.id for r in predicates.filtered(df, {"id": {"$gte": 2, "$ne": 3}}).orderBy("id").collect()] == [2, 4]


def test_cascade_and_strategies(spark):
    first = spark.createDataFrame([(1, 7, 0.5)], "q long, id long, score double")
    second = spark.createDataFrame([(1, 8, 0.1), (2, 9, 0.3), (2, 4, 0.3)], "q long, id long, score double")
    assert [(r.q, r.id, r.route) for r in cascade([first, second], "q", "id", 5).orderBy("q", "place").collect()] == [(1, 7, 0), (2, 4, 1), (2, 9, 1)]
    with pytest.raises(ValueError):
        process_documents(spark.range(1), "other")


def test_history_and_hints(spark):
    df = spark.createDataFrame([("c", i, f"m{i}", "m8") for i in range(1, 13)], "c string, turn int, text string, question string")
    kept = answers.last_messages(df, "c", F.desc("turn"), text="text", question="question").collect()
    assert sorted(r.turn for r in kept) == [3, 4, 5, 6, 7, 9, 10, 11, 12]
    cases = spark.createDataFrame([(1, ["WIKI", "x"]), (2, ["zzz"]), (3, []), (4, None)], "id long, hints array<string>")
    names = spark.createDataFrame([("a_wiki_b",), (None,)], "name string")
    assert {r.id: r.hit for r in answers.hint_hits(cases, "hints", names, "name").collect()} == {1: True, 2: False, 3: False, 4: False}
