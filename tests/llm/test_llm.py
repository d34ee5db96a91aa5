import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import garbled, languages, leakage, lookalike, mixing, neardup, neighbours, sentences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 4, axis=0) + rng.normal(scale=0.05, size=(240, 16))
    data = [(i, [float(v) for v in x[i]], "s") for i in range(240)] + [(900, None, "s"), (901, [0.0] * 16, "s"), (902, [1.0], "s"), (903, [float("nan")] * 16, "s"), (None, [1.0] * 16, "s")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, key string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    expected = {(i, j) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= 0.94}
    got = {tuple(r) for r in neighbours.similar_pairs(df, "vec_id", "embedding", dim=16).collect()}
    assert got <= expected and len(got) >= 0.98 * len(expected)
    nearest = neighbours.most_similar(df, "vec_id", "embedding", 3, dim=16, query="id % 100 = 0")
    got = {}
    for r in nearest.collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    np.fill_diagonal(s, -2)
    assert got == {i: {n + 1: int(j) for n, j in enumerate(np.argsort(-s[i])[:3])} for i in (0, 100, 200)}
    assert neighbours.most_similar(df.limit(0), "vec_id", "embedding", 3, dim=16, query="id % 100 = 0").count() == 0
    assert neighbours.similar_pairs(df.limit(0), "vec_id", "embedding", dim=16).count() == 0


def test_neighbours_of_copied_vectors(spark):
    # More than half of the rows are one vector, and more copies than a window holds.
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    x[60:] = x[0] + 0.3 * rng.normal(size=(140, 16))
    ids = rng.permutation(450).tolist()
    vecs = [*x.tolist(), *[x[0].tolist()] * 250]
    unusable = [(900 + i, v) for i, v in enumerate([[0.0] * 16] * 2 + [[1.0]] * 2 + [[float("nan")] * 16] * 2)]
    df = spark.createDataFrame([*zip(ids, vecs, strict=True), *unusable], "vec_id long, embedding array<float>")
    unit = np.array(vecs, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    want = {}
    for i, own in enumerate(ids):
        want[own] = [n for _, n in sorted((-s[i, j], n) for j, n in enumerate(ids) if j != i)[:5]]
    for query in (None, "id % 3 = 0"):
        got = {}
        for r in neighbours.most_similar(df, "vec_id", "embedding", 5, dim=16, window=100, query=query).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.neighbour)
        copies = {ids[0], *ids[200:]}
        asked = {i for i in ids if not query or i % 3 == 0}
        assert set(got) == asked
        assert all(got[i] == want[i] for i in asked & copies)
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in asked]) > 0.97


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert_key(grid, 3)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_garbled_text(spark):
    clean = "Après la démonstration, la tâche dépend du café – naïve."
    wrong = clean.encode().decode("cp1252", "replace").replace("�", "")
    zh = "检索服务没有通过验收"
    data = [("d", i, f"{clean} {zh}。") for i in range(6)] + [("d", 10, wrong), ("d", 11, zh.encode().decode("latin-1")), ("d", 12, "lost � here"), ("d", 13, None), ("d", None, wrong), ("d", 14, ""), ("d", 15, "plain ascii")]
    df = spark.createDataFrame(data, "tab string, row_key long, text string")
    assert rows(garbled.garbled_records(df)) == [("d", 10), ("d", 11), ("d", 12)]
    restored = {r.row_key: r for r in garbled.restore(df).collect()}
    assert restored[11].restored == zh and restored[11].complete and not restored[12].complete
    assert garbled.garbled_records(df.limit(0)).count() == 0


def test_garbled_copies(spark):
    # Most rows are copies of one garbled text.
    clean = [("d", i, f"Die Größe der Fläche Nummer {i} ist bekannt") for i in range(20)]
    bad = "Die Größe der Fläche".encode().decode("latin-1")
    df = spark.createDataFrame(clean + [("d", 100 + i, bad) for i in range(30)], "tab string, row_key long, text string")
    assert rows(garbled.garbled_records(df)) == [("d", 100 + i) for i in range(30)]
    assert {(r.row_key, r.restored) for r in garbled.restore(df).collect()} == {(100 + i, "Die Größe der Fläche") for i in range(30)}


def test_sentences(spark):
    data = [
        (1, "# A. heading. Here\n\nDr. K. Bo wrote a.b_1.py at 3.5 p.m. on Monday. Next one,\nwrapped! He said “Stop. Go!” and left.", "x"),
        (2, "第一句。老师问：“好吗？行吗？”没有人回答。“谁？”有人问。", "x"),
        (3, "one. Two. Three\nfour", "slack"),
        (4, "ข้อมูลดี ต่อไป 3 ครั้ง", None),
        (5, None, "x"), (6, "  \n ", "x"),
    ]
    df = spark.createDataFrame(data, "id long, text string, source string").withColumn("sentence", F.lit(1))
    got = {}
    for r in sentences.sentences(df, "id", "text", "source").orderBy("id", "char_start").collect():
        assert data[r.id - 1][1][r.char_start : r.char_end] == r.sentence
        got.setdefault(r.id, []).append(r.sentence)
    assert got[1] == ["# A. heading. Here", "Dr. K. Bo wrote a.b_1.py at 3.5 p.m. on Monday.", "Next one,\nwrapped!", "He said “Stop. Go!” and left."]
    assert got[2] == ["第一句。", "老师问：“好吗？行吗？”没有人回答。", "“谁？”有人问。"]
    assert got[3] == ["one. Two. Three", "four"] and got[4] == ["ข้อมูลดี", "ต่อไป 3 ครั้ง"] and set(got) == {1, 2, 3, 4}


def test_languages(spark):
    en, de = "The index was moved to the room. It keeps only the last days.", "Die Tabelle wurde nach oben verschoben. Sie behält nur die letzten Tage."
    data = [(i, en, "en", "x") for i in range(5)] + [(i + 10, de, "de-DE", "x") for i in range(5)]
    data += [(20, en * 3, None, "x"), (21, "数据库没有通过验收。它很慢。", "en", "x"), (22, f"{en} {en} {en}\n\n{de}", "eng", "x"), (23, None, "en", "x"), (24, "", "en", "x")]
    df = spark.createDataFrame(data, "id long, text string, lang string, source string")
    assert rows(languages.found_labels(df, "id", "text", "lang", "source")) == [(20, "en", "main"), (21, "zh", "main"), (22, "de", "segment")]


def test_viterbi_keeps_short_noise():
    scores = np.zeros((1, 9, 2))
    scores[0, :, 0], scores[0, 4] = 1.0, (0.0, 2.0)
    assert (languages.viterbi(scores, 3.0) == 0).all()


def test_probminhash_estimates_jaccard():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    s = neardup.probminhash(np.concatenate([a, b, a]), np.repeat([0, 1, 2], 1000), 3, 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08 and (s[0] == s[2]).all()


def test_sentences_of_a_long_text(spark):
    # Units across the stretches a text is kept in, characters beyond the basic plane included.
    text = "".join(f"Unit {i} has 😀 {'word ' * (i % 1500)}end. " for i in range(0, 6000, 7))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = sentences.sentences(df, "id", "text").orderBy("char_start").collect()
    assert [r.sentence for r in got] == [text[r.char_start : r.char_end] for r in got]
    assert [r.sentence.split()[1] for r in got] == [str(i) for i in range(0, 6000, 7)]


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the wood"
    data = [(1, base), (2, base.upper() + "!"), (3, base.replace("hunter", "ranger")), (4, "something else entirely with other words in it"), (5, None), (6, "x"), (2, base.upper() + "!")]
    df = spark.createDataFrame(data, "id long, text string").withColumn("rep", F.lit(0))
    assert rows(neardup.near_duplicate_pairs(df, "id", "text")) == [(1, 2), (1, 3), (2, 3)]
    groups = {r.key: r.group_id for r in neardup.near_duplicate_groups(df, "id", "text").collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4}
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


def test_a_key_with_two_texts_links_neither_to_the_other(spark):
    one, two = "the first text of the record with its own words", "quite another matter told in different terms"
    df = spark.createDataFrame([(1, one), (1, two), (2, one.upper()), (3, two.upper()), (4, two + "s")], "id long, text string")
    assert rows(neardup.near_duplicate_pairs(df, "id", "text")) == [(1, 2), (1, 3), (1, 4), (3, 4)]
    groups = {r.key: (r.group_id, r.links) for r in neardup.near_duplicate_groups(df, "id", "text").collect()}
    assert groups == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (1, 1)}


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = [(i, f"filler text number {i} about nothing") for i in range(20)]
    docs += [(100, "before it " + " ".join(passage.split()[:25]).upper() + " after it"), (101, " ".join(passage.split()[:12])), (102, passage.replace("word7 ", "other ")), (103, None), (104, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "a completely different held out passage with its own terms")], "item_id long, passage string")
    got = leakage.leaks(df, "doc_id", "text", items, "item_id", "passage")
    assert {(r.id, r.item_id) for r in got.collect()} == {(100, 1), (102, 1)}
    assert leakage.leaks(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_curriculum(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pytest.importorskip("tiktoken")
    docs = [(i, "alpha beta gamma delta", "big") for i in range(300)] + [(1000 + i, "alpha beta gamma delta", "small") for i in range(30)] + [(2000, None, "big"), (2001, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(0))
    targets = spark.createDataFrame([("m", "big", 0.7, 1), ("m", "small", 0.2, 3), ("m", "none", 0.1, 2)], "mix_name string, source string, target_share double, max_repeats int")
    plan, shares = mixing.curriculum(df, targets, "doc_id", "text", "source", path)
    got = {r.source: r for r in shares.collect()}
    assert got["none"].tokens == 0 and abs(got["small"].actual_share - 2 / 9) < 0.01 and got["small"].most_repeats == 3
    position = [r.position for r in plan.collect()]
    assert position == sorted(position) and 0 <= position[0] and position[-1] <= 1
    assert max(r["count"] for r in plan.groupBy("id").count().collect()) == 3


def test_look_alikes(spark):
    data = [(1, "Café one"), (2, "Café one"), (3, "Ｃafé one"), (4, "Саfé o​ne"), (5, "Cafe one"), (6, "café one"), (7, "Café one"), (8, None), (9, "")]
    df = spark.createDataFrame(data, "id long, text string").withColumn("folded", F.lit("x"))
    expected = {(a, b) for a in (1, 2, 3, 4, 7) for b in (1, 2, 3, 4, 7) if a < b} - {(1, 7)}
    assert {tuple(r) for r in lookalike.look_alike_pairs(df, "id", "text").collect()} == expected
    classes = {r.id: r.class_id for r in lookalike.canonical_classes(df, "id", "text").collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 5: 5, 6: 6, 9: 9}


def test_leaks_of_common_terms(spark):
    # The second half of the passage is in every document: none of its terms tells.
    rare, common = " ".join(f"seldom{i}" for i in range(12)), " ".join(f"often{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"{rare} {common}")], "item_id long, passage string")
    df = spark.createDataFrame([(i, f"note {i} {common} end") for i in range(8)], "doc_id long, text string")
    got = leakage.leaks(df, "doc_id", "text", items, "item_id", "passage")
    assert rows(got.select("id", "item_id", "covered")) == [(i, 1, 0.5) for i in range(8)]


def test_run_test_loses_no_run():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 8, 16, 24, 40):
        passage = [f"w{x}" for x in rng.integers(0, 30, n)]
        number = {w: i for i, w in enumerate({*passage, "other", "words"})}
        runs = leakage._Runs([np.array([number["other"], number["words"]]), np.array([number[w] for w in passage])], len(number), 0.5)
        for _ in range(200):
            text, i = [f"x{x}" for x in range(rng.integers(0, 9))], int(rng.integers(0, n))
            while i < n:
                step = int(rng.integers(1, 6))
                text += passage[i : i + step] + [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 3))]
                i += step + int(rng.integers(0, 3))
            whole = leakage._longest_run(passage, text)[1] / n
            best = max((leakage._longest_run(passage, text[a:b])[1] / n for a, b in runs(np.array([number.get(w, len(number)) for w in text]), {1}).get(1, [])), default=0)
            assert best == whole if whole >= 0.5 else best < 0.5


def test_documents_are_searched_in_groups(monkeypatch):
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 90, n) for n in (1, 3, 12, 40, 60)]
    docs = [np.concatenate([rng.integers(0, 91, rng.integers(1, 90)), passages[i % 5][i % 3 :], rng.integers(0, 91, i % 7)]).astype(np.int32) for i in range(40)]
    docs.append(np.append(np.full(9_000, 90, np.int32), passages[3]).astype(np.int32))
    runs, latent = leakage._Runs(passages, 90, 0.5), leakage._Search(rng.normal(size=(90, 4)).astype(np.float32), passages, 0.8)
    steps = []
    reached = runs._reached
    monkeypatch.setattr(runs, "_reached", lambda *a: steps.append(a) or reached(*a))
    wanted = np.ones((len(docs), len(passages)), bool)
    found = runs.spans(docs, wanted)
    # Twice for all documents (it was once for each and once for each stretch), whatever is looked at together.
    assert len(steps) == 2 and (40, 3) in found
    monkeypatch.setattr(leakage, "PLACES", 50)
    assert runs.spans(docs, wanted) == found
    assert found == {(d, p): spans for d, terms in enumerate(docs) for p, spans in runs(terms, set(range(5))).items()}
    near = {(d, p): (c, s) for d, p, c, s in zip(*(x.tolist() for x in latent(docs)), strict=True)}
    alone = {(d, p): (c, s) for d, terms in enumerate(docs) for _, p, c, s in zip(*(x.tolist() for x in latent([terms])), strict=True)}
    assert near.keys() == alone.keys() and (40, 3) in near
    assert all(abs(near[k][0] - alone[k][0]) < 1e-4 and near[k][1] == alone[k][1] for k in near)


def test_latent_space_is_low_rank_and_keeps_leaks(spark):
    rng = np.random.default_rng(8)
    passages = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(40)]
    items = spark.createDataFrame([(i, " ".join(p), "what is w1") for i, p in enumerate(passages)], "item_id long, passage string, question string")
    docs, expected = [], set()
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 400, 80)]
        if i % 2:
            p, at = i % 40, int(rng.integers(0, 30))
            words[20:20] = passages[p][at : at + 15] + ["changed"] + passages[p][at + 16 : at + 31]
            expected.add((i, p))
        docs.append((i, " ".join(words)))
    # One text beyond the terms projected at once, with a leak behind its end.
    docs.append((900, " ".join(f"w{x}" for x in rng.integers(0, 400, 9000)) + " " + " ".join(passages[3])))
    # Every other clause is new: no run of half the passage, yet all of it in order.
    docs.append((901, " ".join(w for i in range(0, 60, 6) for w in [*passages[5][i : i + 6], "and", "so", "on"])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    number = {}
    for t in (t for p in passages for t in p):
        number.setdefault(t, len(number))
    terms = leakage._numbered(leakage._normal(df, "doc_id", "text", "id"), number)
    space, _, kept = leakage.latent_space(terms, [np.array([number[w] for w in p]) for p in passages], len(number), rank=10)
    assert space.shape == (len(number), 10) and 0 < kept < 1
    got = {(r.id, r.item_id): r.kind for r in leakage.leaks(df, "doc_id", "text", items, "item_id", "passage", "question").collect()}
    assert {k for k, v in got.items() if v == "run"} == expected | {(900, 3)}
    assert got[(901, 5)] == "paraphrase"


def test_weighted_near_duplicates(spark):
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 4, (2, 30)).astype(float)
        p, q = np.flatnonzero(x), np.flatnonzero(y)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(30)) for i in range(30) if x[i] and y[i])
        assert abs(neardup.probability_jaccard(p, x[p], q, y[q]) - want) < 1e-9
    # As sets the two are equal but for two shingles; counted, their weights lie apart.
    a, b = "abcdefgh" * 30 + "ijklmnop", "abcdefgh" + "ijklmnop" * 30
    df = spark.createDataFrame([(1, a), (2, b), (3, a + "q"), (4, None)], "id long, text string")
    plain = {r.key: r.group_id for r in neardup.near_duplicate_groups(df, "id", "text", k=2).collect()}
    weighted = {r.key: r.group_id for r in neardup.near_duplicate_groups(df, "id", "text", k=2, weighted=True).collect()}
    assert plain == {1: 1, 2: 1, 3: 1} and weighted == {1: 1, 2: 2, 3: 1}
    assert rows(neardup.near_duplicate_pairs(df, "id", "text", k=2, weighted=True)) == [(1, 3)]


def test_a_hot_bucket_keeps_every_link(spark):
    # A third of the records are one text with a word changed, and as many are its copies.
    base = " ".join(f"part{i} of the text" for i in range(12))
    data = [(i, base.replace("part5", f"item{i}")) for i in range(60)] + [(100 + i, base) for i in range(60)] + [(200 + i, f"number {i * 7919} stands {i * 104729} alone {i * 1299709}") for i in range(60)]
    df = spark.createDataFrame(data, "id long, text string")
    groups = {r.key: (r.group_id, r.links) for r in neardup.near_duplicate_groups(df, "id", "text").collect()}
    assert all(groups[i] == (0, 60) for i in [*range(60), *range(100, 160)]) and all(groups[200 + i] == (200 + i, 0) for i in range(60))


def test_look_alike_radicals_and_copies(spark):
    data = [(1, "⻅过 长门"), (2, "见过 ⻓⻔")] + [(10 + i, "见过 长门") for i in range(40)]
    df = spark.createDataFrame(data, "id long, text string")
    got = {tuple(r) for r in lookalike.look_alike_pairs(df, "id", "text").collect()}
    assert got == {(1, 2)} | {(a, 10 + i) for a in (1, 2) for i in range(40)}


def test_every_chain_is_found(spark):
    clean = {"utf-8": "Größe späte", "cp1251": "проверка очереди", "koi8-r": "проверка очереди", "cp932": "再起動した検索", "big5": "資料庫檢查", "tis-620": "ระบบค้นหาช้า", "gbk": "数据库检查"}
    data = [("d", i * 100 + j, f"{text} {j}") for i, text in enumerate(clean.values()) for j in range(12)]
    expected = set()
    for n, chain in enumerate(garbled.CHAINS):
        text = clean[chain[0][0]]
        try:
            for right, wrong in chain:
                text = garbled._read(text.encode(right), wrong)
        except UnicodeEncodeError:
            continue
        if garbled._LOST not in text and text != clean[chain[0][0]]:
            data.append(("d", 5000 + n, text))
            expected.add(5000 + n)
    df = spark.createDataFrame(data, "tab string, row_key long, text string")
    got = {r.row_key for r in garbled.garbled_records(df).collect()}
    assert got == expected and len(expected) > 15


def test_labels_of_a_long_text_and_copies(spark):
    en, de = "The index was moved to the room. It keeps only the last days. ", "Die Tabelle wurde nach oben verschoben. Sie behält nur die letzten Tage. "
    data = [(i, en, "en", "x") for i in range(50)] + [(100 + i, f"{de}{i}", "de", "x") for i in range(5)]
    data += [(200, en * 15_000, None, "x"), (201, de, "en", "x")] + [(300 + i, en, "en", "x") for i in range(130)]
    df = spark.createDataFrame(data, "id long, text string, lang string, source string").repartition(2)
    model = languages.word_model(df.where("id < 200"), "text", "lang")
    got = {r.id: r.lang_code for r in languages.label_passages(df, "id", "text", "lang", "source", model=model).where("role = 'main'").collect()}
    assert got[200] == "en" and got[201] == "de" and got[104] == "de" and got[300] == "en"


def test_shares_of_few_documents(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    docs = [(i, "alpha beta gamma delta " * 30, "a") for i in range(10)] + [(100 + i, "alpha beta gamma delta " * 30, "b") for i in range(10)]
    targets = spark.createDataFrame([("m", "a", 0.55, 1), ("m", "b", 0.45, 1)], "mix_name string, source string, target_share double, max_repeats int")
    shares = mixing.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets, "doc_id", "text", "source", path)[1]
    got = {r.source: r.documents for r in shares.collect()}
    assert got == {"a": 10, "b": 8}


def test_code_quotations_and_disguise_are_no_passages(spark):
    en = "The index was moved to the room. It keeps only the last days. The room was moved to the last index."
    zh, ja = "数据库没有通过验收。它很慢。", "検索は遅いです。もう一度それを確かめてください。"
    code = "```\nfor row in read('the.csv'):\n    keeps = row.last\n    was.moved(to)\n```"
    disguised = en.translate(str.maketrans("aeopcxy", "аеорсху"))
    data = [(i, en, "en", "x") for i in range(5)] + [(10, f"{zh}{zh}\n\n它说“{en}”，可以忽略。\n\n{code}\n\n{code}\n<p class=index>", "zh", "x"), (11, disguised.replace("index", "Zеntоrу"), "en", "x")]
    data += [(12, (ja * 4).encode().decode("gbk", "replace"), "ja", "x"), (13, f"{zh}{zh}{zh}\n\n{en}\n\n```\nunclosed", "zh", "x"), (14, code, "zh", "x")]
    fr, ru = "La tâche a été déplacée. Elle dépend du café très près.", "Проверка очереди прошла. Она не была быстрой."
    for i, (text, lang, steps) in enumerate([(zh, "zh", 2), (ru, "ru", 1), (ja, "ja", 2), (fr, "fr", 1)]):
        text = text * 3
        for _ in range(steps):
            text = garbled._read(text.encode(), "cp1252")
        data += [(20 + i, text, lang, "x"), *[(30 + 10 * i + j, [zh, ru, ja, fr][i], lang, "x") for j in range(5)]]
    df = spark.createDataFrame(data, "id long, text string, lang string, source string")
    assert rows(languages.found_labels(df, "id", "text", "lang", "source")) == [(13, "en", "segment")]
