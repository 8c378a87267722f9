"""What a task holds does not grow with the rows that it gets."""

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.operators import concepts, counting, segmentation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_tops(rows, k):
    counts = defaultdict(Counter)
    for i, text in rows:
        counts[i].update(w for w in (text or "").split() if len(w) > 1 and w != "the")
    ranked = {i: sorted(c.items(), key=lambda p: (-p[1], p[0]))[:k] for i, c in counts.items()}
    return {(i, w, n, r) for i, top in ranked.items() for r, (w, n) in enumerate(top, 1)}


def test_documents_are_counted_within_their_rows(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta the gamma"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    tops = counting.prose_tops(docs, 2)
    assert "Aggregate" not in plan(tops) and "Window" not in plan(tops)
    assert {tuple(r) for r in tops.collect()} == {(1, "beta", 2, 1), (1, "alpha", 1, 2), (2, "alpha", 1, 1)}
    assert counting.prose_tops(docs, 0).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "beta alpha"), (1, "beta the"), (None, "alpha beta"), (None, "beta gamma"), (None, None), (2, "x yy yy zz"), (3, "the"), (3, "")]
    tops = counting.prose_tops(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {tuple(r) for r in tops.collect()} == brute_tops(rows, 2)
    assert {tuple(r) for r in tops.collect()} == {(1, "beta", 2, 1), (1, "alpha", 1, 2), (None, "beta", 2, 1), (None, "alpha", 1, 2), (2, "yy", 2, 1), (2, "zz", 1, 2)}


def test_counts_of_an_array(spark):
    texts = ["b a b", "", None, "é é a É", " ".join(f"w{k % 7}" for k in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", words(F.col("text")).alias("w"))
    for r in df.select("w", counting.counted(F.col("w")).alias("c")).collect():
        assert [tuple(c) for c in r["c"]] == sorted(Counter(r["w"]).items(), key=lambda p: p[0].encode())


def test_corpus_concepts_hold_counts_of_words_only(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta gamma"), (2, "alpha")], "doc_id long, text string")
    concepts = counting.prose_concepts(docs, 1)
    assert "Window" not in plan(concepts) and "keys=[doc_id" not in plan(concepts)
    assert [tuple(r) for r in concepts.collect()] == [("alpha", 2)]


def test_sources_leave_python_in_small_parts():
    texts = ["class A { }"] * 1000 + [None] * 300 + ["x" * 100_000] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["source_id", "content"])
    parts = list(segmentation.parts_of(batch))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    for p in parts:
        assert 0 < p.num_rows <= segmentation.PART_ROWS
        assert sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < segmentation.PART_BYTES


def test_only_wanted_columns_are_made(spark):
    sources = spark.createDataFrame([(1, "class A { int f() { return 1; } }"), (2, None), (3, "class A {")], "source_id int, content string")
    full, some = segmentation.parse_sources(sources), segmentation.parse_sources(sources, wanted=("error", "unit"))
    assert some.columns == ["source_id", "unit", "error"]
    assert sorted(some.collect()) == sorted(full.select(*some.columns).collect()) and some.where("error is null").count() == 2


def test_a_source_that_ends_where_a_name_is_expected_has_an_error():
    for text in ("@", "class", "class A { @", "class A { void f() { int x = y.", "class A { enum"):
        assert segmentation.describe(text, frozenset())["error"], text


def test_names_of_sources_are_counted_before_rows_meet(spark, monkeypatch):
    text = "class BallPark { int ballPark; int ballPark(int ballPark) { int parkBall = ballPark; return ballPark + parkBall; } }"
    seen = []
    monkeypatch.setattr(concepts, "write_table", lambda df, name, by=(): seen.append((name, df.count())) or df)
    sources = spark.createDataFrame([(1, text), (2, text), (3, "not java {")], "source_id long, content string")
    dictionary = spark.createDataFrame([("ball", 3), ("park", 2)], "word string, freq long")
    for words_known in (None, dictionary):
        found = {tuple(r) for r in concepts.source_concepts(sources, words_known).collect()}
        assert found == {(i, w, n, r) for i in (1, 2) for w, n, r in (("ball", 8, 1), ("park", 8, 2))}
    assert ("pieces", 12) in seen  # a source says three names eight times, of two pieces each


def test_top_of_each_in_given_parts(spark):
    rows = [(i, f"w{k % 9}", k) for i in range(20) for k in range(1, 30)]
    items = spark.createDataFrame(rows, "source_id long, word string, n long")
    parts = counting.top_of_each(items, 3, count_col="n", parts=5)
    assert plan(parts).count("Exchange") == 1
    assert sorted(parts.collect()) == sorted(counting.top_of_each(items, 3, count_col="n").collect())
    assert counting.parts_for(0) == 1 and counting.parts_for(counting.ROWS_OF_TASK + 1) == 2


def test_corpus_concepts_of_sources_deal_them_once(spark):
    text = "class BallPark { int ball; int park(int tree) { return ball + tree; } }"
    sources = spark.createDataFrame([(k, text) for k in range(3)] + [(3, "class Tree { }")], "source_id long, content string")
    found = concepts.corpus_concepts(sources, None, k=2)
    dealt = [line for line in plan(found).split("\n") if "Exchange" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in dealt) == 1
    assert not any("source_id" in line and "ENSURE_REQUIREMENTS" in line for line in dealt)
    assert [tuple(r) for r in found.collect()] == [("tree", 4), ("ball", 3)]


def test_equal_texts_are_parsed_once_and_count_as_often_as_they_are(spark, monkeypatch):
    ball, tree = "class Ball { int ball; int park(int tree) { return ball + tree; } }", "class Tree { int tree; }"
    rows = [(1, ball), (2, ball), (3, tree), (4, "not java {"), (5, None), (6, ""), (7, ball), (7, tree), (None, tree), (None, tree), (8, ball), (8, ball)]
    seen = {}
    monkeypatch.setattr(concepts, "write_table", lambda df, name, by=(), write=concepts.write_table: seen.setdefault(name, write(df, name, by)))
    once = spark.createDataFrame(rows[:6], "source_id long, content string")
    assert [tuple(r) for r in concepts.corpus_concepts(once).collect()] == [("tree", 3), ("ball", 2), ("park", 2)]
    assert sorted(tuple(r) for r in seen["texts"].select("content", "copies").collect()) == [("", 2), (ball, 2), (tree, 1), ("not java {", 1)]
    assert seen["pieces"].select("source_id").distinct().count() == 2
    monkeypatch.undo()
    every = spark.createDataFrame(rows, "source_id long, content string")
    dictionary = spark.createDataFrame([("ball", 3), ("park", 2), ("tree", 1)], "word string, freq long")
    for known in (None, dictionary):
        n = concepts.document_frequency(concepts.source_concepts(every, known))
        wanted = sorted(((r["word"], r["n"]) for r in n.collect()), key=lambda p: (-p[1], p[0]))
        assert [tuple(r) for r in concepts.corpus_concepts(every, known).collect()] == wanted == [("tree", 6), ("ball", 4), ("park", 4)]
