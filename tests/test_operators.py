import math
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import counting, graph, spelling, typicality
from textloom.operators.typicality import Processor
from textloom.sources import files


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    if not a or not b:
        return math.nan if not a and not b else 1.0
    return 1 - levenshtein(a, b) / max(len(a), len(b))


# Counting


def items(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_counter(spark):
    words = ["sort", "sort", "list", "the", "x", "list", "sort"]
    counter = counting.count_words(items(spark, words))
    assert {r["word"]: r["n"] for r in counter.collect()} == {"sort": 3, "list": 2}
    assert counting.items_count(items(spark, words)).first()["n"] == 7
    assert {r["word"]: r["n"] for r in counting.count_words(items(spark, words), []).collect()} == Counter(words)
    assert [r["word"] for r in counting.most_frequent(counter, 1).collect()] == ["sort"]
    assert counting.most_frequent(counter, 0).count() == 0 and counting.most_frequent(counter, 9).count() == 2
    both = counting.combine(counter, counting.count_words(items(spark, ["list", "list", "tree"])))
    assert [(r["word"], r["n"]) for r in counting.by_frequency(both).collect()] == [("list", 4), ("sort", 3), ("tree", 1)]
    assert counting.rendered(counter).first()["json"] == '{"list":2,"sort":3}'
    weighted = spark.createDataFrame([("sort", 5), ("sort", 2)], "word string, c int")
    assert counting.count_words(weighted, count_col="c").first()["n"] == 7
    assert counting.items_count(items(spark, [])).first()["n"] == 0


def test_saturation(spark):
    df = spark.createDataFrame([(4,), (0,)], "n int")
    assert [r["x"] for r in df.select(counting.saturated(F.col("n"), 3, 10).alias("x")).collect()] == [9, 0]
    assert df.select(counting.saturated(F.col("n"), 3).alias("x")).first()["x"] == 12
    steps = spark.createDataFrame([([4, 7, 3],)], "s array<long>").select(counting.saturated_in_order(F.col("s"), 10).alias("x"))
    assert steps.first()["x"] == 7


def test_tops_and_ties(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta gamma"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    tops = counting.top_of_each(counting.prose_words(docs), 2, "doc_id")
    assert sorted((r["doc_id"], r["rank"], r["word"], r["n"]) for r in tops.collect()) == [(1, 1, "beta", 2), (1, 2, "alpha", 1), (2, 1, "alpha", 1)]
    assert [(r["word"], r["n"]) for r in counting.prose_concepts(docs, 1).collect()] == [("alpha", 2)]


# Spelling

DICTIONARY = {"text": 9, "texts": 3, "configuration": 4, "config": 1, "error": 7, "errors": 7, "string": 6, "tax": 2, "sort": 5, "strong": 6}


def brute_mutations(w):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return (
        [w[:k] + w[k + 1 :] for k in range(len(w))]
        + [w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters]
        + [w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters]
        + [w[:k] + w[k + 1] + w[k] + w[k + 2 :] for k in range(len(w) - 1)]
    )


def brute_correct(w, known):
    def best(candidates):
        found = [c for c in dict.fromkeys(candidates) if c in known]
        return max(found, key=lambda c: known[c], default=None)

    prefix = lambda p: best(sorted(d for d in known if d.startswith(p)))
    if w in known:
        return {w}
    by_prefix = prefix(w) or prefix(w[:-1])
    if w and not any(c in "aeiou" for c in w):
        first = brute_mutations(w)
        twice = {m for x in first for m in brute_mutations(x)}
        found = {c for c in (best(first), best(sorted(twice)), by_prefix) if c}
        top = max((likeness(w, c) for c in found), default=None)
        return {c for c in found if likeness(w, c) == top} if found else {w}
    return {by_prefix or w}


def table(spark, known=DICTIONARY):
    return spark.createDataFrame(list(known.items()), "word string, freq long")


def test_mutations_in_order(spark):
    df = items(spark, ["", "a", "ab", "abc"]).select("word", spelling.mutations(F.col("word")).alias("m"))
    for r in df.collect():
        assert r["m"] == brute_mutations(r["word"])


def test_correction_against_brute_force(spark):
    words = ["txt", "config", "err", "str", "srt", "strng", "tx", "t", "zzz", "texx", "con", "sortt", "qqqqqq", "rrr", "strg", "rst", "xyz", "confi", "errx", "th"]
    got = {r["word"]: r["corrected"] for r in spelling.correct(items(spark, words), table(spark)).collect()}
    assert set(got) == set(words)
    for w in words:
        assert got[w] in brute_correct(w, DICTIONARY), w


def test_short_forms_become_words(spark):
    known = {"configuration": 3, "text": 5, "error": 4, "string": 6}
    got = {r["corrected"] for r in spelling.correct(items(spark, ["txt", "config", "err", "str"]), table(spark, known)).collect()}
    assert got <= set(known)


def test_two_edits_find_all(spark):
    words = ["txt", "srt", "tsrt", "etxt", "rsot", "xtet"]
    got = {(r["word"], r["candidate"]) for r in spelling.two_edits(items(spark, words), table(spark)).collect()}
    assert got == {(w, d) for w in words for d in DICTIONARY if d in {m for x in brute_mutations(w) for m in brute_mutations(x)}}


def test_dictionary(spark):
    texts = spark.createDataFrame([("And THE sortedList sorted_map x1 bcd 42 list",), (None,)], "text string")
    assert {r["word"]: r["freq"] for r in spelling.build_dictionary(texts).collect()} == {"sorted": 2, "list": 2, "map": 1}
    assert spelling.in_dictionary(items(spark, ["text", "nope"]), table(spark)).first()["word"] == "text"


def test_acceptance_compares_the_label_as_written(spark):
    df = spark.createDataFrame([("txt", "text"), ("TXT", "text"), ("abc", "xyz")], "l string, c string")
    assert [r["x"] for r in df.select(spelling.accepted(F.col("l"), F.col("c")).alias("x")).collect()] == ["text", "TXT", "abc"]


# Graphs


def dag(spark, edges, n=6):
    vertices = spark.createDataFrame([(k, f"v{k % 3}", k % 4, k == 0) for k in range(n)], "ordinal long, label string, depth int, is_root boolean")
    empty = spark.createDataFrame([], "from_ord long, to_ord long, weight double")
    return graph.Dag(vertices, empty).add_edges(spark.createDataFrame([(a, b, 1.5) for a, b in edges], "from_ord long, to_ord long, weight double"), check=False)


def pairs(df):
    return sorted((r["from_ord"], r["to_ord"]) for r in df.collect())


def test_graph_changes_and_lookups(spark):
    g = dag(spark, [(0, 1), (1, 2), (0, 2), (0, 1), (2, 9)])
    assert pairs(g.edges) == [(0, 1), (0, 2), (1, 2)] and g.size() == 3 and not g.has_cycle()
    with pytest.raises(graph.CycleError):
        g.add_edges(spark.createDataFrame([(2, 0, 0.0)], "from_ord long, to_ord long, weight double"))
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "ordinal long")
    edge = lambda *e: spark.createDataFrame(list(e), "from_ord long, to_ord long")
    assert pairs(g.remove_vertices(ids(1)).edges) == [(0, 2)]
    assert g.remove_vertices(ids(0)).root().count() == 0 and g.root().first()["ordinal"] == 0 and g.set_root(3).root().first()["ordinal"] == 3
    assert pairs(g.remove_edges(edge((0, 1))).edges) == [(0, 2), (1, 2)]
    assert g.by_label("v1").first()["ordinal"] == 1 and g.at(4).first()["label"] == "v1"
    assert pairs(graph.incoming(g.edges, ids(2))) == [(0, 2), (1, 2)] and pairs(graph.outgoing(g.edges, ids(0))) == [(0, 1), (0, 2)]
    assert g.contains_edges(edge((0, 1), (1, 0))).count() == 1 and g.contains_vertices(ids(1, 77)).count() == 1
    assert pairs(g.find_edge(0, 1)) == [(0, 1)] and pairs(g.find_edge(2, 2)) == [(0, 2)]
    assert g.add_vertices(spark.createDataFrame([(0, "again", 0, False), (7, "new", 1, False)], g.vertices.schema)).vertices.count() == 7
    deg = {r["ordinal"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(g.vertices, g.edges).collect()}
    assert deg[2] == (2, 0) and deg[0] == (0, 2) and deg[5] == (0, 0)
    asked = spark.createDataFrame([(2, 1), (2, 0), (1, 2)], "child long, parent long")
    assert {(r["child"], r["parent"]): r["is_descendant"] for r in graph.is_descendant(g.edges, asked).collect()} == {(2, 1): True, (2, 0): True, (1, 2): False}
    w = {(r["from_ord"], r["to_ord"]): r["weight"] for r in graph.edge_weights(g.edges, edge((0, 1), (1, 1), (2, 1))).collect()}
    assert w == {(0, 1): 1.5, (1, 1): 0.0, (2, 1): graph.NO_EDGE}
    assert [r["ordinal"] for r in g.rendered().collect()] == [0, 4, 1, 5, 2, 3]
    assert graph.incident(g.edges).count() == 6


@pytest.mark.parametrize(("edges", "cyclic"), [([], False), ([(0, 0)], True), ([(0, 1), (1, 2), (2, 1)], True), ([(0, 1), (1, 2), (2, 3), (0, 3)], False), ([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], True)])
def test_cycles(spark, edges, cyclic):
    assert dag(spark, edges).has_cycle() is cyclic


# Typicality


def features(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "source_id long, data string")


def brute_typicality(texts, h=0.3):
    n = len(texts)
    t1 = math.sqrt(2 * math.pi) / (n - 1) if n > 1 else math.inf
    k = lambda a, b: math.exp(-(likeness(a, b) ** 2) / (2 * h * h))
    return [t1 * (k(texts[i], texts[i]) + 2 * sum(k(texts[i], texts[j]) for j in range(n) if j != i)) for i in range(n)]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text("abcd ", min_size=1, max_size=12), min_size=2, max_size=9))
def test_typicality_against_brute_force(spark, texts):
    got = {r["source_id"]: r["score"] for r in typicality.typicality(features(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_typicality(texts), abs=1e-5)


def test_pair_scores_cover_every_pair_once(spark):
    f = features(spark, [f"text {k}" for k in range(30)])
    got = [(r["i"], r["j"]) for r in typicality.pair_scores(f, block_rows=4).collect()]
    assert sorted(got) == [(i, j) for i, j in product(range(30), repeat=2) if i < j]


def test_typical_edge_cases(spark):
    plain = Processor(lambda s: s)
    assert typicality.top_typical(features(spark, []).limit(0), 3, processor=plain).count() == 0
    assert typicality.top_typical(features(spark, ["a", "b"]), 0, processor=plain).count() == 0
    assert typicality.typicality(features(spark, ["a"])).first()["score"] == math.inf
    best = typicality.top_typical(features(spark, ["abc", "", "abd"]), 1, processor=plain).first()
    assert best["source_id"] == 1 and math.isnan(best["score"])


def test_regions_fold_like_the_sequential_rule(spark):
    texts = ["sort the list", "sort a list", "tree walk", "walk the tree", "list of lists", "sorted tree", "hash map", "a tree"]
    order = [2, 0, 6]
    typical = spark.createDataFrame([(s, r + 1) for r, s in enumerate(order)], "source_id long, rank int")
    for compat in (True, False):
        want = {}
        for e in (k for k in range(len(texts)) if k not in order):
            held = order[0]
            for o in order[1:]:
                if likeness(texts[e], texts[o]) > (likeness(texts[held], texts[o]) if compat else likeness(texts[e], texts[held])):
                    held = o
            want[e] = held
        got = {r["member_id"]: r["rep_id"] for r in typicality.regions(features(spark, texts), typical, compat=compat).collect()}
        assert got == want
    none = typicality.regions(features(spark, texts), typical.limit(0))
    assert {r["rep_id"] for r in none.collect()} == {None} and none.count() == 8
    lists = {r["rep_id"]: r["members"] for r in typicality.region_lists(typicality.regions(features(spark, texts), typical)).collect()}
    assert sorted(m for x in lists.values() for m in x) == [1, 3, 4, 5, 7]


def test_representatives(spark):
    texts = ["sort the list", "sort a list", "tree walk", "walk the tree", "list of lists", "sorted tree", "hash map", "a tree"]
    plain = Processor(lambda s: s)
    rows = typicality.representatives(features(spark, texts), 3, plain).orderBy("rank").collect()
    assert sum(r["size"] for r in rows) == 5 and [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True)
    assert typicality.representatives(features(spark, texts), 8, plain).count() == 0


# Files


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "A.java").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "deep" / "ATestOftest.java").write_text("x")
    (tmp_path / "deep" / "BTest.java").write_text("y\n\n")
    (tmp_path / "notes.txt").write_text("z")
    found = files.collect_files(spark, str(tmp_path), "java", ["test", "Test"])
    sources = {r["name"]: r["content"] for r in files.file_sources(found).collect()}
    assert sources == {"A": "one\ntwo", "BTest": "y\n"}
    assert files.collect_files(spark, str(tmp_path), "java").count() == 3
    assert files.read_lines(spark, str(tmp_path / "notes.txt")).first()["value"] == "z"
    entries = spark.createDataFrame([(f"{tmp_path}/A.java::sort(int[] a)::void",), (f"{tmp_path}/deep/BTest.java",)], "line string")
    chosen, relevant = files.populate(entries, files.collect_files(spark, str(tmp_path), "java"))
    assert {r["name"] for r in chosen.collect()} == {"A", "BTest"} and [r["name"] for r in relevant.collect()] == ["sort"]
    numbered = files.content_lines(files.table_sources(spark.createDataFrame([(7, "a\r\nb\n")], "id long, t string"), "id", "t"))
    assert [(r["source_id"], r["line_no"], r["line"]) for r in numbered.orderBy("line_no").collect()] == [(7, 0, "a"), (7, 1, "b"), (7, 2, "")]


def test_sinks(spark, tmp_path, capsys):
    results = spark.createDataFrame([(1, "A", "code\nmore"), (2, "B", None)], "rank int, name string, snippet string")
    out = files.write_snippets(results, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(out).collect()].count("A:") == 1
    assert files.print_snippets(results) == ["A\ncode\nmore\n", "B\n\n"]
    assert files.print_concepts(spark.createDataFrame([(2, "b"), (1, "a")], "rank int, word string")) == "[a, b]"
    assert "[a, b]" in capsys.readouterr().out
