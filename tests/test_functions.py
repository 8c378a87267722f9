import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import selection as sel
from textloom.functions import similarity as sim
from textloom.functions import text as tx
from textloom.functions.stop_words import in_any_list, is_stop_word, read_stop_words, stop_list, stop_words


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("entry", "parts"),
    [("a/B.java::sort(int[])::int[]", ["a/B.java", "sort(int[])", "int[]"]), ("a/B.java", ["a/B.java"]), ("::x", ["::x"]), (" a\tb\n", ["ab"]), ("a::b::::", ["a", "b"]), ("a::::b", ["a", "", "b"])],
)
def test_entry_signature(spark, entry, parts):
    assert one(spark, tx.entry_signature(F.col("e")), e=entry) == parts


@pytest.mark.parametrize(
    ("signature", "parts"),
    [("sort(int[] a, List b)", ["sort", "int[]", "a", "List", "b"]), ("main()", ["main", ""]), ("plain", ["plain"]), ("go((List)rest,x  y)", ["go", "List", "rest", "x", "y"]), ("broken(int a", None)],
)
def test_method_signature(spark, signature, parts):
    assert one(spark, tx.method_signature(F.col("s")), s=signature) == parts


def test_replaced_is_one_pass_and_bounded(spark):
    assert one(spark, tx.replaced(F.col("s"), "aa", "a"), s="aaaa") == "aa"
    assert one(spark, tx.replaced(F.col("s"), ".", "!", 2), s="a.b.c.d") == "a!b!c.d"


@pytest.mark.parametrize(
    ("name", "parts"),
    [("processFile", ["process", "File"]), ("XMLFile", ["XML", "File"]), ("a_b", ["a", "b"]), ("createTXTFile2", ["create", "TXT", "File2"]), ("_", []), ("ABC", ["ABC"])],
)
def test_identifier_parts(spark, name, parts):
    assert one(spark, tx.identifier_parts(F.col("n")), n=name) == parts


def test_names_of_interest(spark):
    names = ["ab", "abc", "MyException", "Throwable", "Error", "error", "exception"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").where(tx.is_identifier_of_interest(F.col("n"))).collect()
    assert {r["n"] for r in rows} == {"abc", "error", "exception"}


def test_words_keep_joined_pieces_and_survive_null(spark):
    assert one(spark, tx.words(F.col("t")), t="Don't stop-me now, x@y.z 3.5! été") == ["don't", "stop-me", "now", "x@y.z", "3.5", "été"]
    assert one(spark, tx.words(F.col("t").cast("string")), t=None) == []


def test_flags(spark):
    rows = spark.createDataFrame([(w,) for w in ("txt", "TXT", "AEI", "bad", "", "42", "4a")], "w string").select("w", tx.only_consonants(F.col("w")).alias("c"), tx.is_number(F.col("w")).alias("n")).collect()
    assert {r["w"] for r in rows if r["c"]} == {"txt", "TXT", "AEI", "42"}
    assert {r["w"] for r in rows if r["n"]} == {"42"}


def test_stop_words(spark, tmp_path):
    assert len(stop_list("english")) == 184 and len(stop_list("java")) == 129
    assert stop_words(spark).count() == 313
    rows = spark.createDataFrame([(w,) for w in ("x", "The", "can’t", "class", "sort")], "w string")
    assert {r["w"] for r in rows.where(is_stop_word(F.col("w"))).collect()} == {"x", "The", "can’t", "class"}
    assert {r["w"] for r in rows.where(is_stop_word(F.col("w"), "english")).collect()} == {"x", "The", "can’t"}
    assert rows.where(in_any_list(F.col("w"), [])).count() == 0
    (tmp_path / "list").write_text("One two | a comment\n\n  THREE\n")
    assert {r["word"] for r in read_stop_words(spark, str(tmp_path / "list"), "x").collect()} == {"one", "two", "three"}


def test_similarity_rules(spark):
    pairs = [("text", "txt"), ("", "abc"), ("", ""), ("a", "a"), ("kitten", "sitting"), (None, "a"), ("é", "e")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.distance(F.col("a"), F.col("b")).alias("d"), sim.similarity(F.col("a"), F.col("b")).alias("s"), sim.similarity(F.col("b"), F.col("a")).alias("t")).collect()
    assert [r["d"] for r in rows] == [1, 0, 0, 0, 3, 0, 1]
    assert rows[0]["s"] == rows[0]["t"] == pytest.approx(0.75)
    assert rows[1]["s"] == 1.0 and math.isnan(rows[2]["s"]) and rows[3]["s"] == 1.0 and rows[5]["s"] is None and rows[6]["s"] == 0.0


def test_bandwidths(spark):
    t1, t2 = sim.bandwidths(F.col("n"), 0.3)
    assert one(spark, t1, n=1) == math.inf
    assert one(spark, t1, n=3) == pytest.approx(math.sqrt(2 * math.pi) / 2)
    assert one(spark, t2, n=3) == pytest.approx(0.18)


def spans(*pairs):
    return F.array(*[sel.location(F.lit(a), F.lit(b)) for a, b in pairs]).cast(sel.KIND)


def test_selections(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    a, key = sel.selection(spans((5, 9), (0, 3), (5, 9))), sel.location(F.lit(4), F.lit(8))
    plain = lambda x: [tuple(p) for p in x]
    assert plain(get(a)) == [(0, 3), (5, 9)]
    assert plain(get(sel.add(a, key))) == [(0, 3), (4, 8), (5, 9)]
    assert get(sel.contains(a, key)) is False
    assert tuple(get(sel.ceiling(a, key))) == (5, 9) and tuple(get(sel.floor(a, key))) == (0, 3)
    assert get(sel.ceiling(a, sel.location(F.lit(6), F.lit(7)))) is None
    assert plain(get(sel.delete(a, sel.first(a)))) == [(5, 9)]
    assert plain(get(sel.union(a, spans((5, 9))))) == [(0, 3)]
    assert plain(get(sel.union(a, spans((4, 5))))) == [(0, 3), (4, 5), (5, 9)]
    assert plain(get(sel.intersects(a, spans((5, 9), (1, 2))))) == [(5, 9)]
    assert tuple(get(sel.hull(sel.selection(spans((0, 9), (1, 20), (2, 5)))))) == (0, 9)
    assert tuple(get(sel.hull(a))) == (0, 9)
    assert get(sel.covers(a, key)) is True
    assert get(sel.code(a, F.lit("0123456789abc"))) == "012345678"
    assert get(sel.code(spans(), F.lit("abc"))) is None
    assert get(sel.is_empty(spans())) is True
    assert get(sel.rendered(a)) == "[0,3) [5,9)"
