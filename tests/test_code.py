import os

from pyspark.sql import functions as F

from textloom.cli import all_non_null, all_null, main
from textloom.operators import concepts, segmentation, spelling
from textloom.operators.java_source import methods, parse
from textloom.operators.segmentation import describe

GUARDED = """class Guarded {
   public static void main(String args[]) {
     int first, second;
     try {
       first = 0;
       second = 7 / first;
       show("in the guarded block");
     } catch (ArithmeticException e) {
       show("division by zero");
     }
     show("after the guarded block");
   }

   private static void show(String line){
     System.out.println(line);
   }
}"""
HALVE = """class Halve {
   int times(int value) {
     int n = 0; // how often
     while (value >= 1) {
       value = value / 2;
       n++;
     }
     return n;
   }
}"""
LOADER = """public class Loader {
 public Image loadImage(){
   int n = new CacheCfg().dropException;
   try {
     // nothing to do
     if(n <= 0) {
       throw new IllegalStateException();
     }
   } catch(IllegalStateException e){
     System.err.println(1);
   }

   return readRawImage();
 }

 public Image readRawImage(){
   return new Image("/raw.png");
 }

 public static class CacheCfg {
   final int dropException = 1;
 }
}"""


def sizes(text, *relevant):
    found = describe(text, frozenset(relevant))
    assert found["error"] is None
    return len(found["segments"]), len(found["edges"])


def test_graph_sizes():
    assert sizes(GUARDED, "main") == (5, 6)
    assert sizes(GUARDED) == (6, 7)
    assert sizes(HALVE, "times") == (3, 2)


def test_choice_of_segments():
    found = describe(LOADER, frozenset({"loadImage"}))
    assert [(s["weight"], s["irrelevant"]) for s in found["segments"]] == [(13.0, False), (0.0, False), (0.0, False), (0.0, True), (0.0, True), (3.0, True)]
    assert [(e["from_ord"], e["to_ord"]) for e in found["edges"]] == [(0, 1), (1, 2), (2, 3), (1, 4), (1, 5)]
    assert found["segments"][0]["is_root"] and not found["segments"][1]["is_root"]


def test_small_units_and_errors():
    assert not any(s["irrelevant"] for s in describe("class A { void f() { g(); } void g() { h(); } }", frozenset({"f"}))["segments"])
    assert describe("interface A { void f(); }", frozenset())["error"] == "method f has no body"
    assert describe("class A { void f() {", frozenset())["error"]
    assert describe("class A { }", frozenset({"f"}))["error"] == "no such method"
    assert describe("", frozenset())["segments"] == []
    cyclic = "class A {\n void f() {\n if (x) {\n if (y) {\n f();\n }\n }\n }\n}"
    assert describe(cyclic, frozenset())["error"] == "calls between blocks form a cycle"
    assert describe("class A {\n int f(int n) {\n  return n < 1 ? 0 : f(n - 1);\n }\n}", frozenset())["error"] is None


def test_javadoc_above_a_method_counts_to_it():
    text = "class A {\n /** says\n  * much\n  */\n int f(int n) {\n  if (n > 0) {\n   n--;\n  }\n  return n;\n }\n}"
    found = describe(text, frozenset({"f"}))
    assert found["unit"]["start_line"] == 2 and found["segments"][0]["irrelevant"]
    kept = describe(text, frozenset({"f"}), compat=False)
    assert not kept["segments"][0]["irrelevant"]


def test_parser_reads_what_java_has():
    text = """package a.b; import java.util.*;
    @Deprecated(since = "1") public abstract class A<T extends Comparable<T>> extends B implements C, D {
      static { int[] a = {1, 2}; }
      enum Kind { ONE(1) { int f() { return 2; } }, TWO; int f() { return 1; } }
      @interface Note { int value() default 3; }
      private final java.util.Map<String, List<int[]>> m = new HashMap<>();
      abstract void none(int... xs) throws E;
      A(int x) { this.x = x; super.go(); }
      <R> R twice(Function<T, R> f, T[] xs) {
        outer: for (T t : xs) { do { continue outer; } while (f.apply(t) == null); }
        switch (xs.length) { case 1: return null; default: break; }
        synchronized (this) { Runnable r = () -> { go(); }; r.run(); }
        Object o = new Object() { public String toString() { return "a{b"; } };
        for (int i = 0, j = 1; i < j; i++) ;
        int k = a > b ? c : d; char q = '}'; assert k > 0 : "no";
        class Local { void inner() { } }
        try (In in = open()) { in.read(); } finally { close(); }
        return (R) (Object) xs[0].toString();
      }
    }"""
    assert [m.name for m in methods(parse(text))] == ["f", "f", "value", "none", "A", "twice", "toString", "inner"]


def frame(spark, *texts):
    return spark.createDataFrame([(k, f"n{k}", t) for k, t in enumerate(texts)], "source_id long, name string, content string")


WORDS = {"image": 9, "load": 5, "read": 6, "raw": 2, "cache": 3, "configuration": 4, "loader": 1}


def test_concepts(spark):
    sources = frame(spark, LOADER, GUARDED, "not java {", None)
    dictionary = spark.createDataFrame([*WORDS.items(), ("cfgs", 1)], "word string, freq long")
    one = concepts.source_concepts(sources, dictionary, ["loadImage"])
    words = {r["word"] for r in one.where("source_id = 0").collect()}
    assert words >= {"image", "load", "read", "raw", "cache"} and not words & {"err", "println", "system"}
    assert one.where("source_id <> 0").count() == 0
    assert concepts.corpus_concepts(sources, None, k=3).count() == 3


def test_code_of_units_and_segments(spark):
    sources = frame(spark, LOADER, HALVE)
    parsed = segmentation.parse_sources(sources, ["loadImage"])
    code = {r["source_id"]: r for r in segmentation.segments_code(sources, parsed).collect()}
    assert code[0]["data"].startswith("public Image loadImage(){") and code[0]["data"].endswith("}")
    assert code[1]["data"] == "" and code[1]["error"] == "no such method"
    units = {r["source_id"]: r["data"] for r in segmentation.unit_code(sources, parsed).collect()}
    assert units[0] == code[0]["data"] and units[1] is None
    assert segmentation.units(parsed).where("kind = 'method'").count() == 3
    assert segmentation.edges(parsed).count() == 5


def test_spans_cover(spark):
    tokens = spark.createDataFrame([(1, 0, 3), (1, 5, 6), (2, 0, 3)], "source_id long, start_off int, end_off int")
    spans = spark.createDataFrame([(1, 0, 4)], "source_id long, start_off int, end_off int")
    assert sorted((r["source_id"], r["start_off"]) for r in segmentation.outside(tokens, spans).collect()) == [(1, 5), (2, 0)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name, text in (("Loader", LOADER), ("Guarded", GUARDED), ("Halve", HALVE)):
        (tmp_path / f"{name}.java").write_text(text)
    (tmp_path / "entries.txt").write_text(f"{tmp_path}/Loader.java::loadImage()::Image\n")
    assert all_null(None, None) and all_non_null(2, 1, 2) and not all_non_null(2, 1, None)
    assert main(["concepts"], spark) == -1 and main(["concepts", "-d", str(tmp_path), "-k", "0"], spark) == -1
    assert main(["concepts", "-d", str(tmp_path), "-k", "3"], spark) == 0
    assert capsys.readouterr().out.startswith("[")
    assert main(["concepts", "-f", str(tmp_path / "entries.txt"), "-d", "/nowhere"], spark) == 0
    assert "image" in capsys.readouterr().out
    assert main(["typical"], spark) == -1 and main(["typical", "-t", "a", "-f", "b", "-d", "c"], spark) == -1
    assert main(["typical", "-d", str(tmp_path)], spark) == 0
    assert os.path.exists("typicalset.txt")
    assert main(["typical", "-d", str(tmp_path), "-e"], spark) == 0 and not os.path.exists("typicalset.txt")
    assert main(["represent", "-t", *[str(tmp_path / f"{n}.java") for n in ("Loader", "Guarded", "Halve")]], spark) == 0


def test_catalogue_agrees_with_sql(spark):
    import duckdb

    from textloom.plans.catalogue import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders events documents pages benchmark labels".split():
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in QUERIES:
        got = QUERIES[name](spark, folder)
        columns = sorted(got.columns)
        rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
        if name in SQL:
            want = con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
            assert rows == sorted((tuple(map(plain, r)) for r in want), key=repr), name
        else:
            assert rows, name


def test_spell_dictionary_of_code(spark):
    assert spelling.build_dictionary(frame(spark, LOADER), "content").where("word = 'image'").first()["freq"] == 6
    assert frame(spark, LOADER).select(F.length("content")).first()[0] == len(LOADER)
