"""Every query of the engine's own operators over the test tables, with the SQL that it must agree with."""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import selection as sel
from textloom.functions import similarity as sim
from textloom.functions import text as tx
from textloom.functions.stop_words import in_any_list, stop_list, stop_words
from textloom.operators import concepts, counting, graph, segmentation, spelling, typicality
from textloom.sources import files
from textloom.tables import shared_dir, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that several oracles share.
_WORD = r"[@+\p{L}\p{Nd}]+(?:[-.:/''\x{2019}\p{M}\x{2032}\x{A0}\x{200C}\x{200D}~]+[@+\p{L}\p{Nd}]+)*"
_WORDS = f"SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}'))) AS word FROM documents"
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_list())
_IS_STOP = f"(length(word) = 1 OR lower(replace(word, '’', '''')) IN ({_STOPS}))"
_CAMEL = "list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')"
_SPLIT = "list_filter(string_split(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([^A-Z_])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: x <> '' AND x <> ' ')"
_ODD = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüÁÀÂÎÔÛ"
#: The edit distance of DuckDB counts bytes; letters of two bytes are exchanged for signs that no text has.
_PLAIN = f"translate(text, '{_ODD}', " + " || ".join(f"chr({k + 1 if k < 8 else k + 6})" for k in range(len(_ODD))) + ")"
_DISTANCE = "CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE levenshtein(a, b) END"
_SIMILAR = f"CAST(CAST(1.0 AS DOUBLE) - CAST(CAST(({_DISTANCE}) AS DOUBLE) / greatest(length(a), length(b)) AS FLOAT) AS FLOAT)"
_BENCHMARK = f"feature AS (SELECT item_id AS source_id, {_PLAIN} AS data FROM benchmark)"
_TYPICAL = f"""
    WITH {_BENCHMARK},
    scored AS (SELECT source_id, j, {_SIMILAR} AS s FROM (SELECT x.source_id, y.source_id AS j, x.data AS a, y.data AS b FROM feature x, feature y)),
    total AS (SELECT count(*) AS n FROM feature),
    typical AS (SELECT source_id, sqrt(2 * pi()) / (n - 1) * sum(CASE WHEN source_id = j THEN 1 ELSE 2 END * exp(-pow(CAST(s AS DOUBLE), 2) / 0.18)) AS score
                FROM scored, total GROUP BY source_id, n)"""
_EDGES = """
    edge AS (SELECT r_regionkey AS from_ord, 1000 + n_nationkey AS to_ord, 1.0 AS weight FROM nation JOIN region ON r_regionkey = n_regionkey
             UNION ALL SELECT 1000 + c_nationkey, 1000000 + c_custkey, 2.0 FROM customer)"""
_VERTICES = "vertex AS (SELECT r_regionkey AS ordinal FROM region UNION ALL SELECT 1000 + n_nationkey FROM nation UNION ALL SELECT 1000000 + c_custkey FROM customer)"
_SELECTIONS = """
    chosen AS (SELECT o_custkey AS cust, list_sort(list_distinct(list({'start': CAST(o_orderkey % 50 AS INT), 'end': CAST(o_orderkey % 50 + o_orderkey % 7 + 1 AS INT)}))) AS a,
                      list_sort(list_distinct(list({'start': CAST(o_orderkey % 40 AS INT), 'end': CAST(o_orderkey % 40 + o_orderkey % 5 + 1 AS INT)}))) AS b
               FROM orders GROUP BY o_custkey)"""


# Sources


@query("SELECT page_id, url FROM pages WHERE NOT (contains(url, 'th') AND contains(url, 'en'))")
def scan_filter(spark, sf_dir):
    """Files whose name has every keyword go."""
    return files.drop_named(_read(spark, sf_dir, "pages"), ["th", "en"], "url").select("page_id", "url")


@query("SELECT doc_id, CAST(k - 1 AS INT) AS line_no, parts[k] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents))")
def content_lines(spark, sf_dir):
    """Lines of every document."""
    return files.content_lines(files.table_sources(_read(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("source_id", "doc_id")


@query("SELECT lang, word FROM (VALUES " + ", ".join(f"('{name}', '{w.replace(chr(39), chr(39) * 2)}')" for name in ("english", "java") for w in stop_list(name)) + ") AS t(lang, word)")
def stop_word_lists(spark, sf_dir):
    """Both lists."""
    return stop_words(spark)


# Entries

_ENTRY = "concat(url, '::go', page_id, '(int[] a,  (List) rest,String  b)::void')"


@query(f"SELECT page_id, array_to_string(string_split({_ENTRY}, '::'), '|') AS parts, len(string_split({_ENTRY}, '::')) = 1 AS is_single FROM pages")
def entry_signature(spark, sf_dir):
    """R1, R3, R4."""
    parts = tx.entry_signature(F.expr(_ENTRY))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(parts, "|").alias("parts"), tx.is_single(parts).alias("is_single"))


@query("SELECT page_id, 'go' || page_id || '|int[]|a|List||String|b' AS parts FROM pages")
def method_signature(spark, sf_dir):
    """R2, R5."""
    parts = tx.method_signature(F.element_at(tx.entry_signature(F.expr(_ENTRY)), 2))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(parts, "|").alias("parts"))


# Words

_NAME = "array_join(transform(split(p_name, ' '), x -> initcap(x)), '')"


@query(f"SELECT p_partkey, array_to_string({_SPLIT.replace('{0}', 'name')}, '|') AS pieces FROM (SELECT p_partkey, {_CAMEL} || '_XMLFile' AS name FROM part)")
def camel_split(spark, sf_dir):
    """T5, T6."""
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.identifier_parts(F.expr(f"{_NAME} || '_XMLFile'")), "|").alias("pieces"))


@query(f"SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN {_CAMEL} || 'Exception' WHEN p_size % 3 = 1 THEN 'Error' ELSE {_CAMEL} END AS name FROM part) WHERE length(name) > 2 AND NOT (suffix(name, 'Exception') OR name IN ('Throwable', 'Error'))")
def identifiers_of_interest(spark, sf_dir):
    """T3, T4."""
    name = F.expr(f"CASE WHEN p_size % 3 = 0 THEN {_NAME} || 'Exception' WHEN p_size % 3 = 1 THEN 'Error' ELSE {_NAME} END")
    return _read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(tx.is_identifier_of_interest(F.col("name")))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda x: lower(x)) AS w FROM documents)")
def word_iter(spark, sf_dir):
    """The words of every document, digested."""
    words = tx.words(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ").cast("binary")).alias("words_md5"))


@query(f"SELECT DISTINCT word, regexp_full_match(word, '[^aeiou]+') AS only_consonants, regexp_full_match(word, '[0-9]+') AS is_number, {_IS_STOP} AS is_stop FROM ({_WORDS})")
def word_flags(spark, sf_dir):
    """T9-T12."""
    words = counting.prose_words(_read(spark, sf_dir, "documents")).select("word").distinct()
    return words.select("word", tx.only_consonants(F.col("word")).alias("only_consonants"), tx.is_number(F.col("word")).alias("is_number"), in_any_list(F.col("word"), ["english", "java"]).alias("is_stop"))


# Counting


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word")
def word_count(spark, sf_dir):
    """A2, A3, no stop words."""
    return counting.count_words(counting.prose_words(_read(spark, sf_dir, "documents")), [])


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE NOT {_IS_STOP} GROUP BY word")
def word_count_nostop(spark, sf_dir):
    """A2, A14, T11."""
    return counting.count_words(counting.prose_words(_read(spark, sf_dir, "documents")))


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE NOT {_IS_STOP} GROUP BY word ORDER BY n DESC, word LIMIT 25")
def top_words(spark, sf_dir):
    """A6, A7."""
    return counting.most_frequent(word_count_nostop(spark, sf_dir), 25)


_TOP10 = f"SELECT doc_id, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INT) AS rank FROM (SELECT doc_id, word, count(*) AS n FROM ({_WORDS}) WHERE NOT {_IS_STOP} GROUP BY ALL)) WHERE rank <= 10"


@query(_TOP10)
def doc_top10(spark, sf_dir):
    """A8."""
    return counting.prose_tops(_read(spark, sf_dir, "documents"))


@query(f"SELECT word, count(*) AS n FROM ({_TOP10}) GROUP BY word ORDER BY n DESC, word LIMIT 10")
def corpus_concepts(spark, sf_dir):
    """The words most documents are about."""
    return counting.prose_concepts(_read(spark, sf_dir, "documents"))


@query(f"SELECT word, count(*) AS n FROM ({_WORDS} UNION ALL {_WORDS.replace('doc_id', 'item_id').replace('documents', 'benchmark')}) WHERE NOT {_IS_STOP} GROUP BY word")
def counter_combine(spark, sf_dir):
    """A4: counters of two tables, merged."""
    of = lambda name, id_: counting.count_words(counting.prose_words(_read(spark, sf_dir, name), id_))
    return counting.combine(of("documents", "doc_id"), of("benchmark", "item_id"))


@query(f"SELECT count(*) AS n FROM ({_WORDS})")
def items_count(spark, sf_dir):
    """A5."""
    return counting.items_count(counting.prose_words(_read(spark, sf_dir, "documents")))


@query("SELECT user_id, CAST(least(n, 4 // 3) * 3 AS BIGINT) AS by_threes, CAST(least(n, 9) AS BIGINT) AS by_ones FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def saturating_counter(spark, sf_dir):
    """A1: increments that would reach the bound are dropped."""
    counts = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", counting.saturated(F.col("n"), 3, 5).cast("long").alias("by_threes"), counting.saturated(F.col("n"), 1, 10).cast("long").alias("by_ones"))


# Spelling

_PIECES = f"SELECT unnest({_SPLIT.replace('{0}', 'name')}) AS word FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\w+')) AS name FROM documents)"
_DICTIONARY = f"dictionary AS (SELECT lower(word) AS word, count(*) AS freq FROM ({_PIECES}) WHERE length(word) > 2 AND NOT regexp_full_match(word, '[^aeiou]+') AND NOT regexp_full_match(word, '[0-9]+') AND NOT {_IS_STOP} GROUP BY 1)"
_ASKED = f"asked AS (SELECT DISTINCT word FROM ({_WORDS.replace('doc_id', 'item_id').replace('documents', 'benchmark')}))"


def _dictionary(spark, sf_dir):
    return spelling.build_dictionary(_read(spark, sf_dir, "documents"))


def _asked(spark, sf_dir):
    return counting.prose_words(_read(spark, sf_dir, "benchmark"), "item_id").select("word").distinct()


@query(f"WITH {_DICTIONARY} SELECT word, freq FROM dictionary")
def dictionary(spark, sf_dir):
    """D1."""
    return _dictionary(spark, sf_dir)


@query(f"WITH {_DICTIONARY}, {_ASKED} SELECT word FROM asked WHERE word IN (SELECT word FROM dictionary)")
def in_dictionary(spark, sf_dir):
    """D2."""
    return spelling.in_dictionary(_asked(spark, sf_dir), _dictionary(spark, sf_dir))


@query(rf"""WITH {_DICTIONARY}, {_ASKED}, letters AS (SELECT chr(CAST(97 + unnest(range(26)) AS INT)) AS c),
    cut AS (SELECT word, unnest(range(length(word) + 1)) AS k FROM asked),
    made AS (
      SELECT word, left(word, k) || substr(word, k + 2) AS candidate FROM cut WHERE k < length(word)
      UNION SELECT word, left(word, k) || c || substr(word, k + 2) FROM cut, letters WHERE k < length(word)
      UNION SELECT word, left(word, k) || c || substr(word, k + 1) FROM cut, letters
      UNION SELECT word, left(word, k) || substr(word, k + 2, 1) || substr(word, k + 1, 1) || substr(word, k + 3) FROM cut WHERE k < length(word) - 1)
    SELECT made.word, candidate, freq FROM made JOIN dictionary ON candidate = dictionary.word""")
def edit1_in_dict(spark, sf_dir):
    """D3, D4."""
    return spelling.known_mutations(_asked(spark, sf_dir), _dictionary(spark, sf_dir)).select("word", "candidate", "freq")


#: Only beginnings that are asked for are made of dictionary words.
_PREFIXED = """
    wanted AS (SELECT DISTINCT unnest([word, left(word, length(word) - 1)]) AS prefix FROM asked),
    best AS (SELECT prefix, arg_min(word, {'f': -freq, 'w': word}) AS candidate
             FROM (SELECT word, freq, unnest(list_transform(range(length(word) + 1), lambda k: left(word, k))) AS prefix FROM dictionary) SEMI JOIN wanted USING (prefix) GROUP BY prefix),
    prefixed AS (SELECT asked.word, coalesce(one.candidate, two.candidate) AS candidate FROM asked
                 LEFT JOIN best one ON one.prefix = asked.word LEFT JOIN best two ON two.prefix = left(asked.word, length(asked.word) - 1))"""


@query(f"WITH {_DICTIONARY}, {_ASKED}, {_PREFIXED} SELECT word, candidate FROM prefixed")
def prefix_correct(spark, sf_dir):
    """D6, D7."""
    return spelling.prefix_correction(_asked(spark, sf_dir), _dictionary(spark, sf_dir))


def _plain(column: str) -> str:
    return _PLAIN.replace("text", column, 1)


_LIKE = _SIMILAR.replace("(a", "({0}").replace("(b", "({1}").replace(", b", ", {1}")


@query(rf"""WITH {_DICTIONARY}, {_ASKED}, {_PREFIXED},
    odd AS (SELECT word, {_plain('word')} AS a FROM asked ANTI JOIN dictionary USING (word) WHERE regexp_full_match(word, '[^aeiou]+')),
    letters AS (SELECT i, chr(CAST(97 + i AS INT)) AS c FROM (SELECT unnest(range(26)) AS i)),
    cut AS (SELECT word, unnest(range(length(word) + 1)) AS k FROM odd),
    made AS (
      SELECT word, left(word, k) || substr(word, k + 2) AS candidate, 0 AS kind, k, 0 AS i FROM cut WHERE k < length(word)
      UNION ALL SELECT word, left(word, k) || c || substr(word, k + 2), 1, k, i FROM cut, letters WHERE k < length(word)
      UNION ALL SELECT word, left(word, k) || c || substr(word, k + 1), 2, k, i FROM cut, letters
      UNION ALL SELECT word, left(word, k) || substr(word, k + 2, 1) || substr(word, k + 1, 1) || substr(word, k + 3), 3, k, 0 FROM cut WHERE k < length(word) - 1),
    one AS (SELECT made.word, arg_min(candidate, {{'f': -freq, 't': kind, 'k': k, 'i': i}}) AS candidate FROM made JOIN dictionary ON candidate = dictionary.word GROUP BY made.word),
    two AS (SELECT odd.word, arg_min(d.word, {{'f': -freq, 'w': d.word}}) AS candidate
            FROM odd JOIN (SELECT word, freq, {_plain('word')} AS b FROM dictionary) d ON abs(length(a) - length(b)) <= 2 AND damerau_levenshtein(a, b) <= 2 GROUP BY odd.word),
    choice AS (SELECT word, candidate FROM prefixed UNION SELECT word, candidate FROM one UNION SELECT word, candidate FROM two),
    scored AS (SELECT word, candidate, {_LIKE.format(_plain('word'), _plain('candidate'))} AS likeness FROM choice SEMI JOIN odd USING (word) WHERE candidate IS NOT NULL),
    likest AS (SELECT word, arg_min(candidate, {{'s': -likeness, 'w': candidate}}) AS candidate FROM scored GROUP BY word),
    fixed AS (SELECT asked.word, CASE WHEN asked.word IN (SELECT word FROM dictionary) THEN asked.word ELSE coalesce(likest.candidate, prefixed.candidate, asked.word) END AS corrected
              FROM asked LEFT JOIN likest USING (word) LEFT JOIN prefixed USING (word))
    SELECT word, corrected, CASE WHEN {_LIKE.format(_plain('word'), _plain('corrected'))} > CAST(0.3 AS FLOAT) THEN corrected ELSE word END AS accepted FROM fixed""")
def spell_correct(spark, sf_dir):
    """Every word of the benchmark, corrected against the documents' words."""
    fixed = spelling.correct(_asked(spark, sf_dir), _dictionary(spark, sf_dir))
    return fixed.withColumn("accepted", spelling.accepted(F.col("word"), F.col("corrected")))


# Likeness


def _features(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), F.col("text").alias("data"))


@query(f"""WITH {_BENCHMARK} SELECT i, j, CAST({_DISTANCE} AS INT) AS distance, round(CAST({_SIMILAR} AS DOUBLE), 6) AS similarity
    FROM (SELECT x.source_id AS i, y.source_id AS j, x.data AS a, y.data AS b FROM feature x JOIN feature y ON x.source_id < y.source_id)""")
def pair_scores(spark, sf_dir):
    """M1-M4, Q12."""
    both = typicality.pair_scores(_features(spark, sf_dir), lambda a, b: F.struct(sim.distance(a, b).alias("d"), sim.similarity(a, b).alias("s")))
    return both.select("i", "j", F.col("score.d").cast("int").alias("distance"), F.round(F.col("score.s").cast("double"), 6).alias("similarity"))


@query(f"{_TYPICAL} SELECT source_id, round(score, 6) AS score FROM typical")
def typicality_scores(spark, sf_dir):
    """M5, M6, A10."""
    return typicality.typicality(_features(spark, sf_dir)).select("source_id", F.round("score", 6).alias("score"))


def _typical(spark, sf_dir, k=5):
    plain = typicality.Processor(lambda sources: sources)
    return typicality.top_typical(_features(spark, sf_dir), k, processor=plain)


@query(f"{_TYPICAL} SELECT source_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, source_id) AS INT) AS rank FROM typical QUALIFY rank <= 5")
def typicality_topk(spark, sf_dir):
    """Q8-Q11."""
    return _typical(spark, sf_dir).select("source_id", F.round("score", 6).alias("score"), "rank")


_FOLD = f"""{_TYPICAL.replace('WITH', 'WITH RECURSIVE', 1)},
    rep AS (SELECT source_id, data, row_number() OVER (ORDER BY score DESC, source_id) AS rank FROM typical JOIN feature USING (source_id) QUALIFY rank <= 5),
    fold AS (
      SELECT f.source_id AS member_id, f.data AS own, r.source_id AS rep_id, r.data AS held, 1 AS step FROM feature f, rep r WHERE r.rank = 1 AND f.source_id NOT IN (SELECT source_id FROM rep)
      UNION ALL
      SELECT member_id, own, CASE WHEN {_SIMILAR.replace('(a', '(own').replace('(b', '(x.data').replace(', b', ', x.data')} > {_SIMILAR.replace('(a', '(held').replace('(b', '(x.data').replace(', b', ', x.data')} THEN x.source_id ELSE rep_id END,
             CASE WHEN {_SIMILAR.replace('(a', '(own').replace('(b', '(x.data').replace(', b', ', x.data')} > {_SIMILAR.replace('(a', '(held').replace('(b', '(x.data').replace(', b', ', x.data')} THEN x.data ELSE held END, step + 1
      FROM fold JOIN rep x ON x.rank = step + 1),
    region AS (SELECT rep_id, member_id FROM fold WHERE step = (SELECT max(rank) FROM rep))"""


@query(f"{_FOLD} SELECT rep_id, member_id FROM region")
def region_fold(spark, sf_dir):
    """Q14-Q16."""
    return typicality.regions(_features(spark, sf_dir), _typical(spark, sf_dir).select("source_id", "rank"))


@query(f"{_FOLD} SELECT rep_id, count(*) AS size, string_agg(CAST(member_id AS VARCHAR), ',' ORDER BY member_id) AS members FROM region GROUP BY rep_id")
def region_members(spark, sf_dir):
    """A11, A13."""
    listed = typicality.region_lists(region_fold(spark, sf_dir))
    return listed.select("rep_id", F.size("members").cast("long").alias("size"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"{_FOLD} SELECT rep_id, size, CAST(row_number() OVER (ORDER BY size DESC, rank) AS INT) AS rank FROM (SELECT rep_id, count(*) AS size FROM region GROUP BY rep_id) r JOIN rep ON rep.source_id = rep_id")
def representatives(spark, sf_dir):
    """A12, Q17, Q18."""
    return typicality.representatives(_features(spark, sf_dir), processor=typicality.Processor(lambda sources: sources))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    """Q16."""
    return _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels"), "doc_id", "left_anti").distinct()


# Graphs: regions to nations to customers


def _dag(spark, sf_dir) -> graph.Dag:
    region, nation, customer = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    vertex = lambda df, ordinal, label, depth: df.select(F.expr(ordinal).cast("long").alias("ordinal"), F.col(label).alias("label"), F.lit(depth).alias("depth"), F.lit(False).alias("is_root"))
    vertices = vertex(region, "r_regionkey", "r_name", 0).unionByName(vertex(nation, "1000 + n_nationkey", "n_name", 1)).unionByName(vertex(customer, "1000000 + c_custkey", "c_name", 2))
    edges = nation.select(graph.edge(F.col("n_regionkey"), F.col("n_nationkey") + 1000, 1.0).alias("e")).unionByName(customer.select(graph.edge(F.col("c_nationkey") + 1000, F.col("c_custkey") + 1000000, 2.0).alias("e"))).select("e.*")
    return graph.Dag(vertices, edges.limit(0)).add_edges(edges, check=False)


@query(f"WITH {_EDGES}, {_VERTICES} SELECT ordinal, (SELECT count(*) FROM edge WHERE to_ord = ordinal) AS in_degree, (SELECT count(*) FROM edge WHERE from_ord = ordinal) AS out_degree FROM vertex")
def degrees(spark, sf_dir):
    """G2, G5, G11, G17."""
    dag = _dag(spark, sf_dir)
    return graph.degrees(dag.vertices, dag.edges)


@query(f"WITH {_EDGES} SELECT from_ord AS ordinal, from_ord, to_ord FROM edge UNION SELECT to_ord, from_ord, to_ord FROM edge")
def incident_edges(spark, sf_dir):
    """G9."""
    return graph.incident(_dag(spark, sf_dir).edges)


@query(f"WITH {_VERTICES} SELECT count(*) AS vertices, 5 AS labels_kept FROM vertex")
def add_vertices(spark, sf_dir):
    """Vertices that are there already change nothing, whatever their label."""
    dag = _dag(spark, sf_dir)
    again = dag.vertices.where("depth = 0").withColumn("label", F.lit("other"))
    both = dag.add_vertices(again).add_vertices(again).vertices
    return both.agg(F.count("*").alias("vertices"), F.count_if((F.col("depth") == 0) & (F.col("label") != "other")).cast("int").alias("labels_kept"))


@query(f"""WITH {_EDGES}, {_VERTICES}, asked AS (SELECT DISTINCT o_custkey % 60 + 990 AS a, 1000000 + o_custkey AS b FROM orders)
    SELECT 'vertex' AS kind, a AS from_ord, a AS to_ord FROM (SELECT DISTINCT a FROM asked) SEMI JOIN vertex ON a = ordinal
    UNION ALL SELECT 'edge', a, b FROM asked SEMI JOIN edge ON from_ord = a AND to_ord = b""")
def contained(spark, sf_dir):
    """Which of some vertices and edges the graph has."""
    dag = _dag(spark, sf_dir)
    asked = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 60 + 990).cast("long").alias("from_ord"), (F.col("o_custkey") + 1000000).cast("long").alias("to_ord")).distinct()
    known = dag.contains_vertices(asked.select(F.col("from_ord").alias("ordinal")).distinct())
    return known.select(F.lit("vertex").alias("kind"), F.col("ordinal").alias("from_ord"), F.col("ordinal").alias("to_ord")).unionByName(dag.contains_edges(asked).select(F.lit("edge").alias("kind"), "from_ord", "to_ord"))


@query(f"""WITH {_EDGES}, {_VERTICES} SELECT 'root' AS what, 2 AS from_ord, NULL AS to_ord UNION ALL SELECT 'label', 1000 + min(n_nationkey), NULL FROM nation WHERE n_name = 'NATION_7'
    UNION ALL SELECT 'place', 1003, NULL UNION ALL SELECT 'edge', from_ord, to_ord FROM edge WHERE to_ord = 1009
    UNION ALL SELECT 'size', count(*), NULL FROM edge UNION ALL SELECT 'weight', CAST(sum(weight) AS BIGINT), NULL FROM edge""")
def lookups(spark, sf_dir):
    """The root, a vertex by label and by place, an edge by its ends, how many edges there are."""
    dag = _dag(spark, sf_dir).set_root(2)
    ends = F.lit(None).cast("long").alias("to_ord")
    found = {"root": dag.root(), "label": dag.by_label("NATION_7"), "place": dag.at(1003)}
    out = dag.find_edge(1009, 1009).select(F.lit("edge").alias("what"), "from_ord", "to_ord")
    for what, rows in found.items():
        out = out.unionByName(rows.select(F.lit(what).alias("what"), F.col("ordinal").alias("from_ord"), ends))
    weight = dag.edges.agg(F.sum("weight").cast("long").alias("from_ord")).select(F.lit("weight").alias("what"), "from_ord", ends)
    return out.unionByName(spark.range(1).select(F.lit("size").alias("what"), F.lit(dag.size()).cast("long").alias("from_ord"), ends)).unionByName(weight)


@query(f"WITH {_VERTICES} SELECT ordinal, CASE WHEN ordinal < 1000 THEN 2 WHEN ordinal % 2 = 0 THEN 1 ELSE 0 END AS mark, true AS refused FROM vertex")
def marked(spark, sf_dir):
    """Marks of vertices, put on twice; one below 0 is refused."""
    dag = _dag(spark, sf_dir)
    some = dag.marked(dag.vertices.where("ordinal % 2 = 0").select("ordinal", F.lit(1).alias("mark")))
    both = some.marked(dag.vertices.where("depth = 0").select("ordinal", F.lit(2).alias("mark")))
    try:
        both.marked(dag.vertices.select("ordinal", F.lit(-1).alias("mark")))
        refused = False
    except ValueError:
        refused = True
    return both.vertices.select("ordinal", "mark", F.lit(refused).alias("refused"))


@query(f"WITH {_EDGES} SELECT from_ord, to_ord FROM edge WHERE NOT (to_ord >= 1000000 AND to_ord % 3 = 0)")
def remove_edges(spark, sf_dir):
    """Without every third customer's edge."""
    dag = _dag(spark, sf_dir)
    return dag.remove_edges(dag.edges.where("to_ord >= 1000000 and to_ord % 3 = 0")).edges.select("from_ord", "to_ord")


@query("SELECT true AS refused, count(*) + 1 AS edges FROM (SELECT c_custkey FROM customer UNION ALL SELECT n_nationkey FROM nation) t")
def add_edges(spark, sf_dir):
    """An edge that closes a cycle is refused; a repeated one, and one to an unknown vertex, change nothing."""
    dag = _dag(spark, sf_dir)
    edge = lambda a, b: spark.createDataFrame([(a, b, 1.0)], "from_ord long, to_ord long, weight double")
    try:
        dag.add_edges(edge(1001, 1).unionByName(edge(1, 1001)))
        refused = False
    except graph.CycleError:
        refused = True
    more = dag.add_edges(edge(1, 1001).unionByName(edge(0, 77)).unionByName(edge(0, 1003)))
    return spark.createDataFrame([(refused, more.size())], "refused boolean, edges long")


_PAIRS = "pair AS (SELECT 1000000 + c_custkey AS child, 1000 + c_custkey % 25 AS parent FROM customer)"


@query(f"WITH {_EDGES}, {_PAIRS} SELECT child, parent, EXISTS (SELECT 1 FROM edge WHERE from_ord = parent AND to_ord = child) AS is_descendant FROM pair")
def direct_parent(spark, sf_dir):
    """G16."""
    pairs = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("child"), (F.col("c_custkey") % 25 + 1000).alias("parent"))
    return graph.is_descendant(_dag(spark, sf_dir).edges, pairs)


@query(f"WITH {_EDGES}, {_PAIRS} SELECT parent AS from_ord, child AS to_ord, CASE WHEN parent = child THEN 0.0 ELSE coalesce((SELECT CAST(weight AS DOUBLE) FROM edge WHERE from_ord = parent AND to_ord = child), CAST(2147483647 AS DOUBLE)) END AS weight FROM pair")
def edge_weight(spark, sf_dir):
    """G13."""
    pairs = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 25 + 1000).alias("from_ord"), (F.col("c_custkey") + 1000000).alias("to_ord"))
    return graph.edge_weights(_dag(spark, sf_dir).edges, pairs)


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT from_ord AS origin, to_ord AS place FROM edge UNION SELECT origin, to_ord FROM walk JOIN edge ON from_ord = place)
    SELECT EXISTS (SELECT 1 FROM walk WHERE origin = place) AS has_cycle, false AS was_acyclic_with_back_edge""")
def has_cycle(spark, sf_dir):
    """Of the graph, and of the graph with an edge back from a customer to a region."""
    dag = _dag(spark, sf_dir)
    back = dag.edges.where("to_ord >= 1000000").orderBy("to_ord").limit(1)
    closing = back.join(dag.edges.select(F.col("to_ord").alias("from_ord"), F.col("from_ord").alias("top")), "from_ord").select(F.col("to_ord").alias("from_ord"), F.col("top").alias("to_ord"), F.lit(0.0).alias("weight"))
    return spark.createDataFrame([(dag.has_cycle(), not dag.add_edges(closing, check=False).has_cycle())], "has_cycle boolean, was_acyclic_with_back_edge boolean")


@query(f"WITH {_EDGES}, {_VERTICES} SELECT from_ord, to_ord FROM edge WHERE to_ord NOT IN (SELECT 1000 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0) AND from_ord NOT IN (SELECT 1000 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def remove_vertices(spark, sf_dir):
    """Without every other nation."""
    dag = _dag(spark, sf_dir)
    gone = dag.vertices.where("ordinal between 1000 and 999999 and ordinal % 2 = 0")
    return dag.remove_vertices(gone).edges.select("from_ord", "to_ord")


@query(f"WITH {_VERTICES} SELECT r_regionkey AS ordinal, r_name AS label, 0 AS depth FROM region UNION ALL SELECT 1000 + n_nationkey, n_name, 1 FROM nation UNION ALL SELECT 1000000 + c_custkey, c_name, 2 FROM customer")
def vertices_by_depth(spark, sf_dir):
    """G23."""
    return _dag(spark, sf_dir).rendered()


# Locations

_LINES = "line AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS start_off, length(line) AS n FROM (SELECT doc_id, k, parts[k] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))))"


@query(f"WITH {_LINES} SELECT doc_id, CAST(start_off AS BIGINT) AS start_off, CAST(start_off + n AS BIGINT) AS end_off FROM line WHERE NOT (start_off >= 0 AND start_off + n <= (SELECT n_chars // 2 FROM documents d WHERE d.doc_id = line.doc_id))")
def covers_filter(spark, sf_dir):
    """Lines that do not lie in the first half of their document."""
    docs = _read(spark, sf_dir, "documents")
    cut = F.split("text", "\n", -1)
    at = F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start_off: long, end_off: long>>").alias("spans")), lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.array_append(s["spans"], F.struct(s["at"].alias("start_off"), (s["at"] + F.length(x)).alias("end_off"))).alias("spans")))["spans"]
    tokens = docs.select("doc_id", F.inline(at))
    spans = docs.select("doc_id", F.lit(0).cast("long").alias("start_off"), F.expr("n_chars div 2").alias("end_off"))
    return segmentation.outside(tokens, spans, "doc_id").select("doc_id", "start_off", "end_off")


def _selections(spark, sf_dir):
    one = lambda m, w: sel.location(F.col("o_orderkey") % m, F.col("o_orderkey") % m + F.col("o_orderkey") % w + 1)
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(sel.selection(F.collect_list(one(50, 7))).alias("a"), sel.selection(F.collect_list(one(40, 5))).alias("b"))


_HULL = "CASE WHEN a[1].start <= a[-1].start AND a[-1].\"end\" <= a[1].\"end\" THEN a[1] WHEN a[-1].start <= a[1].start AND a[1].\"end\" <= a[-1].\"end\" THEN a[-1] ELSE {'start': a[1].start, 'end': a[-1].\"end\"} END"


@query(f"WITH {_SELECTIONS}, h AS (SELECT cust, a, {_HULL} AS hull FROM chosen) SELECT cust, hull.start AS hull_start, hull.\"end\" AS hull_end, CAST(len(a) AS INT) AS n, hull.start <= 10 AND 12 <= hull.\"end\" AS covers FROM h")
def hull(spark, sf_dir):
    """L1, L4, L7, L11, L12."""
    return _selections(spark, sf_dir).select("cust", sel.hull(F.col("a"))["start"].alias("hull_start"), sel.hull(F.col("a"))["end"].alias("hull_end"), sel.size(F.col("a")).alias("n"), sel.covers(F.col("a"), sel.location(F.lit(10), F.lit(12))).alias("covers"))


@query(f"WITH {_SELECTIONS} SELECT cust, list_filter(a, lambda x: x >= {{'start': 20, 'end': 22}})[1].start AS ceiling_start, list_filter(a, lambda x: x <= {{'start': 20, 'end': 22}})[-1].start AS floor_start FROM chosen")
def floor_ceiling(spark, sf_dir):
    """L5, L6."""
    key = sel.location(F.lit(20), F.lit(22))
    return _selections(spark, sf_dir).select("cust", sel.ceiling(F.col("a"), key)["start"].alias("ceiling_start"), sel.floor(F.col("a"), key)["start"].alias("floor_start"))


@query(f"""WITH {_SELECTIONS}, u AS (SELECT cust, a, b, list_intersect(a, b) AS common, list_distinct(list_concat(a, b)) AS whole FROM chosen)
    SELECT cust, CAST(len(common) AS INT) AS shared, CAST(CASE WHEN len(common) > 0 THEN 1 ELSE len(whole) END AS INT) AS united, CAST(len(list_filter(a, lambda x: x <> a[1])) AS INT) AS after_delete, CAST(len(list_distinct(list_append(a, b[1]))) AS INT) AS after_add, list_contains(b, a[1]) AS has_first FROM u""")
def selection_union(spark, sf_dir):
    """L2, L3, L8-L10."""
    a, b = F.col("a"), F.col("b")
    return _selections(spark, sf_dir).select("cust", sel.size(sel.intersects(a, b)).alias("shared"), sel.size(sel.union(a, b)).alias("united"), sel.size(sel.delete(a, sel.first(a))).alias("after_delete"), sel.size(sel.add(a, sel.first(b))).alias("after_add"), sel.contains(b, sel.first(a)).alias("has_first"))


@query(f"WITH {_SELECTIONS}, h AS (SELECT cust, {_HULL} AS hull FROM chosen) SELECT cust, substr(c_name || c_address, hull.start + 1, hull.\"end\" - hull.start) AS code FROM h JOIN (SELECT c_custkey, c_name, c_name || c_name || c_name || c_name AS c_address FROM customer) ON c_custkey = cust")
def selection_code(spark, sf_dir):
    """L13."""
    texts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.repeat("c_name", 5).alias("content"))
    return _selections(spark, sf_dir).join(texts, "cust").select("cust", sel.code(F.col("a"), F.col("content")).alias("code"))


# Code: one small Java source for each part

#: The source of a name and a number, as SQL; both engines read \\n as a line end here.
_BODY = (
    "public class {0} {\n  private int total;\n\n  public int process{0}(int count) {\n    int result = 0;\n    for (int k = 0; k < count; k++) {\n      if (k % 2 == 0) {\n        result += measure{0}(k);\n      } else {\n        result--;\n      }\n"
    "    }\n    try {\n      total += result;\n    } catch (IllegalStateException e) {\n      throw e;\n    }\n    return result;\n  }\n\n  private int measure{0}(int value) {\n    return value + {1};\n  }\n}\n"
)


def _body(name: str, number: str, line_end: str = "chr(10)") -> str:
    """An expression for the text, which DuckDB and Spark read alike."""
    parts = _BODY.replace("{0}", "\x00N\x00").replace("{1}", "\x00I\x00").replace("\n", "\x00L\x00").split("\x00")
    said = {"N": name, "I": f"CAST({number} AS STRING)", "L": line_end}
    return "concat(" + ", ".join(said.get(p, f"'{p}'") for p in parts if p) + ")"


def _java(spark, sf_dir):
    # A part is a few bytes, the source made of it is parsed: the scan's one task would do all of it.
    rows = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").withColumn("name", F.expr(_NAME))
    return rows.select(F.col("p_partkey").cast("long").alias("source_id"), "name", F.expr(_body("name", "p_size")).alias("content"))


_JAVA = f"java AS (SELECT source_id, name, {_body('name', 'size')} AS content FROM (SELECT CAST(p_partkey AS BIGINT) AS source_id, {_CAMEL} AS name, p_size AS size FROM part))"


def _at(before: str, more: int = 0) -> str:
    """Place of a passage of the source, from 0, and so many characters further."""
    return f"(instr(content, {_quoted(before)}) - 1 + {more})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_END, _TAIL = "    return result;\n  }", "length(content) - 3"
#: The blocks of such a source in order: kind, start, end, depth, weight, benefit, irrelevant.
_BLOCKS_OF_JAVA = [
    ("method", _at("public int process"), _at(_END, len(_END)), 2, 16.0, 1.0, False),
    ("block", _at("(int count) {", 12), _at(_END, len(_END)), 3, 0.0, 16.0, False),
    ("block", _at("k++) {", 5), _at("    }\n    try", 5), 5, 0.0, 4.4, False),
    ("block", _at("== 0) {", 6), _at("      } else", 7), 7, 0.0, 16 / 7, False),
    ("block", _at("(int value) {", 12), _TAIL, 3, 0.0, 1.9999999999999998, True),
    ("block", _at("else {", 5), _at("--;\n      }", 11), 7, 0.0, 11 / 7, True),
    ("block", _at("try {", 4), _at("    } catch", 5), 5, 0.0, 2.0, True),
    ("block", _at("Exception e) {", 13), _at("throw e;\n    }", 14), 6, 0.0, 7 / 6, True),
    ("method", _at("private int measure"), _TAIL, 2, 3.0, 1.0, True),
]
_LINE = "CAST(length(left(content, {0})) - length(replace(left(content, {0}), chr(10), '')) + 1 AS INT)"
_SEGMENTS = f"WITH {_JAVA}, segment AS (" + " UNION ALL ".join(
    f"SELECT source_id, content, {k} AS ordinal, '{kind}' AS kind, CAST({start} AS INT) AS start_off, CAST({end} AS INT) AS end_off, {depth} AS depth, CAST({weight!r} AS DOUBLE) AS weight, CAST({benefit!r} AS DOUBLE) AS benefit, {irrelevant} AS irrelevant FROM java"
    for k, (kind, start, end, depth, weight, benefit, irrelevant) in enumerate(_BLOCKS_OF_JAVA)
) + ")"


@query(f"{_SEGMENTS} SELECT source_id, ordinal, kind, start_off, end_off, {_LINE.format('start_off')} AS start_line, {_LINE.format('end_off - 1')} AS end_line, depth, weight, benefit, ordinal = 0 AS is_root, irrelevant FROM segment")
def segment_knapsack(spark, sf_dir):
    """Segments of every source and which of them are left out."""
    return segmentation.segments(segmentation.parse_sources(_java(spark, sf_dir))).drop("label")


@query(f"WITH {_JAVA} SELECT source_id, e.* FROM java, (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (2, 5), (1, 6), (1, 7), (8, 4)) AS e(from_ord, to_ord)")
def segment_edges(spark, sf_dir):
    """Which block holds or calls which."""
    return segmentation.edges(segmentation.parse_sources(_java(spark, sf_dir))).select("source_id", "from_ord", "to_ord")


@query(f"{_SEGMENTS} SELECT source_id, start_off, end_off FROM segment WHERE NOT irrelevant")
def relevant_segments(spark, sf_dir):
    """The segments of a source but for the irrelevant ones."""
    parsed = segmentation.parse_sources(_java(spark, sf_dir))
    return segmentation.relevant_locations(parsed)


@query(f"""{_SEGMENTS} SELECT source_id, CASE segment.ordinal WHEN 0 THEN 1 ELSE 2 END AS ordinal, kind, CASE segment.ordinal WHEN 0 THEN 'process' ELSE 'measure' END || name AS name, start_off, end_off
    FROM segment JOIN java USING (source_id) WHERE kind = 'method'""")
def methods_of_sources(spark, sf_dir):
    """Methods of every source, in order."""
    found = segmentation.units(segmentation.parse_sources(_java(spark, sf_dir))).where("kind = 'method'")
    return found.select("source_id", "ordinal", "kind", "name", "start_off", "end_off")


@query(f"{_SEGMENTS} SELECT source_id, CASE WHEN name IN ('ColdBolt', 'NewRing') THEN substr(content, start_off + 1, end_off - start_off) END AS data, CASE WHEN name NOT IN ('ColdBolt', 'NewRing') THEN 'no such method' END AS error FROM segment JOIN java USING (source_id, content) WHERE ordinal = 8")
def unit_code(spark, sf_dir):
    """The method asked for, of the sources that have one of the names; else what is wrong."""
    java = _java(spark, sf_dir)
    return segmentation.unit_code(java, segmentation.parse_sources(java, ["measureColdBolt", "measureNewRing"]))


@query(f"WITH {_JAVA} SELECT source_id, substr(content, {_at('public int process')} + 1, {_at(_END, len(_END))} - {_at('public int process')}) AS data, CAST(NULL AS VARCHAR) AS error FROM java")
def segments_code(spark, sf_dir):
    """What the segments that are kept span."""
    java = _java(spark, sf_dir)
    return segmentation.segments_code(java, segmentation.parse_sources(java, wanted=("unit", "segments", "error")))


_WORDS_OF_JAVA = f"""said AS (
      SELECT source_id, lower(word) AS word, 3 AS n FROM (SELECT source_id, unnest({_SPLIT.replace('{0}', 'name')}) AS word FROM java)
      UNION ALL SELECT source_id, w.* FROM java, (VALUES ('result', 3), ('count', 2), ('process', 1), ('measure', 1), ('total', 1)) AS w(word, n)),
    counted AS (SELECT source_id, word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE NOT {_IS_STOP} GROUP BY ALL),
    concept AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY n DESC, word) AS INT) AS rank FROM counted QUALIFY rank <= 10)"""


@query(f"WITH {_JAVA}, {_WORDS_OF_JAVA} SELECT source_id, word, n, rank FROM concept")
def concepts_code(spark, sf_dir):
    """Words of every source, corrected by the words of all sources."""
    java = _java(spark, sf_dir)
    return concepts.source_concepts(java, spelling.build_dictionary(java, "content"))


@query(f"WITH {_JAVA}, {_WORDS_OF_JAVA} SELECT word, count(*) AS n FROM concept GROUP BY word ORDER BY n DESC, word LIMIT 10")
def corpus_concepts_code(spark, sf_dir):
    """Q1-Q3."""
    java = _java(spark, sf_dir)
    return concepts.corpus_concepts(java, spelling.build_dictionary(java, "content"))


# Files: a source for each nation, a table of fixed size, in folders by region

_HARBOR = "concat('Harbor', substr('Umbrellavineyardquicksand', 1, CAST(n_nationkey AS INT)))"
_FILE = "concat(CASE n_nationkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'Test' ELSE '' END, 'N', CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 8 = 0 THEN 'Test' ELSE '' END)"
_LINE_END = "CASE WHEN n_nationkey % 3 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END"
#: What is left of the files: those with both words in their names are passed over, lines end in one line feed, the last in none.
_FILES = f"""file AS (SELECT n_nationkey AS source_id, {_FILE} AS name, {_HARBOR} AS harbor, replace({_body(_HARBOR, 'n_nationkey')} || '#', chr(10) || '#', '') AS content
    FROM nation WHERE n_nationkey % 8 <> 0)"""


def _folder(spark, sf_dir) -> str:
    """Writes the files and some to be passed over; the nations are 25, whatever the size of the data."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    nations = _read(spark, sf_dir, "nation").withColumn("end", F.expr(_LINE_END))
    made = nations.select("n_regionkey", F.expr(_FILE).alias("file"), F.expr(_body(_HARBOR, "n_nationkey", "end")).alias("content"))
    for r in made.toLocalIterator():
        files.write_file(spark, f"{folder}/r{r['n_regionkey']}/{r['file']}.java", r["content"])
    files.write_file(spark, f"{folder}/r0/notes.txt", "class Notes {}")
    return folder


def _collected(spark, sf_dir) -> DataFrame:
    return files.collect_files(spark, _folder(spark, sf_dir), "java", ["test", "Test"])


@query(f"WITH {_FILES} SELECT name, content FROM file")
def folder_sources(spark, sf_dir):
    """Sources of the files below a folder, without those whose name has both words."""
    return files.file_sources(_collected(spark, sf_dir)).select("name", "content")


@query(f"WITH {_FILES}, cut AS (SELECT name, string_split(content, chr(10)) AS parts FROM file) SELECT name, CAST(k - 1 AS INT) AS line_no, parts[k] AS line FROM (SELECT name, parts, unnest(range(1, len(parts) + 1)) AS k FROM cut)")
def folder_lines(spark, sf_dir):
    """Lines of the files' sources."""
    sources = files.file_sources(_collected(spark, sf_dir))
    return sources.join(files.content_lines(sources), "source_id").select("name", "line_no", "line")


@query(f"WITH {_FILES} SELECT name, 'source' AS kind FROM file WHERE source_id % 5 = 1 UNION ALL SELECT 'process' || harbor, 'relevant' FROM file WHERE source_id % 5 = 1")
def populated(spark, sf_dir):
    """What a file of entries asks for: sources, and names of methods."""
    folder = _folder(spark, sf_dir)
    asked = _read(spark, sf_dir, "nation").where("n_nationkey % 5 = 1 and n_nationkey % 8 <> 0")
    line = F.concat(F.lit(f"{folder}/r"), F.col("n_regionkey"), F.lit("/"), F.expr(_FILE), F.lit(".java::process"), F.expr(_HARBOR), F.lit("(int count)::int"))
    files.write_file(spark, f"{folder}/entries.txt", "\n".join(r[0] for r in asked.select(line).toLocalIterator()))
    entries = files.read_lines(spark, f"{folder}/entries.txt").withColumnRenamed("value", "line")
    sources, relevant = files.populate(entries, files.collect_files(spark, folder, "java"))
    return sources.select("name", F.lit("source").alias("kind")).unionByName(relevant.select("name", F.lit("relevant").alias("kind")))


# Command line


def _printed(spark, *arguments: str) -> DataFrame:
    """line_no, line: what a command prints, the few rows of a top-k."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        status = cli.main(list(arguments), spark)
    lines = [f"exit {status}", *shown.getvalue().split("\n")]
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def _lines_sql(text: str) -> str:
    """line_no, line of what an expression over rows of `shown` in order of rank prints."""
    return f"""parts AS (SELECT list_concat(['exit 0'], string_split(string_agg({text}, '' ORDER BY rank), chr(10))) AS parts FROM shown)
    SELECT CAST(k - 1 AS INT) AS line_no, parts[k] AS line FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM parts)"""


_FILE_WORDS = _WORDS_OF_JAVA.replace("java", "file_name")


@query(f"""WITH {_FILES}, file_name AS (SELECT source_id, harbor AS name FROM file), {_FILE_WORDS},
    top AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM concept GROUP BY word QUALIFY place <= 7),
    shown AS (SELECT 1 AS rank, '[' || string_agg(word, ', ' ORDER BY place) || ']' AS said FROM top), {_lines_sql("said || chr(10)")}""")
def command_concepts(spark, sf_dir):
    """What the command prints for a folder."""
    return _printed(spark, "concepts", "-d", _folder(spark, sf_dir), "-k", "7")


_FILE_FEATURES = f"feature AS (SELECT source_id, substr(content, {_at('public int process')} + 1, {_at(_END, len(_END))} - {_at('public int process')}) AS data FROM file)"


def _of_files(sql: str) -> str:
    assert _BENCHMARK in sql
    return sql.replace(_BENCHMARK, f"{_FILES}, {_FILE_FEATURES}")


_SHOWN = "name || chr(10) || content || chr(10) || chr(10)"


@query(f"{_of_files(_TYPICAL)}, shown AS (SELECT name, content, row_number() OVER (ORDER BY score DESC) AS rank FROM typical JOIN file USING (source_id) QUALIFY rank <= 2), {_lines_sql(_SHOWN)}")
def command_typical(spark, sf_dir):
    """Names and code of the most typical files."""
    return _printed(spark, "typical", "-d", _folder(spark, sf_dir), "-k", "2", "-e")


@query(f"""{_of_files(_FOLD)}, sized AS (SELECT rep_id, count(*) AS size FROM region GROUP BY rep_id),
    shown AS (SELECT name, content, row_number() OVER (ORDER BY size DESC, rep.rank) AS rank
      FROM sized JOIN rep ON rep.source_id = rep_id JOIN file f ON f.source_id = rep_id QUALIFY row_number() OVER (ORDER BY size DESC, rep.rank) = 1), {_lines_sql(_SHOWN)}""")
def command_represent(spark, sf_dir):
    """Name and code of the file that stands for most others."""
    return _printed(spark, "represent", "-d", _folder(spark, sf_dir))
