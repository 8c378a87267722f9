"""Concepts: the words that the informative code of a source, or of most sources of a corpus, is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import identifier_parts, is_identifier_of_interest, only_consonants
from textloom.operators.counting import combine, counted, document_frequency, most_frequent, parts_for, top_of_each
from textloom.operators.segmentation import outside, parse_sources
from textloom.operators.spelling import accepted, correct
from textloom.tables import spread, write_table


def _labels(name: Column) -> Column:
    return F.when(is_identifier_of_interest(name), identifier_parts(name)).otherwise(F.array().cast("array<string>"))


def _words_of_labels(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """label, fixed: what the different labels of a table become."""
    labels = labels.withColumn("word", F.lower("label"))
    dictionary = write_table(dictionary, "dictionary")
    corrections = correct(labels.select("word"), dictionary)
    known = dictionary.select("word", F.lit(True).alias("known"))
    met = labels.join(corrections, "word", "left").join(known, "word", "left")
    doubtful = only_consonants(F.col("label")) | F.col("known").isNull()
    return met.select("label", F.lower(F.when(doubtful, accepted(F.col("label"), F.coalesce("corrected", "word"))).otherwise(F.col("label"))).alias("fixed"))


def tokens(named: DataFrame, dictionary: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """source_id, pos, word: pieces of the names (source_id, pos, name, start_off, end_off) outside the spans, corrected.

    Different pieces are corrected once each, whatever their number. Without a dictionary nothing is corrected.
    """
    kept = outside(named, spans) if spans is not None else named
    pieces = kept.select("source_id", "pos", F.posexplode(_labels(F.col("name"))).alias("part", "label"))
    if dictionary is None:
        return pieces.select("source_id", "pos", "part", F.lower("label").alias("word"))
    pieces = write_table(pieces, "pieces")
    fixed = write_table(_words_of_labels(pieces.select("label").distinct(), dictionary), "labels")
    return pieces.join(fixed, "label", "left").select("source_id", "pos", "part", F.col("fixed").alias("word"))


def source_concepts(sources: DataFrame, dictionary: DataFrame | None = None, relevant: list[str] | None = None, k: int = 10, compat: bool = True) -> DataFrame:
    """source_id, word, n, rank: the k most frequent words of each source; none of a source without the method asked for, and
    none of one whose segments could not be told: source_errors() says which and why.

    Names are counted within the row of their source; of their pieces only different ones meet the dictionary, once each.
    """
    held = parse_sources(sources, relevant, compat, ("names", "error", "left_out")).where("error is null")
    names = F.filter("names", lambda n: ~F.exists("left_out", lambda s: (s["start_off"] <= n["start_off"]) & (n["end_off"] <= s["end_off"])))
    counts = held.select("source_id", F.explode(counted(F.transform(names, lambda n: n["name"]))).alias("c"))
    rows = write_table(counts.select("source_id", F.explode(_labels(F.col("c.word"))).alias("label"), "c.n"), "pieces")  # no source is parsed twice
    if dictionary is None:
        items = rows.select("source_id", F.lower("label").alias("word"), "n")
    else:
        fixed = write_table(_words_of_labels(rows.select("label").distinct(), dictionary), "labels")
        items = rows.join(fixed, "label", "left").select("source_id", F.col("fixed").alias("word"), "n")
    return top_of_each(items, k, count_col="n", parts=parts_for(rows.count()))


def source_errors(sources: DataFrame, relevant: list[str] | None = None, compat: bool = True) -> DataFrame:
    """source_id, error of the sources that source_concepts() has no words of."""
    return parse_sources(sources, relevant, compat, ("error",)).where("error is not null").select("source_id", "error")


def corpus_concepts(sources: DataFrame, dictionary: DataFrame | None = None, relevant: list[str] | None = None, k: int = 10, compat: bool = True) -> DataFrame:
    """word, n: the k words that are among the ten most frequent of most sources.

    Different texts are parsed once each and count as often as there are sources of them. Rows of one id are one source: those
    of ids that several rows have are left as they are.
    """
    sources = sources.select(F.col("source_id").cast("long").alias("source_id"), F.coalesce("content", F.lit("")).alias("content"))
    repeated = write_table(sources.groupBy("source_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("source_id").alias("_id")), "repeated")
    some = not repeated.isEmpty()
    met = F.col("source_id").eqNullSafe(F.col("_id"))
    if some and dictionary is not None:
        dictionary = write_table(dictionary, "dictionary")
    alone = sources.join(repeated, met, "left_anti") if some else sources
    copies = alone.groupBy("content").agg(F.count("*").alias("copies"))
    texts = write_table(copies.select(F.monotonically_increasing_id().alias("source_id"), "content", "copies"), "texts")
    tops = source_concepts(spread(texts.select("source_id", "content"), "source_id"), dictionary, relevant, compat=compat)
    n = tops.join(texts.select("source_id", "copies"), "source_id").groupBy("word").agg(F.sum("copies").cast("long").alias("n"))
    if some:
        again = source_concepts(sources.join(repeated, met, "left_semi"), dictionary, relevant, compat=compat)
        n = combine(n, document_frequency(again))
    return most_frequent(n, k)
