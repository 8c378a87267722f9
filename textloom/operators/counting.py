"""Counters of words, top-k, and document frequencies. Ties always go to the word first in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stop_words import in_any_list
from textloom.functions.text import words
from textloom.tables import write_table

TOP_OF_SOURCE = 10
#: So many rows (id, word, n) a task may get, about 30 MB for its hash table and its sort together.
ROWS_OF_TASK = 250_000


def saturated(n: Column, step: int = 1, most: int | None = None) -> Column:
    """What n increments of a step come to: an increment that would reach `most` is dropped, not cut."""
    return n * step if most is None else F.least(n, F.floor(F.greatest(F.lit(most - 1), F.lit(0)) / step)) * step


def saturated_in_order(steps: Column, most: int) -> Column:
    """The same for an array of different steps, taken in order."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: F.when(total + step < most, total + step).otherwise(total))


def items_count(items: DataFrame, count_col: str | None = None) -> DataFrame:
    """n: all that was added, stop words and repeats too."""
    return items.agg(F.coalesce(F.sum(count_col) if count_col else F.count("*"), F.lit(0)).cast("long").alias("n"))


def without_stop_words(items: DataFrame, languages: list[str], word_col: str = "word") -> DataFrame:
    return items.where(~in_any_list(F.col(word_col), languages))


def count_words(items: DataFrame, languages: list[str] | None = None, count_col: str | None = None) -> DataFrame:
    """word, n over the items that are no stop words (of English and Java if no languages are given)."""
    counted = items.groupBy("word").agg((F.sum(count_col) if count_col else F.count("*")).cast("long").alias("n"))
    return without_stop_words(counted, ["english", "java"] if languages is None else languages)  # each different word is looked up once


def combine(*counters: DataFrame) -> DataFrame:
    """The sum of counters (word, n)."""
    every = counters[0]
    for one in counters[1:]:
        every = every.unionByName(one)
    return every.groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def by_frequency(counter: DataFrame) -> DataFrame:
    return counter.orderBy(F.desc("n"), "word")


def most_frequent(counter: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; fewer if there are fewer, none for k below 1."""
    return by_frequency(counter).limit(max(k, 0))


def rendered(counter: DataFrame) -> DataFrame:
    """json: a map from words to counts. For a small counter."""
    return counter.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n"))))).alias("json"))


def parts_for(rows: int) -> int:
    """A number of tasks for so many rows (id, word, n), that keeps each task's share the same however many rows there are."""
    return max(1, -(-rows // ROWS_OF_TASK))


def top_of_each(items: DataFrame, k: int = TOP_OF_SOURCE, id_col: str = "source_id", languages: list[str] | None = None, count_col: str | None = None, parts: int | None = None) -> DataFrame:
    """id_col, word, n, rank: the k most frequent words of each source. Words are counted before sources meet in a window.

    parts: into so many tasks the sources are dealt first; one exchange then serves the counts and the window.
    """
    kept = without_stop_words(items, ["english", "java"] if languages is None else languages)
    kept = kept.repartition(parts, id_col) if parts else kept
    counts = kept.groupBy(id_col, "word").agg((F.sum(count_col) if count_col else F.count("*")).cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once, although a function in it asks for it at each element."""
    return F.get(F.transform(F.array(value), use), 0)


def counted(words: Column) -> Column:
    """array of struct<word, n>: the different words of an array, in order, and how often each is in it."""

    def runs(sorted_words: Column, ends: Column) -> Column:
        return F.transform(ends, lambda end, k: F.struct(F.get(sorted_words, end - 1).alias("word"), (end - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("long").alias("n")))

    def within(sorted_words: Column) -> Column:
        n = F.size(sorted_words)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: (i == n) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)))
        return _bound(ends, lambda found: runs(sorted_words, found))

    return _bound(F.sort_array(words), within)


def document_frequency(tops: DataFrame) -> DataFrame:
    """word, n: in how many sources' tops a word is."""
    return tops.groupBy("word").agg(F.count("*").cast("long").alias("n"))


def prose_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, word: every word of every text."""
    return docs.select(id_col, F.explode(words(F.col(text_col))).alias("word"))


def prose_tops(docs: DataFrame, k: int = TOP_OF_SOURCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, word, n, rank: the k most frequent words of each document. A document whose id no other has is counted within its
    row, so a task holds the words of one document at a time; only of ids that several rows have the counts are added up."""
    docs = docs.select(id_col, text_col)
    repeated = write_table(docs.groupBy(id_col).agg(F.count("*").alias("rows")).where("rows > 1").select(F.col(id_col).alias("_id")), "repeated")
    counts = F.filter(counted(words(F.col(text_col))), lambda c: ~in_any_list(c["word"], ["english", "java"]))
    dealt = docs.repartition(id_col, F.length(text_col))  # a file may have few row groups
    some = not repeated.isEmpty()
    met = F.col(id_col).eqNullSafe(F.col("_id"))
    alone = dealt.join(repeated, met, "left_anti") if some else dealt
    ranked = F.slice(F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("less"), c["word"].alias("word")))), 1, max(k, 0))
    tops = alone.select(id_col, F.posexplode(ranked).alias("place", "c")).select(id_col, "c.word", (-F.col("c.less")).alias("n"), (F.col("place") + 1).alias("rank"))
    if not some:
        return tops
    again = write_table(dealt.join(repeated, met, "left_semi").select(id_col, F.explode(counts).alias("c")).select(id_col, "c.*"), "counts")
    parts = parts_for(again.count())
    summed = again.repartition(parts, id_col, "word").groupBy(id_col, "word").agg(F.sum("n").alias("n"))
    return tops.unionByName(top_of_each(summed, k, id_col, [], "n", parts))


def prose_concepts(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k words that are among the top words of most documents."""
    return most_frequent(document_frequency(prose_tops(docs, id_col=id_col, text_col=text_col)), k)
