"""Spelling correction against a dictionary (word, freq) that is a table like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.similarity import similarity
from textloom.functions.stop_words import is_stop_word
from textloom.functions.text import identifier_parts, is_number, only_consonants
from textloom.tables import spread, write_table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A correction is taken if it is more like the word than this (32 bits, as the likeness is).
LEAST_LIKENESS = 0.3


def build_dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, freq: pieces of the words of texts, longer than two, with a lower-case vowel, neither numbers nor stop words."""
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\w+"), F.lit(0))).alias("name"))
    names = found.groupBy("name").agg(F.count("*").alias("n"))  # each different name is split once
    pieces = names.select("n", F.explode(identifier_parts(F.col("name"))).alias("piece"))
    piece = F.col("piece")
    kept = pieces.where((F.length(piece) > 2) & ~only_consonants(piece) & ~is_number(piece) & ~is_stop_word(piece))
    return kept.groupBy(F.lower(piece).alias("word")).agg(F.sum("n").cast("long").alias("freq"))


def in_dictionary(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    return words.join(dictionary.select("word"), "word", "left_semi")


def _places(word: Column, upto: Column) -> Column:
    """0 .. upto - 1; none if upto is below 1."""
    return F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))


def mutations(word: Column) -> Column:
    """All one edit away, in order: deletions, replacements, insertions, transpositions, each by place, then by letter."""
    n = F.length(word)
    head = lambda k: F.substr(word, F.lit(1), k)
    tail = lambda k: F.substr(word, k + 1)
    letters = F.array(*[F.lit(c) for c in LETTERS])
    deletes = F.transform(_places(word, n), lambda k: F.concat(head(k), tail(k + 1)))
    replaces = F.flatten(F.transform(_places(word, n), lambda k: F.transform(letters, lambda c: F.concat(head(k), c, tail(k + 1)))))
    inserts = F.flatten(F.transform(_places(word, n + 1), lambda k: F.transform(letters, lambda c: F.concat(head(k), c, tail(k)))))
    transposes = F.transform(_places(word, n - 1), lambda k: F.concat(head(k), F.substr(word, k + 2, F.lit(1)), F.substr(word, k + 1, F.lit(1)), tail(k + 2)))
    return F.concat(deletes, replaces, inserts, transposes)


def _best(order: str | None = None) -> Column:
    """The most frequent candidate; of several, the one first in order."""
    return F.max_by("candidate", F.struct("freq", -F.col(order))) if order else F.min_by("candidate", F.struct(-F.col("freq"), F.col("candidate")))


def _longest(words: DataFrame) -> int:
    return words.agg(F.max(F.length("word"))).first()[0] or 0


def known_mutations(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, candidate, freq, place: the mutations of each word that are in the dictionary.

    A word longer than the longest of the dictionary and one more has none and is not mutated: texts hold words of
    thousands of letters, of which each mutation is as long.
    """
    dictionary = write_table(dictionary.select("word", "freq"), "dictionary")
    possible = words.select("word").where(F.length("word") <= _longest(dictionary) + 1)
    made = spread(possible, "word").select("word", F.posexplode(mutations(F.col("word"))).alias("place", "candidate"))
    first = made.groupBy("word", "candidate").agg(F.min("place").alias("place"))
    return first.join(dictionary.withColumnRenamed("word", "candidate"), "candidate")


def _shortened(word: Column) -> Column:
    """The word and what one or two deletions leave of it: two words two edits apart have one of these in common."""
    once = lambda w: F.transform(_places(w, F.length(w)), lambda k: F.concat(F.substr(w, F.lit(1), k), F.substr(w, k + 2)))
    first = once(word)
    return F.array_distinct(F.concat(F.array(word), first, F.flatten(F.transform(first, once))))


def _swapped(word: Column) -> Column:
    n = F.length(word)
    return F.transform(_places(word, n - 1), lambda k: F.concat(F.substr(word, F.lit(1), k), F.substr(word, k + 2, F.lit(1)), F.substr(word, k + 1, F.lit(1)), F.substr(word, k + 3)))


def within_two(a: Column, b: Column) -> Column:
    """Is b at most two edits from a, an edit being a deletion, a replacement, an insertion or a swap of neighbours?"""
    return (
        (F.levenshtein(a, b) <= 2)
        | F.exists(_swapped(a), lambda x: F.levenshtein(x, b) <= 1)
        | F.exists(_swapped(b), lambda x: F.levenshtein(a, x) <= 1)
        | (F.size(F.array_intersect(_swapped(a), _swapped(b))) > 0)
    )


def two_edits(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, candidate, freq: dictionary words up to two edits away, met by what deletions leave of both.

    No candidate is generated that is not in the dictionary: a word has some hundred shortened forms, but some hundred
    thousand mutations of mutations. On either side, only words up to two letters longer than the other's longest are shortened.
    """
    words, dictionary = write_table(words.select("word"), "words"), write_table(dictionary.select("word", "freq"), "dictionary")
    longest, longest_known = _longest(words), _longest(dictionary)
    words, dictionary = words.where(F.length("word") <= longest_known + 2), dictionary.where(F.length("word") <= longest + 2)
    left = spread(words, "word").select("word", F.explode(_shortened(F.col("word"))).alias("form"))
    right = dictionary.select(F.col("word").alias("candidate"), "freq", F.explode(_shortened(F.col("word"))).alias("form"))
    return left.join(right, "form").select("word", "candidate", "freq").distinct().transform(lambda df: spread(df, "word", "candidate")).where(within_two(F.col("word"), F.col("candidate")))


def best_by_prefix(dictionary: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """prefix, candidate: for each beginning of dictionary words, the empty one too, the most frequent word with it.

    With asked (prefix), only beginnings of those lengths are made, and only those asked for are kept.
    """
    lengths = F.sequence(F.lit(0), F.length("word"))
    if asked is not None:
        known = [r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # a number for each length
        lengths = F.filter(F.array(*[F.lit(n) for n in sorted(known)]).cast("array<int>"), lambda n: n <= F.length("word"))
    made = dictionary.select(F.explode(F.transform(lengths, lambda k: F.substr(F.col("word"), F.lit(1), k))).alias("prefix"), F.col("word").alias("candidate"), "freq")
    if asked is not None:
        made = made.join(asked.distinct(), "prefix", "left_semi")
    return made.groupBy("prefix").agg(_best().alias("candidate"))


def prefix_correction(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, candidate: the most frequent word that begins with the word, else with all but its last letter, else null."""
    shorter = F.substr(F.col("word"), F.lit(1), F.greatest(F.length("word") - 1, F.lit(0)))
    asked = words.select("word", F.explode(F.array(F.struct(F.lit(0).alias("order"), F.col("word").alias("prefix")), F.struct(F.lit(1).alias("order"), shorter.alias("prefix")))).alias("a")).select("word", "a.*")
    asked = write_table(asked, "prefixes")
    met = asked.join(best_by_prefix(dictionary, asked.select("prefix")), "prefix", "left")
    return met.groupBy("word").agg(F.min_by("candidate", F.when(F.col("candidate").isNotNull(), F.col("order"))).alias("candidate"))


def correct(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, corrected for the different words of a table.

    A word of the dictionary stays. One of consonants becomes the likest of three: the most frequent word one edit away,
    up to two edits away, and by prefix. Any other becomes the most frequent word by prefix. Without a candidate it stays.
    """
    asked = words.select("word").where("word is not null").distinct()
    dictionary = write_table(dictionary.select("word", "freq"), "dictionary")  # looked into from four sides
    unknown = asked.join(dictionary.select("word"), "word", "left_anti")
    by_prefix = prefix_correction(unknown, dictionary)
    odd = unknown.where(only_consonants(F.col("word")))
    # An edit brings one vowel at most into a word that has none.
    vowels = F.regexp_count("word", F.lit("[aeiou]"))
    near, nearer = dictionary.where(vowels <= 2), dictionary.where(vowels <= 1)
    one = known_mutations(odd, nearer).groupBy("word").agg(_best("place").alias("one"))
    two = two_edits(odd, near).groupBy("word").agg(_best().alias("two"))
    met = by_prefix.join(one, "word", "left").join(two, "word", "left")
    choices = F.filter(F.array_distinct(F.array("candidate", "one", "two")), lambda c: c.isNotNull())
    likest = F.element_at(F.array_sort(F.transform(choices, lambda c: F.struct((-similarity(F.col("word"), c)).alias("unlike"), c.alias("choice")))), 1)["choice"]
    chosen = met.select("word", F.when(only_consonants(F.col("word")) & (F.size(choices) > 0), likest).otherwise(F.col("candidate")).alias("corrected"))
    return asked.join(chosen, "word", "left").select("word", F.coalesce("corrected", "word").alias("corrected"))


def accepted(label: Column, corrected: Column) -> Column:
    """The correction if it is like enough to the label as it is written, else the label."""
    return F.when(similarity(label, corrected) > F.lit(LEAST_LIKENESS).cast("float"), corrected).otherwise(label)
