"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.shared import WORD, drop_tables, table, write_table

#: Fixed values of the contract: weights of sources in order of their names, and copies of a document at most.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Expected copies of documents of a source are to one another as these: EVEN plus GAIN for each doubling of the length. So
#: a document of 1000 words is taken twice as often as one of 2. GAIN 0: all equally often.
EVEN, GAIN = 8, 1
#: Plans up to this many rows are broadcast; larger ones are joined by shuffle, hot sources split by AQE.
BROADCAST_ROWS = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    """How often a length can be halved: 0 for 0 and 1."""
    return (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1).cast("int")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with place, from 0, in order of source (by code point, null last): ranges of sources are ranked each alone,
    after the number of sources in the ranges before."""
    parts = write_table(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    before = parts.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("place", own).join(F.broadcast(before), "_part").withColumn("place", F.col("place") + F.col("_before") - 1).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target for a table (source, source_size).

    The target is min(most * size, level * weight) with one level for all sources, at which targets add up to the
    size of all: what resharing the excess by weight comes to. Sources of one size and weight are one row when the level is
    found, in order of most * size / weight: n words in all make at most about 3 * sqrt(2 n) such rows, however many the sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    first = write_table(ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("bound")), "weighed")
    alike = first.groupBy("bound", "weight").agg(F.count("*").alias("n"), F.sum("source_size").alias("size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("bound") / F.col("weight"), "bound", "weight").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left = (
        alike.withColumn("size_left", F.sum("size").over(every) - F.coalesce(F.sum(F.col("bound") * F.col("n")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum(F.col("weight") * F.col("n")).over(every) - F.coalesce(F.sum(F.col("weight") * F.col("n")).over(before), F.lit(0)))
        .where(wide("bound") * wide("weight_left") > wide("size_left") * wide("weight"))
    )
    level = left.agg(F.max_by(F.struct("size_left", "weight_left"), "weight_left").alias("level")).first()["level"]
    if level is None:
        return first.select("source", "source_size", F.col("bound").cast("double").alias("target"))
    size, of = F.lit(level["size_left"]).cast("long"), F.lit(level["weight_left"]).cast("long")
    capped = wide("bound") * of.cast("decimal(19,0)") <= size.cast("decimal(19,0)") * wide("weight")
    return first.select("source", "source_size", F.when(capped, F.col("bound").cast("double")).otherwise(size * F.col("weight") / of).alias("target"))


def expected_copies(classes: DataFrame, most: int = MOST_COPIES, gain: int = GAIN) -> DataFrame:
    """classes (source, class, words, source_size, target) with copies, share and wanted.

    Documents of a class are expected as often as one factor of their source times EVEN + gain * class says, but at most
    `most` times; the factor is the one at which expected words add up to the target. The whole part are certain copies, the
    rest (share) is the probability of one more; wanted: the words of the source's target that certain copies leave.
    """
    g = F.lit(EVEN) + F.lit(gain) * F.col("class")
    longer = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("source")
    known = classes.withColumn("g", g.cast("long")).withColumn("_above", F.coalesce(F.sum("words").over(longer), F.lit(0))).withColumn("_below", F.sum(F.col("g") * F.col("words")).over(upto))
    left = F.col("target") - most * F.col("_above")
    known = known.withColumn("_open", ~(most * F.col("_below") <= F.col("g") * left))
    factor = F.max(F.when(F.col("_open"), F.struct(F.col("class").alias("k"), left.alias("left"), F.col("_below").alias("below")))).over(every)
    known = known.withColumn("_factor", factor)
    expected = F.when(F.col("_open"), F.least(F.coalesce(F.col("_factor.left") / F.nullif(F.col("_factor.below"), F.lit(0)), F.lit(0.0)) * F.col("g"), F.lit(float(most)))).otherwise(F.lit(float(most)))
    known = known.withColumn("_e", F.greatest(expected, F.lit(0.0)))
    out = known.withColumn("copies", F.floor("_e")).withColumn("share", F.col("_e") - F.floor("_e"))
    wanted = F.col("target") - F.sum(F.col("copies") * F.col("words")).over(every)
    return out.withColumn("wanted", wanted).drop("g", "_above", "_below", "_open", "_factor", "_e")


def pareto_key(id_: Column, share: Column) -> Column:
    """Random odds over inclusion odds. The random number is fixed by the document's id, so that reruns agree."""
    u = (F.conv(F.substring(F.sha2(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"), 256), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    return u / (1 - u) * (1 - share) / share


def _key_and_range(df: DataFrame, id_: Column, ranges: int) -> DataFrame:
    """df, which has share, with the Pareto key and the range that it falls into."""
    keyed = df.withColumn("_key", F.when(F.col("share") > 0, pareto_key(id_, F.col("share"))))
    return keyed.withColumn("_range", F.least(F.floor(F.col("_key") / (1 + F.col("_key")) * ranges), F.lit(ranges - 1)))


def _met(df: DataFrame, plan: DataFrame, source: str, size: str) -> DataFrame:
    return df.withColumn("_k", length_class(F.col(size))).join(plan, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("class")), "left").drop("_source", "_k", "class")


def _decide(df: DataFrame, id_: Column, size: str, plan: DataFrame, source: str, ranges: int) -> DataFrame:
    """df with the plan's columns and n_copies; nothing but a plan too large to broadcast makes a row shuffle."""
    known = _key_and_range(_met(df, plan, source, size), id_, ranges)
    inside = (F.col("_range") == F.col("cross")) & (F.struct(F.col("_key"), F.col(size)) <= F.col("cut"))
    take = (F.col("share") > 0) & ((F.col("_range") < F.col("cross")) | inside)
    return known.withColumn("n_copies", (F.col("copies") + F.coalesce(take, F.lit(False)).cast("long")).cast("long"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """A row for each source and length class of rows (id, source, size): what it gets, and where the source's sample ends.

    The cut is found without sorting a source: words are summed over about sqrt(rows) ranges of the key, and only
    the range that crosses what is wanted is ordered, rows of one key and size as one.
    """
    ranges = 1 << max(4, math.ceil(math.log2(max(1, rows.count())) / 2))
    classes = write_table(rows.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "length-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    of = classes.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    plan = write_table(expected_copies(of, most).withColumnRenamed("source", "_source").drop("words"), "plan")
    near = F.broadcast if plan.count() <= BROADCAST_ROWS else (lambda df: df)
    known = _key_and_range(_met(rows, near(plan.withColumn("_of", F.col("_source"))), "source", "size"), F.col("id"), ranges).where("share > 0")
    sums = known.groupBy("_of", "_range").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    crossing = (
        sums.withColumn("after", F.sum("words").over(Window.partitionBy("_of").orderBy("_range")))
        .where((F.col("after") >= F.col("wanted")) & (F.col("after") - F.col("words") < F.col("wanted")))
        .select(F.col("_of").alias("_crossed"), F.col("_range").alias("cross"), (F.col("after") - F.col("words")).alias("before"))
    )
    crossing = write_table(crossing, "crossing")  # at most a row for each source
    inside = known.join(near(crossing), F.col("_of").eqNullSafe(F.col("_crossed")) & (F.col("_range") == F.col("cross")))
    alike = inside.groupBy("_of", "_key", "size").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("wanted").alias("wanted"), F.first("cross").alias("cross"))
    order = Window.partitionBy("_of").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = alike.withColumn("now", F.col("before") + F.sum("words").over(order))
    # A document without words is as near as the one before it, also past what is wanted.
    nearer = (F.abs(F.col("now") - F.col("wanted")) <= F.abs(F.col("now") - F.col("words") - F.col("wanted"))) & (F.col("now") - F.col("words") < F.col("wanted"))
    cuts = run.groupBy(F.col("_of").alias("_crossed")).agg(F.first("cross").alias("cross"), F.max(F.when(nearer, F.struct("_key", "size"))).alias("cut"))
    full = plan.join(cuts, F.col("_source").eqNullSafe(F.col("_crossed")), "left").drop("_crossed", "wanted")
    mix = write_table(full, "mix")
    drop_tables(classes, plan, crossing)
    return near(mix), ranges


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How many words of each document a mix takes in which sources have shares by weight.

    Columns: id_col, size, source_size, target, taken. Documents of a source are expected in the mix the oftener the
    longer they are, see expected_copies(). Each gets the whole part of that as certain copies. Of the rest, each source
    has a Pareto sample of fixed size with unequal probabilities: its documents in order of random odds over inclusion
    odds, up to where the words taken come nearest to the target (the longer prefix on a tie).

    - Null text has no words and takes none. A null source is a source of its own, last in order.
    - Rows repeated in id have the same random number; rows of one id and size share their fate.
    - Sources without words have target 0. No rows give no rows; other columns are ignored, whatever their names.
    """
    rows = write_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    plan, ranges = _plan(rows, weights, most)
    decided = _decide(rows, F.col("id"), "size", plan, "source", ranges)
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources() takes it, with the columns of docs."""
    rows = write_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    plan, ranges = _plan(rows, weights, most)
    drop_tables(rows)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_size", n_words(F.col(f"_row.`{text_col}`"))).withColumn("_of", F.col(f"_row.`{source_col}`"))
    decided = _decide(sized, F.col(f"_row.`{id_col}`"), "_size", plan, "_of", ranges)
    copies = F.sequence(F.lit(1).cast("long"), F.col("n_copies"))
    return decided.where("n_copies > 0").select("_row", F.explode(copies)).select("_row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op7_source_mixing": op7_source_mixing}
SQL = {
    "op7_source_mixing": r"""
        WITH rows_ AS (
          SELECT *, length(bin(greatest(size, 1))) - 1 AS k FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 (CAST(('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
          FROM documents)),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows_ GROUP BY source),
        weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS bound FROM sources),
        left_ AS (
          SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0) AS BIGINT) AS size_left,
                 CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_left
          FROM weighed WINDOW b AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        capped AS (SELECT *, bound * weight_left <= size_left * weight AS is_capped FROM left_),
        level AS (SELECT arg_max(size_left, weight_left) AS s, max(weight_left) AS w FROM capped WHERE NOT is_capped),
        targets AS (SELECT source, source_size, CASE WHEN is_capped THEN CAST(bound AS DOUBLE) ELSE s * weight / CAST(w AS DOUBLE) END AS target FROM capped LEFT JOIN level ON true),
        class AS (
          SELECT *, 8 + k AS g, sum(words) OVER (PARTITION BY source) AS source_size,
                 CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above,
                 CAST(sum((8 + k) * words) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS below
          FROM (SELECT source, k, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY source, k)),
        opened AS (
          SELECT c.source, k, words, g, t.source_size, target, target - 3 * above AS left_, below, NOT (3 * below <= g * (target - 3 * above)) AS is_open
          FROM class c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
        factors AS (SELECT source, arg_max(left_, k) AS left_, arg_max(below, k) AS below FROM opened WHERE is_open GROUP BY source),
        expected AS (
          SELECT o.*, greatest(CASE WHEN is_open THEN least(coalesce(f.left_ / CAST(nullif(f.below, 0) AS DOUBLE), 0.0) * g, 3.0) ELSE CAST(3 AS DOUBLE) END, 0.0) AS e
          FROM opened o LEFT JOIN factors f ON o.source IS NOT DISTINCT FROM f.source),
        plan AS (SELECT source, k, source_size, target, floor(e) AS copies, e - floor(e) AS share, target - sum(floor(e) * words) OVER (PARTITION BY source) AS wanted FROM expected),
        known AS (
          SELECT r.doc_id, r.source, r.size, p.source_size, p.target, p.copies, p.share, p.wanted,
                 CASE WHEN share > 0 THEN u / (1 - u) * (1 - share) / share END AS key
          FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source AND r.k = p.k),
        alike AS (SELECT source, key, size, sum(size) AS words, first(wanted) AS wanted FROM known WHERE key IS NOT NULL GROUP BY source, key, size),
        run AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS now FROM alike),
        cut AS (SELECT source, max({'key': key, 'size': size}) AS last FROM run WHERE abs(now - wanted) <= abs(now - words - wanted) AND now - words < wanted GROUP BY source)
        SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN {'key': key, 'size': size} <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM known LEFT JOIN cut ON known.source IS NOT DISTINCT FROM cut.source"""
}
