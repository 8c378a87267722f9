"""Typical sources under a kernel over pairwise likeness, and regions of the sources that each typical one represents."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.similarity import bandwidths, gaussian_kernel, similarity
from textloom.tables import spread, write_table

BANDWIDTH = 0.3
TYPICAL = 5
#: Sources of one block, at least: a task compares the sources of two blocks.
BLOCK_ROWS = 24
#: Pairs of blocks for each task that can run at once, so that a few slow ones do not hold up the rest.
PAIRS_A_TASK = 4


@dataclass(frozen=True)
class Processor:
    """What a typicality query looks at: feature gives sources (source_id, ...) a column data, score compares two of them."""

    feature: Callable[[DataFrame], DataFrame] = lambda sources: sources.withColumn("data", F.col("content"))
    score: Callable[[Column, Column], Column] = similarity


def pair_scores(features: DataFrame, score: Callable[[Column, Column], Column] = similarity, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """i, j, score for all i < j of features (source_id, data).

    Every pair has to be scored, so the work is square in the number of features. Features are dealt into blocks; a row
    goes once to each pair of blocks with its own, and pairs of blocks are joined on their key. That spreads the work
    evenly over tasks without a cross join. There are as many pairs of blocks as the tasks need, so a row moves about
    sqrt(2 * tasks) times, however many rows there are.
    """
    spark = features.sparkSession
    tasks = PAIRS_A_TASK * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, min(-(-features.count() // block_rows), math.ceil((2 * tasks) ** 0.5)))
    rows = features.select("source_id", "data", F.pmod(F.xxhash64("source_id"), F.lit(blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select(F.col("source_id").alias("i"), F.col("data").alias("a"), F.col("block").alias("p"), F.explode(F.filter(others, lambda k: k >= F.col("block"))).alias("q"))
    right = rows.select(F.col("source_id").alias("j"), F.col("data").alias("b"), F.col("block").alias("q"), F.explode(F.filter(others, lambda k: k <= F.col("block"))).alias("p"))
    met = spread(left, "p", "q").join(spread(right, "p", "q"), ["p", "q"]).where((F.col("p") < F.col("q")) | (F.col("i") < F.col("j")))
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), score(F.col("a"), F.col("b")).alias("score"))


def typicality(features: DataFrame, h: float = BANDWIDTH, score: Callable[[Column, Column], Column] = similarity, compat: bool = True) -> DataFrame:
    """source_id, score: t1 (own kernel + 2 * sum of kernels with all others).

    The kernel is taken of likeness, so sources unlike the others score highest; compat=False takes it of 1 - likeness, as
    the method was published. The likeness of a source with itself is 1, or NaN for an empty text.
    """
    n = features.count()
    t1, t2 = bandwidths(F.lit(n), h)
    turned = (lambda s: s) if compat else (lambda s: F.lit(1.0) - s)
    kernel = lambda s: gaussian_kernel(turned(s), F.lit(1.0), t2)
    pairs = pair_scores(features, score).withColumn("w", kernel(F.col("score")))
    sums = pairs.select(F.explode(F.array("i", "j")).alias("source_id"), "w").groupBy("source_id").agg(F.sum("w").alias("others"))
    own = features.select("source_id", kernel(score(F.col("data"), F.col("data"))).alias("own"))
    return own.join(sums, "source_id", "left").select("source_id", (t1 * (F.col("own") + 2 * F.coalesce("others", F.lit(0.0)))).alias("score"))


def top_typical(sources: DataFrame, k: int, h: float = BANDWIDTH, processor: Processor | None = None, compat: bool = True) -> DataFrame:
    """source_id, score, rank of the k most typical sources; NaN first, ties by source_id. None of no sources or for k < 1."""
    processor = processor or Processor()
    scored = typicality(processor.feature(sources).select("source_id", "data"), h, processor.score, compat)
    best = scored.orderBy(F.desc("score"), "source_id").limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source_id")))


def regions(features: DataFrame, typical: DataFrame, score: Callable[[Column, Column], Column] = similarity, compat: bool = True) -> DataFrame:
    """rep_id, member_id: for every source that is not typical (source_id, rank), the typical one that stands for it.

    The typical ones are gone through in order of rank, and the one held gives way to the next if the member is more like
    the next than the one held is like the next; a comparison with NaN is false. compat=False: to the likest. Without
    typical sources all members are under null. Each member meets each of the k typical ones by rank, an ordinary join that
    Spark broadcasts if the typical ones are small; what they are like one another, k * k numbers, comes from the driver.
    """
    reps = write_table(features.join(typical, "source_id").select("rank", F.col("source_id").alias("rep_id"), F.col("data").alias("rep_data")), "typical-features")
    members = features.join(typical.select("source_id"), "source_id", "left_anti").select(F.col("source_id").alias("member_id"), "data")
    ranks = sorted(r["rank"] for r in reps.select("rank").collect())
    if not ranks:
        return members.select(F.lit(None).cast(features.schema["source_id"].dataType).alias("rep_id"), "member_id")
    every = F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank")
    met = members.select("member_id", "data", every).join(reps, "rank").select("member_id", "rank", "rep_id", score(F.col("data"), F.col("rep_data")).cast("double").alias("like"))
    if compat:
        later = reps.select(F.col("rank").alias("next"), F.col("rep_data").alias("next_data"))
        both = reps.select("rank", "rep_data", F.explode(F.array(*[F.lit(r) for r in ranks])).alias("next")).where("rank < next").join(later, "next")
        known = {(r["rank"], r["next"]): r["like"] for r in both.select("rank", "next", score(F.col("rep_data"), F.col("next_data")).cast("double").alias("like")).collect()}
        among = F.array(*[F.array(*[F.lit(known.get((a, b))).cast("double") for b in ranks]) for a in ranks])
        place = lambda x: F.array_position(F.array(*[F.lit(r) for r in ranks]), x["rank"]).cast("int")
        against = lambda best, x: F.element_at(F.element_at(among, place(best)), place(x))
    else:
        against = lambda best, x: best["like"]
    more = lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(False)).otherwise(x > y)
    listed = met.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rep_id", "like"))).alias("reps"))
    chosen = F.aggregate("reps", F.element_at("reps", 1), lambda best, x: F.when((x["rank"] != best["rank"]) & more(x["like"], against(best, x)), x).otherwise(best))
    return listed.select(chosen["rep_id"].alias("rep_id"), "member_id")


def region_lists(region: DataFrame) -> DataFrame:
    """rep_id, members: for regions small enough to be one value; else take the rows of regions() as they are."""
    return region.groupBy("rep_id").agg(F.array_sort(F.collect_list("member_id")).alias("members"))


def representatives(sources: DataFrame, k: int = TYPICAL, processor: Processor | None = None, compat: bool = True) -> DataFrame:
    """rep_id, size, rank: typical sources by the number of sources they stand for, those of none left out."""
    processor = processor or Processor()
    features = write_table(processor.feature(sources).select("source_id", "data"), "features")
    typical = top_typical(features, k, processor=Processor(lambda f: f, processor.score), compat=compat)
    typical = write_table(typical.select("source_id", "rank"), "typical")
    region = regions(features, typical, processor.score, compat)
    sized = region.groupBy("rep_id").agg(F.count("*").cast("long").alias("size")).join(typical.select(F.col("source_id").alias("rep_id"), F.col("rank").alias("typical_rank")), "rep_id")
    return sized.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "typical_rank"))).select("rep_id", "size", "rank")
