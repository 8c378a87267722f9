"""Command line: concepts, typical, represent. Exit code 0, or -1 (255 in a shell) where the arguments make no sense."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import concepts, segmentation, typicality
from textloom.operators.spelling import build_dictionary
from textloom.sources import files

EXTENSION = "java"
SKIPPED = ["test", "Test"]
MOST_TARGETS = 100
RESULT_FILE = "typicalset.txt"


def all_null(*values) -> bool:
    return all(v is None for v in values)


def all_non_null(expected: int, *values) -> bool:
    """Are exactly that many values given, and all of them?"""
    return len(values) == expected and all(v is not None for v in values)


def session() -> SparkSession:
    return SparkSession.builder.appName("textloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def from_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    return files.file_sources(files.collect_files(spark, folder, EXTENSION, SKIPPED)), []


def from_entries(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Sources that a file of entries names, and the method names in it. Entries are few: they are what a user lists."""
    entries = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
    paths = [r["path"] for r in entries.select(F.element_at(files.entry_signature(F.col("line")), 1).alias("path")).distinct().toLocalIterator()]
    found = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "value")
    sources, relevant = files.populate(entries, found)
    return sources, sorted(r["name"] for r in relevant.toLocalIterator())


def from_targets(spark: SparkSession, targets: list[str]) -> tuple[DataFrame, list[str]]:
    found = spark.read.text(targets, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "value")
    return files.file_sources(found), []


def _chosen(spark: SparkSession, args) -> tuple[DataFrame, list[str]] | None:
    """Sources by the option that counts most: targets, then entries, then folder."""
    if getattr(args, "targets", None):
        return from_targets(spark, args.targets)
    if args.file is not None:
        return from_entries(spark, args.file)
    if args.directory is not None:
        return from_folder(spark, args.directory)
    return None


def _dictionary(spark: SparkSession, path: str | None) -> DataFrame | None:
    return build_dictionary(spark.read.text(path), "value") if path else None


def run_concepts(args, spark: SparkSession | None = None) -> int:
    if all_null(args.file, args.directory) or args.top < 1:
        return -1
    spark = spark or session()
    sources, relevant = _chosen(spark, args)
    found = concepts.corpus_concepts(sources, _dictionary(spark, args.dictionary), relevant, args.top)
    files.print_concepts(files.ranked(found, F.desc("n"), "word"))
    return 0


def _code_features(relevant: list[str]) -> typicality.Processor:
    return typicality.Processor(lambda sources: segmentation.segments_code(sources, segmentation.parse_sources(sources, relevant, wanted=("unit", "segments", "error"))).withColumn("data", F.coalesce("data", F.lit(""))))


def _snippets(sources: DataFrame, relevant: list[str], chosen: DataFrame) -> DataFrame:
    code = segmentation.unit_code(sources, segmentation.parse_sources(sources, relevant)).select("source_id", F.col("data").alias("snippet"))
    return chosen.join(sources.select("source_id", "name"), "source_id").join(code, "source_id").select("rank", "name", "snippet")


def run_typical(args, spark: SparkSession | None = None) -> int:
    if all_null(args.targets, args.file, args.directory) or all_non_null(3, args.targets, args.file, args.directory) or args.top < 1:
        return -1
    if args.targets and len(args.targets) > MOST_TARGETS:
        return -1
    spark = spark or session()
    sources, relevant = _chosen(spark, args)
    best = typicality.top_typical(sources, args.top, args.bandwidth, _code_features(relevant))
    shown = _snippets(sources, relevant, best)
    if os.path.exists(RESULT_FILE):
        os.remove(RESULT_FILE)
    if args.echo:
        files.print_snippets(shown)
    else:
        # The k results of a top-k are written by the driver, into one file beside it.
        with open(RESULT_FILE, "w", encoding="utf-8") as out:
            out.writelines(f"{r['name']}:\n{r['snippet'] or ''}\n" for r in shown.orderBy("rank").toLocalIterator())
        print(os.path.abspath(RESULT_FILE))
    return 0


def run_represent(args, spark: SparkSession | None = None) -> int:
    if all_null(args.targets, args.file, args.directory) or all_non_null(3, args.targets, args.file, args.directory):
        return -1
    if args.targets and len(args.targets) > MOST_TARGETS:
        return -1
    spark = spark or session()
    sources, relevant = _chosen(spark, args)
    found = typicality.representatives(sources, processor=_code_features(relevant)).where("rank = 1").select(F.col("rep_id").alias("source_id"), "rank")
    files.print_snippets(_snippets(sources, relevant, found))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, about: str, targets: bool):
        one = commands.add_parser(name, help=about)
        one.set_defaults(run=run)
        if targets:
            one.add_argument("-t", "--targets", nargs="+", help=f"files, {MOST_TARGETS} at most")
        one.add_argument("-f", "--file", help="file of entries: path::method(types)::type")
        one.add_argument("-d", "--directory", help="folder of sources")
        return one

    one = command("concepts", run_concepts, "words that the sources are about", False)
    one.add_argument("-k", "--top", type=int, default=10)
    one.add_argument("--dictionary", help="text whose words spell-correct those of the sources")
    one = command("typical", run_typical, "most typical sources", True)
    one.add_argument("-k", "--top", type=int, default=1)
    one.add_argument("-b", "--bandwidth", type=float, default=typicality.BANDWIDTH)
    one.add_argument("-e", "--echo", action="store_true", help="print, write no file")
    command("represent", run_represent, "the source that represents most others", True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
