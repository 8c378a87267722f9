"""Sources from files and tables, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import entry_signature, lines, method_signature, unix_lines  # noqa: F401

SOURCES = "source_id long, name string, content string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a file or folder; a path that cannot be read is an error."""
    return spark.read.text(path)


def drop_named(files: DataFrame, keywords: list[str], column: str = "file_name") -> DataFrame:
    """files without those whose name contains every keyword; without keywords nothing is dropped."""
    every = F.lit(bool(keywords))
    for word in keywords:
        every = every & F.contains(F.col(column), F.lit(word))
    return files.where(~every)


def collect_files(spark: SparkSession, path: str, extension: str, keywords: list[str] | None = None) -> DataFrame:
    """path, file_name, value (whole text) of all files below path with the extension; unreadable ones are left out."""
    found = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "value")
    )
    return drop_named(found, keywords or [])


def file_sources(files: DataFrame) -> DataFrame:
    """source_id, name, content: a row for each different (name, content).

    The name is the file's without its last extension; lines end in one line feed each but the last, which has none.
    """
    name = F.regexp_replace("file_name", r"\.[^.]*$", "")
    content = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"\n\z", "")
    return numbered(files.select(name.alias("name"), content.alias("content")))


def table_sources(rows: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """Sources of a table that has ids of its own."""
    name = F.col(name_col) if name_col else F.col(id_col).cast("string")
    return rows.select(F.col(id_col).cast("long").alias("source_id"), name.alias("name"), F.col(text_col).alias("content"))


def numbered(sources: DataFrame) -> DataFrame:
    """Distinct (name, content) with a source_id made of both."""
    distinct = sources.dropDuplicates(["name", "content"])
    return distinct.select(F.xxhash64("name", "content").alias("source_id"), "name", "content")


def populate(entries: DataFrame, files: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(sources, relevant): entries are path::method(types)::type or paths; files as of collect_files().

    sources are the files that an entry names, relevant the different names of methods.
    """
    parts = entries.select(entry_signature(F.col(column)).alias("parts"))
    named = parts.select(F.element_at("parts", 1).alias("path"), F.when(F.size("parts") > 1, F.element_at("parts", 2)).alias("signature"))
    wanted = named.select("path").distinct()
    plain = files.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    relevant = named.where("signature is not null").select(F.element_at(method_signature(F.col("signature")), 1).alias("name")).distinct()
    return file_sources(plain.join(wanted, "path", "left_semi")), relevant


def content_lines(sources: DataFrame) -> DataFrame:
    """source_id, line_no (from 0), line."""
    return sources.select("source_id", F.posexplode(lines(unix_lines(F.col("content")))).alias("line_no", "line"))


# Sinks


def write_file(spark: SparkSession, path: str, text: str) -> str:
    """Writes one small text, to any store that Spark reaches; what was at path goes first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(text.encode("utf-8"))
    out.close()
    return path


def write_snippets(results: DataFrame, path: str) -> str:
    """Writes name: and the snippet's lines of each result (name, snippet, rank) as text; what was at path goes first."""
    shown = results.select("rank", F.concat("name", F.lit(":\n"), F.coalesce("snippet", F.lit(""))).alias("value"))
    shown.orderBy("rank").select("value").write.mode("overwrite").text(path)
    return path


def print_snippets(results: DataFrame) -> list[str]:
    """Prints name, snippet and an empty line of each result; returns what was printed. For the few rows of a top-k."""
    shown = [f"{r['name']}\n{r['snippet'] or ''}\n" for r in results.orderBy("rank").toLocalIterator()]
    for text in shown:
        print(text)
    return shown


def print_concepts(concepts: DataFrame, order: str = "rank") -> str:
    """Prints a list of words in order; returns what was printed."""
    shown = "[" + ", ".join(r["word"] for r in concepts.orderBy(order).toLocalIterator()) + "]"
    print(shown)
    return shown


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank from 1. For the result of a top-k: all rows meet in one task."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
