"""The corpus pipeline: documents that a text must pass on its way into training sequences.

Each stage takes all that its predecessor kept and returns the columns of documents, but for the last, which returns
the pieces of the packed sequences.

All stages take any columns beside doc_id, text and source, whatever their names, and give them back as they are; no rows
give no rows; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.exact_dedup import drop_copies
from textloom.llm.jaccard_join import one_of_each_component
from textloom.llm.mixing import mixed_documents
from textloom.llm.packing import pack_documents
from textloom.llm.shared import drop_tables, write_table
from textloom.llm.toxicity import fit, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic less likely than not.

    Null and empty texts are scored as one empty sentence, and stay as they are. Equal rows share their fate, repeated
    ones all stay or all go; a null id does not matter. Without labels of both kinds there is nothing to learn, and all stay.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    of = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # no column may clash with those of the scores
    scored = score_toxicity(docs.toDF(*of.values()), model, of["doc_id"], of["text"], keep=tuple(x for c, x in of.items() if c != "doc_id"))
    return scored.where("score < 0.5").select(*of.values()).toDF(*of)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest id.

    Null counts as empty, so one of all null and empty texts stays; a null id is the least. Of rows repeated in id and
    text one stays.
    """
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by Jaccard likeness, the one with the least id.

    Documents without words (null and empty texts too) all stay, and so do rows without an id. Rows of one id with
    different texts are judged each by its own text; of rows repeated in both, one stays.
    """
    return one_of_each_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own. Null and empty texts have no words, and so no weight in the mix; they are taken
    as often as others of a word. Rows of one id and size share their fate, also where they decide how near the target is met.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of 2048 ids.

    Null and empty texts are one end id each. Copies and repeated rows are packed as often as they occur; a null id is kept.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]
#: Learned scores and a search for packings are beyond SQL; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
