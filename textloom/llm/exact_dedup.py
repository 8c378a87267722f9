"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import BloomFilter, ascii_lower, spread_groups, table, write_table


#: Bits of a filter, at most, which bounds what is broadcast (128 MB); rows that one filter is made for: 16 bits a row.
MAX_BITS = 2**30
BITS_A_ROW = 16


def _parts(rows: DataFrame, key: str, n: int, max_bits: int, name: str) -> list[DataFrame]:
    """rows in as many parts, by a hash of the key, as keep every part's filter within max_bits. One part is rows as they
    are; more are written apart (no shuffle: each task writes to every part), so that a part is read alone."""
    parts = max(1, -(-n * BITS_A_ROW // max_bits))
    if parts == 1:
        return [rows]
    table = write_table(rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(parts)).cast("int")), name, by=["_part"])
    return [table.where(F.col("_part") == k).drop("_part") for k in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sha(docs: DataFrame, text_col: str):
    return F.sha2(ascii_lower(F.col(f"`{text_col}`")).cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Of equal texts, the row with the largest id stays; one row comes back for each row of docs.

    Columns: id_col, keep_id, group_size, kept, text_sha256. Texts are equal if the same after lower-casing A-Z.
    Texts are read once, for digests; beyond 67 million rows (max_bits / 16) these are cut by hash into parts with a filter each.

    - Null text counts as empty; all empty texts are one group. A null id is smaller than any other.
    - Rows repeated in id and text are one group, of which exactly one row is kept.
    - No rows give no rows; columns beside the two named are ignored, whatever their names.
    """
    digests = docs.select(F.col(id_col).alias("id"), _sha(docs, text_col).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    digests = write_table(digests, "digests")  # a few dozen bytes for each document
    rows, out = digests.count(), []
    parts = _parts(digests, "sha", rows, max_bits, "digest-parts")
    for part in parts:
        marked = BloomFilter(part, "sha", -(-rows // len(parts)), max_bits=max_bits).mark(part, "sha")
        once = marked.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        maybe = marked.where("maybe").select("id", "sha", "rid", F.struct("id", "rid").alias("place"))
        salted, spread, groups = spread_groups(maybe, ["sha"], "rid", {"last": (F.max, "place"), "group_size": (F.count, "rid")}, rows)
        again = salted.join(spread.join(groups, "sha"), ["sha", "salt"]).select(
            "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"), "sha"
        )
        out += [once, again]
    return _union(out).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns kept.

    Only rows whose hash may be repeated shuffle; the rest go straight from scan to output. Rows equal in id and text
    become one in map tasks; the rest of a group meet its greatest id by text and id, so no group meets in one task. Nulls,
    ties and empty tables as in exact_dedup().
    """
    names = docs.columns
    digests = write_table(docs.select(_sha(docs, text_col).alias("sha")), "digests")
    rows, out = digests.count(), []
    hashed = _parts(docs.withColumn("_sha", _sha(docs, text_col)), "_sha", rows, max_bits, "hashed-parts")
    filters = _parts(digests, "sha", rows, max_bits, "digest-parts")
    for part, own in zip(hashed, filters):
        marked = BloomFilter(own, "sha", -(-rows // len(filters)), max_bits=max_bits).mark(part, "_sha", "_maybe")
        maybe = marked.where("_maybe").dropDuplicates(["_sha", id_col])
        last = marked.where("_maybe").groupBy(F.col("_sha").alias("_of")).agg(F.max(F.struct(F.col(id_col).alias("id"))).alias("_last"))
        kept = maybe.join(last, (F.col("_sha") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_last.id")))
        out += [marked.where(~F.col("_maybe")).select(*names), kept.select(*names)]
    return _union(out)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)
        WINDOW g AS (PARTITION BY sha)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
