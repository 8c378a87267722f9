"""Helpers that several operators use: shared tables, text normalisation, repeat filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.tables import drop_tables, write_table  # noqa: F401  the operators take them from here

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; plain ASCII takes the faster built-in, which does the same there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """The fold rule: crc32 of the id as text, divisible by five. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class BloomFilter:
    """A Bloom filter of the keys that may occur at least `least` times: twice to find repeats, once for membership.

    Pass one counts, for two slots of each key's hash, how often a slot is hit (map tasks sum before the shuffle, so
    a slot hit by a third of all rows costs one row a task) and sets the bits of slots hit often enough. A key both
    of whose bits are set may occur that often; any other does not for certain.

    The bits are rows of 4 KB; there are at most max_bits / 8 bytes of them, so broadcasting them is safe at
    any size. Beyond max_bits / 16 keys the filter lets more rows through to the exact stage that must follow it.
    """

    BLOCK = 32768

    def __init__(self, hashes: DataFrame, key: str, rows: int, least: int = 2, max_bits: int = 2**30):
        self.bits = min(max_bits, max(self.BLOCK, 1 << (16 * max(rows, 1) - 1).bit_length()))
        hits = hashes.select(F.explode(F.array(*self._slots(F.col(key)))).alias("slot")).groupBy("slot").agg(F.count("*").alias("hits"))
        self.table = (
            hits.where(F.col("hits") >= least)
            .groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("set_bits"))
        )

    def _slots(self, key: Column) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(self.bits))

    def mark(self, df: DataFrame, key: str, name: str = "maybe") -> DataFrame:
        """df with a boolean column: may the key be in the filter? No row is shuffled."""
        kept, marks = df.columns, []
        for k, slot in enumerate(self._slots(F.col(key))):
            part = self.table.select(F.col("block").alias(f"_block{k}"), F.col("set_bits").alias(f"_bits{k}"))
            df = df.withColumn(f"_slot{k}", slot).withColumn(f"_block{k}", F.expr(f"1 + _slot{k} div {self.BLOCK}"))
            df = df.join(F.broadcast(part), f"_block{k}", "left")
            byte = F.expr(f"cast(conv(hex(substring(_bits{k}, cast(pmod(_slot{k}, {self.BLOCK}) div 8 + 1 as int), 1)), 16, 10) as int)")
            marks.append(F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(_slot{k}, 8) as int))")) != 0, F.lit(False)))
        return df.select(*[F.col(f"`{c}`") for c in kept], (marks[0] & marks[1]).alias(name))


def per_worker(key: str, make):
    """What make() gives, made once in each Python worker and not once for each task; only the last such thing is held."""
    import sys

    held = sys.__dict__.setdefault("_held_by_worker", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def spread_groups(rows: DataFrame, keys: list[str], by: str, totals: dict, n_rows: int, least_salts: int = 64, rows_a_salt: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group totals that reach the rows of a group of any size: (rows with a salt, a row for each key and salt, groups).

    Join the groups to the second table on keys, and that to the first on keys and salt: then a group that holds a
    third of all rows is summed in parts and meets its total in as many tasks. totals: name to (aggregate, column).
    """
    salts = max(least_salts, n_rows // rows_a_salt)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, "salt").agg(*[f(F.col(c)).alias(name) for name, (f, c) in totals.items()])
    again = {name: F.sum if f in (F.count, F.sum) else f for name, (f, _) in totals.items()}
    groups = parts.groupBy(*keys).agg(*[f(F.col(name)).alias(name) for name, f in again.items()])
    return salted, parts.select(*keys, "salt"), groups


def least_hashes(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """The rows of the `most` ids with the least hashes: a sample that does not depend on where rows lie.

    Hashes above what half as many again would need are dropped first, so that few rows, and not `most` of every task,
    meet where they are ordered.
    """
    share = min(1.0, 1.5 * most / max(1, ids.count()))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    return ids.where(F.xxhash64(id_col) <= F.lit(bound).cast("long")).orderBy(F.xxhash64(id_col), id_col).limit(most)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers, of which repartition(n, column of them) sends the k-th to partition k: one group a task, none in two."""
    ids = spark.range(n * (n.bit_length() + 8)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))
    found = {r["part"]: r["id"] for r in ids.groupBy("part").agg(F.min("id").alias("id")).collect()}
    return [found.get(k, -1 - k) for k in range(n)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, which bounds what is held beside a batch; frees the worker's memory at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release_memory()


def release_memory() -> None:
    """Gives memory that the allocators hold back to the system: workers live on from task to task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
