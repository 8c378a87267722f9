"""Document fingerprints of closed syncmers, and how alike two are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import even_keys, slices, table

#: Scales, coarsest first: least code points of a text, length of a k-mer, and of the inner substrings whose least hash must
#: lie at an edge. 2 of K - S + 1 k-mers are chosen, and two neighbours lie at most K - S places apart. Texts also have the
#: anchors of finer scales, up to OVERLAP times the least length of the next coarser one: two texts without a common
#: scale differ in length by that much, so that hardly more than 1 / OVERLAP of the longer one could be alike.
SCALES = ((192, 24, 8), (24, 8, 3), (4, 4, 2))
OVERLAP = 8
#: Documents of one range of ids, on average, and ranges at most: what the driver holds of a corpus of any size.
TASK_ROWS, MOST_RANGES = 4_000, 10_000


def syncmers(text: str) -> dict:
    """Length of k-mers to (places, hashes) of the anchors of text in order, for each scale of the text; hashes have 24 bits.

    Anchors are closed syncmers: whether a k-mer is chosen depends on it alone, so equal passages have equal anchors
    wherever they stand. A text without any (shorter than any scale, or nearly) has one anchor for the whole of it, under
    length 0; an empty one has none.
    """
    import zlib

    import numpy as np

    n, out = len(text), {}
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for k, (least, size, inner_size) in enumerate(SCALES):
        if least <= n and (not k or n < OVERLAP * SCALES[k - 1][0]):
            found = closed_syncmers(points, size, inner_size)
            if len(found[0]):
                out[size] = found
    if n and not out:
        out[0] = (np.zeros(1, np.int64), np.full(1, zlib.crc32(text.encode("utf-8", "surrogatepass")) & 0xFFFFFF, np.uint32))
    return out


def closed_syncmers(points, size: int, inner_size: int):
    """(places, hashes) of the k-mers of `size` points whose least substring of inner_size lies at either edge."""
    import numpy as np

    n = len(points)
    odd, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    inner = np.zeros(n - inner_size + 1, np.uint64)
    for k in range(inner_size):
        inner *= odd
        inner += points[k : n - inner_size + 1 + k]
    inner ^= inner >> np.uint64(31)
    inner *= mix
    inner ^= inner >> np.uint64(29)
    window = size - inner_size + 1
    least, span = inner, 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    last = n - size + 1
    places = np.flatnonzero((inner[:last] == least) | (inner[size - inner_size : size - inner_size + last] == least))
    value = np.full(len(places), size, np.uint64)
    for k in (*range(0, size - inner_size, inner_size), size - inner_size):
        value = (value ^ inner[places + k]) * mix
        value ^= value >> np.uint64(32)
    return places, (value & np.uint64(0xFFFFFF)).astype(np.uint32)


def encode(found: dict) -> str:
    """The fingerprint: for each scale its length, and base64 of each anchor's hash (24 bits) and steps from the one before (8 bits)."""
    import base64

    import numpy as np

    def packed(places, hashes) -> str:
        gaps = np.minimum(np.diff(places, prepend=0), 255).astype(np.uint32)
        return base64.b64encode((hashes << np.uint32(8) | gaps).astype("<u4").tobytes()).decode()

    return ",".join(f"{size}:{packed(*anchors_)}" for size, anchors_ in found.items())


def anchors(fingerprint: str) -> dict:
    """What encode() was given."""
    import base64

    import numpy as np

    out = {}
    for part in filter(None, fingerprint.split(",")):
        size, _, coded = part.partition(":")
        both = np.frombuffer(base64.b64decode(coded), "<u4")
        out[int(size)] = (np.cumsum(both & 255), both >> 8)
    return out


def likeness(a: str, b: str) -> float:
    """Anchors that match in order, over all anchors of both, on the coarsest scale that both have: 1 for equal
    fingerprints, 0 if no scale or no anchor is shared.

    The n-th anchor of a hash in one matches the n-th in the other; of the matches, a longest chain that rises in both
    texts counts. Two empty fingerprints are alike.
    """
    from bisect import bisect_left

    if a == b:
        return 1.0
    one, two = anchors(a), anchors(b)
    common = [size for size in one if size in two]
    if not common:
        return 0.0
    left, right = one[common[0]][1].tolist(), two[common[0]][1].tolist()
    waiting: dict[int, list[int]] = {}
    for k in range(len(right) - 1, -1, -1):
        waiting.setdefault(right[k], []).append(k)
    chain: list[int] = []
    for h in left:
        if own := waiting.get(h):
            k = own.pop()
            at = bisect_left(chain, k)
            chain[at : at + 1] = [k]
    return len(chain) / (len(left) + len(right) - len(chain))


def edit(text: str, next_text: str) -> str:
    """text with its last third (rounded down) replaced by as much of the start of next_text."""
    n = len(text) // 3
    return text[: len(text) - n] + next_text[:n]


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint: one row for each row of docs, without a shuffle.

    Null text counts as empty, whose fingerprint is empty. Texts are read whole. Null ids are kept, repeated rows
    repeated; no rows give no rows; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(syncmers(t)) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text as edited with the next document's start, and how alike they are.

    The next document is the one with the next smaller id; after the smallest comes the largest. Rows of one id follow
    by a hash of the text, then by text. Ids are cut into ranges by their quantiles, an id that is several quantiles (and
    no id at all) into ranges of that hash; each range goes to a task in order, and the first row of a
    range also goes to the range before it, which needs it as its last row's next. Only two numbers for each range, and
    never a text, reach the driver.

    - Ids are whole numbers or what casts to them; give others a number first.
    - Null ids come after all others. Null text counts as empty. No rows give no rows. Rows equal in id and text are of
      one range, which a task reads row by row and never holds.
    - Rows repeated in id and text are neighbours of each other. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
    n, unknown = counted["n"], counted["n"] - counted["known"]
    ranges = min(MOST_RANGES, max(1, -(-n // TASK_ROWS)))
    quantiles = (rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []) if ranges > 1 else []
    cuts = sorted(set(quantiles), reverse=True)
    # Group 0 has the ids above all cuts; group k those from the k-th cut down, the cut's own id apart if it is often; the last has no id.
    often = [quantiles.count(c) for c in cuts]
    wide = [1, *(m + 1 if m > 1 else 1 for m in often), max(1, min(MOST_RANGES, -(-unknown // TASK_ROWS)))]
    start = [sum(wide[:k]) for k in range(len(wide) + 1)]
    longs = lambda values: F.array(*[F.lit(c).cast("long") for c in values]).cast("array<long>")
    # A group is found in two steps, among blocks of cuts, then in one.
    block = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + block] for k in range(0, len(cuts), block)] or [[]]
    above = lambda values: F.size(F.filter(values, lambda c: c >= F.col("id")))
    in_block = above(longs([x[0] for x in blocks[1:] if x]))
    group = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(in_block * block + above(F.element_at(F.array(*map(longs, blocks)), in_block + 1))).cast("int")
    hashed = rows.withColumn("h", F.xxhash64("text")).withColumn("group", group)
    at = lambda values: F.element_at(longs(values), F.col("group") + 1)
    part = lambda of: F.least(F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * of), of - 1)
    own_cut = F.col("id") == at([0, *cuts, 0])
    inside = F.when(F.col("id").isNull(), part(at(wide))).when(at(wide) == 1, 0).when(own_cut, part(at(wide) - 1)).otherwise(at(wide) - 1)
    ranged = hashed.withColumn("range", (at(start[:-1]) + inside).cast("int")).withColumn("turned", F.bitwise_not("h")).drop("group")
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.max(F.struct("id", "turned")).alias("first")).collect()}
    order, n_ranges = sorted(firsts), start[-1]
    before = {r: order[k - 1] for k, r in enumerate(order)}  # the range that needs this one's first row; the first is needed by the last
    of_range = lambda values: F.element_at(F.array(*[F.lit(values.get(r)).cast("long") for r in range(n_ranges)]), F.col("range") + 1)
    first_id, first_hash = ({r: x[k] for r, x in firsts.items()} for k in (0, 1))
    is_first, to = of_range(first_id).eqNullSafe(F.col("id")) & (of_range(first_hash) == F.col("turned")), of_range(before).cast("int")
    own = F.struct(F.col("range").alias("range"), F.lit(True).alias("own"))
    dealt = ranged.select("id", "h", "text", F.explode(F.when(is_first, F.array(own, F.struct(to.alias("range"), F.lit(False).alias("own")))).otherwise(F.array(own))).alias("to"))
    # Every range goes to a task of its own: dealt by hash of its number, some tasks would get several and some none.
    keys = F.array(*[F.lit(k).cast("long") for k in even_keys(docs.sparkSession, n_ranges)])
    dealt = dealt.select("id", "h", "text", "to.*").repartition(n_ranges, F.element_at(keys, F.col("range") + 1)).sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("id"), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        waiting = None  # a row whose next is not known yet: range, id, text, fingerprint
        out: list[list] = [[] for _ in kinds]

        def emit(row, next_text: str, next_print: str) -> None:
            from hashlib import sha256

            _, id_, text, mark = row
            edited = edit(text, next_text)
            edited_mark = mark if edited == text else encode(syncmers(edited))
            for column, value in zip(out, (id_, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_print))):
                column.append(value)

        closed = None  # the range whose borrowed rows have given the one that was needed
        for batch in slices(batches):
            for id_, text, range_, is_own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "range", "own"))):
                if not is_own and closed == range_:
                    continue
                mark = encode(syncmers(text))
                if waiting is not None:
                    emit(waiting, text, mark)
                waiting = (range_, id_, text, mark) if is_own else None
                closed = None if is_own else range_
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            out = [[] for _ in kinds]

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
