"""N-gram Jaccard join: a grouped prefix join of documents' shingle sets, and the components of its links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.shared import BloomFilter, drop_tables, per_worker, release_memory, slices, spread_groups, table, write_table

WIDTH = 5
PERCENT = 80
#: Besides what a prefix must hold, this share of a set (percent) is looked at before a document is ruled out.
EXTRA = 15
#: Shingles that one task counts at once, on average; documents that one task compares with one another, on average.
RANGE_TOKENS, CHUNK = 500_000, 256
#: A shingle that so many different sets of one batch (BATCH rows at most) have is common: its sets do not meet in its range,
#: which therefore holds at most about COMMON / BATCH of all sets for any shingle. Common ones come last in the order of
#: shingles, as if they were in TOO_OFTEN sets.
COMMON, BATCH, TOO_OFTEN = 16, 4_000, 1 << 40
#: Orders of shingles whose least member brings similar documents together before the join.
ORDERS = 3
WORDS_HELD = 150_000


# Arithmetic of the threshold ---------------------------------------------------------------------------------------


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Shared members of sets of a and b members at the threshold: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Shared members with a linked set of any size; also the least size of such a set."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    return max(1, n * EXTRA // 100)


# Shingle sets --------------------------------------------------------------------------------------------------------


def shingler(width: int = WIDTH) -> Callable:
    """Text to its set of shingles as sorted distinct 64-bit hashes. Words are hashed once and remembered up to a bound."""
    import numpy as np
    import xxhash

    known: dict[bytes, int] = {}
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

    def shingle(text: str | None):
        # Both steps of bytes are ASCII's alone: lower() changes A-Z, split() cuts at the six white-space bytes.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join([b"short", *words]), seed=len(words))] if words else [], np.uint64)
        if len(known) > WORDS_HELD:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.array([known[w] for w in words], np.uint64)
        n = len(hashes) - width + 1
        value = hashes[:n] * odd[0]
        for k in range(1, width):
            value = (value ^ (value >> np.uint64(29))) * odd[k % 5] + hashes[k : k + n]
        value ^= value >> np.uint64(32)
        value *= odd[1]
        value ^= value >> np.uint64(29)
        return np.unique(value)

    return shingle


def signature(tokens) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def _held_shingler(width: int) -> Callable:
    return per_worker(f"shingler {width}", lambda: shingler(width))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, n (set size), sig (of the set), head: the least hashes of the set, enough to rule documents out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _held_shingler(width)
        for batch in slices(batches):
            sizes, sigs, heads = [], [], []
            for text in batch.column(1):
                tokens = shingle(text.as_py())
                n = len(tokens)
                sizes.append(n)
                sigs.append(signature(tokens) if n else None)
                heads.append(tokens[: n - least_shared(n, percent) + extra(n)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(heads, pa.binary())], names=["id", "n", "sig", "head"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, sig binary, head binary")


def dealt_tokens(rows: DataFrame, owner: str, tokens: str, ranges: int) -> DataFrame:
    """range, tokens, owners, common: hashes of all rows, dealt by their leading bits, in one packed row for each batch and range.

    Of a hash that is common in its batch, the range gets one note (common), and the pairs go to a range below 0 that is
    told by the owner: however many sets have it, they are spread over all tasks.
    """
    shift = 64 - max(0, ranges - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, BATCH):
            owners, parts = batch.column(0).to_pylist(), [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not parts:
                continue
            values, holders, often = _distinct(np.concatenate(parts), np.repeat(np.array(owners, np.int64), [len(x) for x in parts]))
            common = often >= COMMON
            noted = np.unique(values[common])
            of = lambda x: (x >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(x), np.int64)
            out: list[list] = [[], [], [], []]

            def put(key, value, holder, note) -> None:
                for column, x in zip(out, (int(key), value.tobytes(), holder.tobytes(), note.tobytes())):
                    column.append(x)

            rare, rare_of, noted_of = values[~common], holders[~common], of(noted)
            in_range, none = of(rare), np.empty(0, np.uint64)  # both rise, as values do
            for key in np.union1d(np.unique(in_range), np.unique(noted_of)):
                a, b = np.searchsorted(in_range, [key, key + 1])
                c, d = np.searchsorted(noted_of, [key, key + 1])
                put(key, rare[a:b], rare_of[a:b], noted[c:d])
            beside = _bucket_of(holders[common], ranges)
            for key in np.unique(beside):
                at = beside == key
                put(-1 - key, values[common][at], holders[common][at], none)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["range", "tokens", "owners", "common"])

    return rows.select(owner, tokens).mapInArrow(run, "range long, tokens binary, owners binary, common binary")


def _bucket_of(owners, buckets: int):
    import numpy as np

    return (owners.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets


def _distinct(tokens, owners):
    """Distinct (token, owner) pairs in order, and in how many of them each pair's token is."""
    import numpy as np

    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[new], owners[new]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, int)
    often = np.diff(np.append(first, len(tokens)))
    return tokens, owners, np.repeat(often, often)


def _met(packed: pa.Table):
    """Distinct (token, owner) pairs of a range in order, and in how many of them each pair's token is: TOO_OFTEN for common ones."""
    import numpy as np

    tokens, owners, often = _distinct(_unpacked(packed, "tokens", "u8"), _unpacked(packed, "owners", "i8"))
    if len(packed) and packed.column("range")[0].as_py() < 0:
        return tokens, owners, np.full(len(tokens), TOO_OFTEN, np.int64)
    noted = np.unique(_unpacked(packed, "common", "u8"))
    return tokens, owners, np.where(np.isin(tokens, noted), TOO_OFTEN, often).astype(np.int64)


def _packed_by_bucket(owners, buckets: int, **columns) -> pa.Table:
    """A row for each bucket of owners, with each column's values of the bucket in one binary.

    One row for each owner would come to as many rows as owners times ranges; this way there are as many as buckets
    times ranges, as few as blocks of a shuffle.
    """
    import numpy as np

    of = _bucket_of(owners, buckets)
    order = np.argsort(of, kind="stable")
    found, first = np.unique(of[order], return_index=True)
    ends = [*first[1:], len(order)]
    cut = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(first, ends)], pa.binary())
    release_memory()
    return pa.table({"bucket": pa.array(found, pa.int64()), "owners": cut(owners), **{name: cut(x) for name, x in columns.items()}})


def _unpacked(packed: pa.Table, name: str, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(packed.column(name).to_pylist()), kind)


def n_ranges(tokens: int) -> int:
    return 1 << max(4, (tokens // RANGE_TOKENS).bit_length())


# Stages of the join --------------------------------------------------------------------------------------------------


def classes_that_may_link(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """rep, sig, n of the classes of equal sets (groups) that may link to another one.

    By any order of shingles, the first n - least_shared(n) + k of two linked sets share k. By the order of hashes,
    then, a class must share extra(least_shared(n)) of its head with other classes, or it has no link. A set that has copies
    may count a common shingle more than once, which rules out less, never more.
    """
    total = sets.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0))).first()[0] // 8

    buckets = n_ranges(total)

    def shared(packed: pa.Table) -> pa.Table:
        import numpy as np

        _, owners, often = _met(packed)
        found, n = np.unique(owners[often > 1], return_counts=True)
        return _packed_by_bucket(found, buckets, counts=n.astype(np.int64))

    def summed(packed: pa.Table) -> pa.Table:
        import numpy as np

        found, at = np.unique(_unpacked(packed, "owners", "i8"), return_inverse=True)
        n = np.bincount(at, _unpacked(packed, "counts", "i8"), len(found)).astype(np.int64)
        return pa.table({"key": pa.array(found, pa.int64()), "shared": pa.array(n, pa.int64())})

    heads = sets.where("n > 0").select(F.xxhash64("sig").alias("key"), "head")
    dealt = dealt_tokens(heads, "key", "head", buckets)
    counts = dealt.groupBy("range").applyInArrow(shared, "bucket long, owners binary, counts binary").groupBy("bucket").applyInArrow(summed, "key long, shared long")
    least = F.expr(f"(n * {percent} + 99) div 100")
    wanted = F.greatest(F.lit(1), F.expr(f"least_ * {EXTRA} div 100"))
    return groups.where("rep is not null").withColumn("key", F.xxhash64("sig")).join(counts, "key").withColumn("least_", least).where(F.col("shared") >= wanted).select("rep", "sig", "n")


def whole_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """rep (the class's node), n, tokens of the classes (rep, sig, node): the texts of their representatives are read again."""
    chosen = BloomFilter(classes, "rep", classes.count(), least=1).mark(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")), "rep").where("maybe").drop("maybe")
    both = chosen.join(classes, "rep").select("node", "text", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _held_shingler(width)
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for node, text, sig in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tokens = shingle(text.as_py())
                if len(tokens) and signature(tokens) == sig:  # rows of one id may differ in text
                    for column, value in zip(out, (node, len(tokens), tokens.tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["rep", "n", "tokens"])

    return both.mapInArrow(run, "rep long, n long, tokens binary").dropDuplicates(["rep"])


def prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """rep, n, tokens, prefix, start, mins for the sets that may still link, rarest shingles first.

    Shingles are counted among these sets. Those of one set alone come first in its order; a set with fewer than
    least_shared(n) others is ruled out. prefix: from place start on, the shingles that a linked set must share one of.
    mins: the least hash of the set in each of several orders.
    """
    total = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    buckets = n_ranges(total)

    def counted(packed: pa.Table) -> pa.Table:
        import numpy as np

        tokens, owners, often = _met(packed)
        several = often > 1
        return _packed_by_bucket(owners[several], buckets, tokens=tokens[several], often=often[several].astype(np.int64))

    def order_sets(sets: pa.Table, seen: pa.Table) -> pa.Table:
        import numpy as np
        import xxhash

        odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(ORDERS)]
        owners, tokens, often = (_unpacked(seen, c, kind) for c, kind in (("owners", "i8"), ("tokens", "u8"), ("often", "i8")))
        order = np.lexsort((tokens, often, owners))
        owners, tokens = owners[order], tokens[order]
        found, first = np.unique(owners, return_index=True)
        place = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(owners)])))
        out: list[list] = [[] for _ in range(7)]
        for rep, n, whole_ in zip(*(sets.column(c).to_pylist() for c in ("rep", "n", "tokens"))):
            a, b = place.get(rep, (0, 0))
            least = least_shared(n, percent)
            if b - a < least:
                continue
            alone = n - (b - a)
            prefix = tokens[a : a + n - least + 1 - alone]
            values = np.frombuffer(whole_, np.uint64)
            mins = []
            for k in odd:
                h = values * k
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                mins.append(int(h.min().astype(np.int64)))
            for column, value in zip(out, (rep, n, whole_, prefix.astype(np.int64).tolist(), alone, xxhash.xxh3_128_digest(prefix.tobytes()), mins)):
                column.append(value)
        release_memory()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("rep", "n", "tokens", "prefix", "start", "group_key", "mins"), out, kinds)})

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            reps = np.array(batch.column(0).to_pylist(), np.int64)
            of = _bucket_of(reps, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *batch.columns], names=["bucket", "rep", "n", "tokens"])

    known = dealt_tokens(whole, "rep", "tokens", buckets).groupBy("range").applyInArrow(counted, "bucket long, owners binary, tokens binary, often binary")
    dealt = whole.select("rep", "n", "tokens").mapInArrow(bucketed, "bucket long, rep long, n long, tokens binary")
    schema = "rep long, n long, tokens binary, prefix array<long>, start long, group_key binary, mins array<long>"
    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(order_sets, schema)


def overlap(a, b) -> int:
    """Members that two sorted sets share."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links_within(packed: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(rep, least rep that it is connected to) by links among the sets of a table; pairs connected already are not compared."""
    import numpy as np

    reps = packed.column("rep").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in packed.column("tokens").to_pylist()]
    order = sorted(range(len(reps)), key=lambda k: (len(sets[k]), reps[k]))
    root = list(range(len(reps)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, k in enumerate(order):
        for j in reversed(order[:x]):
            if len(sets[j]) < least_shared(len(sets[k]), percent):
                break
            a, b = find(k), find(j)
            if a != b and overlap(sets[k], sets[j]) >= least_overlap(len(sets[k]), len(sets[j]), percent):
                root[max(a, b, key=lambda z: reps[z])] = min(a, b, key=lambda z: reps[z])
    return [(reps[k], reps[find(k)]) for k in range(len(reps)) if find(k) != k]


def near_links(ordered: DataFrame, percent: int) -> DataFrame:
    """a, b: connections found among sets with the same least shingle in one of several orders, in chunks of bounded size.

    Most links are within such chunks; what this stage misses, the join finds. Its use is that the join need not look
    at pairs which are connected already, of which a large group of near copies has very many.
    """
    rows = ordered.select("rep", "tokens", F.posexplode("mins").alias("order", "least"))
    salted, spread, sizes = spread_groups(rows, ["order", "least"], "rep", {"size": (F.count, "rep")}, ordered.count())
    chunk = F.pmod(F.xxhash64("rep", "order"), F.ceil(F.col("size") / CHUNK)).cast("int")
    spread = spread.join(sizes.where("size > 1"), ["order", "least"])
    chunks = salted.join(spread, ["order", "least", "salt"]).withColumn("chunk", chunk).repartition("order", "least", "chunk")

    def run(packed: pa.Table) -> pa.Table:
        found = links_within(packed, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return chunks.select("rep", "tokens", "order", "least", "chunk").groupBy("order", "least", "chunk").applyInArrow(run, "a long, b long")


def prefix_join(ordered: DataFrame, connected: DataFrame, percent: int) -> DataFrame:
    """a, b: the links between sets of different components (connected: node, component), every one that can join two.

    Sets with one prefix and size (and component) are one group. Groups meet by a shingle of their prefixes; the places
    it has bound the overlap of a pair whose first common shingle it is. In a bucket, groups of its most frequent
    component meet only groups of others. Of the group pairs left, the members that the groups are called by are verified
    on their whole sets first; where those do not link, all members are.
    """
    parts = ordered.join(connected.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    keys = ["group_key", "n", "component"]
    members = write_table(parts.select("rep", *keys, "prefix", "start"), "members")
    # A large family of near copies may have one prefix, size and component: its members meet their group in parts.
    salted, spread, groups = spread_groups(members, keys, "rep", {"group": (F.min, "rep"), "prefix": (F.first, "prefix"), "start": (F.first, "start")}, members.count())
    groups = write_table(groups, "groups")
    rows = groups.select("group", "n", "component", "start", F.posexplode("prefix").alias("at", "token")).select("token", "group", "n", "component", (F.col("start") + F.col("at")).alias("place"))
    rows = write_table(rows, "prefix-rows")
    shares = rows.groupBy("token", "component").agg(F.count("*").alias("groups"))
    buckets = shares.groupBy("token").agg(F.count("*").alias("components"), F.max_by("component", F.struct("groups", "component")).alias("main")).where("components > 1").select("token", "main")
    buckets = write_table(buckets, "shared-tokens")  # written, so that the join below is one that adaptive execution can split
    active = write_table(rows.join(buckets, "token"), "active-rows")
    side = lambda x: active.select(*[F.col(c).alias(c if c == "token" else f"{c}_{x}") for c in ("token", "group", "n", "component", "place", "main")])
    a, b = side("a").where("component_a <> main_a"), side("b")
    size_fits = (F.col("n_b") * 100 >= F.col("n_a") * percent) & (F.col("n_a") * 100 >= F.col("n_b") * percent)
    at_most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    once = (F.col("component_b") == F.col("main_b")) | (F.col("group_a") < F.col("group_b"))
    enough = at_most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    met = a.join(b, "token").where((F.col("component_a") != F.col("component_b")) & once & size_fits & enough).select("group_a", "group_b").distinct()
    met = write_table(met, "group-pairs")
    sets = lambda x: ordered.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            kept = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                kept.append(overlap(x, y) >= least_overlap(len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    verified = lambda pairs: pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")
    # A group is called by one of its members, and lies within a component: where these two link, no other two need to.
    first = write_table(verified(met.select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))), "first-links")
    left = met.join(first.select(F.col("a").alias("group_a"), F.col("b").alias("group_b")), ["group_a", "group_b"], "left_anti")
    of = salted.select("rep", *keys, "salt").join(spread.join(groups.select(*keys, "group"), keys), [*keys, "salt"]).select("rep", "group")
    pairs = left.join(of.select(F.col("group").alias("group_a"), F.col("rep").alias("a")), "group_a").join(of.select(F.col("group").alias("group_b"), F.col("rep").alias("b")), "group_b").select("a", "b")
    pairs = write_table(pairs.join(first, ["a", "b"], "left_anti").where((F.col("a") != F.col("b"))), "pairs")
    links = write_table(first.unionByName(verified(pairs)), "links")
    drop_tables(members, groups, rows, buckets, active, met, pairs, first)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id: the least id that a document reaches by links of Jaccard likeness percent or more.

    Sets are of distinct shingles of `width` words, lower-cased in A-Z, cut at ASCII white space. Documents with equal
    sets are one class. Classes without a possible link are ruled out by shares of common shingles (exact, no sampling);
    the rest are joined by prefixes. Sets are compared by 64-bit hashes of shingles and 128-bit hashes of sets.

    - Ids are whole numbers or what casts to them; give others a number first.
    - Null and empty texts have no shingles and link with nothing, not even with one another. A text with fewer words
      than width has one shingle, all its words.
    - A row with a null id takes the component of rows with an equal set; it has no other links.
    - Rows repeated in id stay repeated, each with the component of its own text. No rows give no rows. Other columns
      are ignored, whatever their names.
    """
    found = _components(docs, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, n, component, sig of each row, in a table. Nodes of the links are numbers of classes: an id may have several."""
    sets = write_table(shingle_sets(docs, id_col, text_col, width, percent), "sets")
    rows = sets.count()
    salted, spread, groups = spread_groups(sets.where("n > 0").select("id", "n", "sig"), ["sig", "n"], "id", {"rep": (F.min, "id")}, rows)
    groups = write_table(groups, "classes")
    classes = write_table(classes_that_may_link(sets, groups, percent).withColumn("node", F.monotonically_increasing_id()), "may-link")
    whole = write_table(whole_sets(docs, classes, id_col, text_col, width), "whole-sets")
    ordered = write_table(prefixes(whole, percent), "ordered")
    drop_tables(whole)
    near = write_table(near_links(ordered, percent), "near-links")
    first = connected_components(near)
    joined = prefix_join(ordered, first, percent)
    drop_tables(first, ordered)
    components = connected_components(near.unionByName(joined))
    drop_tables(near, joined)
    members = write_table(components.join(classes, "node").select("node", "component", "rep", "sig", "n"), "class-components")
    drop_tables(components, classes)
    salted_members, spread_members, tops = spread_groups(members, ["component"], "node", {"least_id": (F.min, "rep")}, rows)
    of = salted_members.join(spread_members.join(tops, "component"), ["component", "salt"]).select("sig", "n", "least_id")
    least = spread.join(groups.join(of, ["sig", "n"], "left").select("sig", "n", F.coalesce("least_id", "rep").alias("component")), ["sig", "n"])
    linked = salted.join(least, ["sig", "n", "salt"]).select("id", "n", "component", "sig")
    empty = sets.where("n = 0").select("id", "n", F.col("id").alias("component"), "sig")
    out = write_table(linked.unionByName(empty), "components")
    drop_tables(sets, groups, members)
    return out


def signed_texts(texts: DataFrame, width: int) -> DataFrame:
    """_id, text, _sig (of the set of the text, null for an empty one) for a table (_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _held_shingler(width)
        for batch in slices(batches):
            sets = [shingle(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(x) if len(x) else None for x in sets], pa.binary())], names=["_id", "text", "_sig"])

    return texts.mapInArrow(run, "_id long, text string, _sig binary")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the least of their component, all columns kept; of rows repeated in id and text, one.

    Rows of one id with different texts are judged each by its own component, for which their texts are read again.
    Rows without an id all stay, and so do texts without words. Rows in question are marked by a Bloom filter first;
    only marked rows shuffle, the rest go straight to the output. Nulls and empty tables as in jaccard_components().
    """
    found = _components(docs, id_col, text_col, width, percent)
    gone = F.col("component") != F.col("id")
    known = found.where("id is not null").groupBy(F.col("id").alias("_found")).agg(F.count("*").alias("n"), F.max(gone).alias("_gone"), F.min(gone).alias("_all_gone"))
    asked = write_table(known.where("_gone or n > 1").select("_found", "_gone", (F.col("_gone") != F.col("_all_gone")).alias("_mixed")), "asked")
    mixed = asked.where("_mixed").select(F.col("_found").alias("id"))
    gone_sets = write_table(found.where(gone).join(mixed, "id", "left_semi").select(F.col("id").alias("_id"), F.col("sig").alias("_sig")).distinct(), "gone-sets")
    drop_tables(found)
    marked = BloomFilter(asked, "_found", asked.count(), least=1).mark(docs.withColumn("_id", F.col(id_col).cast("long")), "_id", "_maybe")
    asked_of = F.col("_maybe") & F.col("_id").isNotNull()
    judged = marked.where(asked_of).join(asked, F.col("_id") == F.col("_found"), "left")
    staying = judged.where("not _gone")
    if gone_sets.limit(1).count():
        texts = judged.where("_mixed").select("_id", F.col(text_col).alias("text")).distinct()
        signed = signed_texts(texts, width).join(gone_sets, ["_id", "_sig"], "left_anti").select(F.col("_id").alias("_of"), F.col("text").alias("_text"))
        own = judged.where("_mixed").join(signed, (F.col("_id") == F.col("_of")) & F.col(f"`{text_col}`").eqNullSafe(F.col("_text")), "left_semi")
        staying = staying.unionByName(own)
    once = staying.dropDuplicates(["_id", text_col])
    parts = [marked.where(~asked_of), judged.where("_gone is null"), once]
    out = parts[0].select(*docs.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*docs.columns))
    return out


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
