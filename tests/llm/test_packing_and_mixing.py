import hashlib
import itertools
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm.bin_completion import EXACT, best_fit, complete, lower_bound
from textloom.llm.mixing import SQL, mix_sources, mixed_documents, source_targets
from textloom.llm.packing import COMMON, default_tokenizer, load_tokenizer, pack_documents


def fewest(lengths, capacity):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for n, room in enumerate(bins):
            if room >= lengths[k]:
                place(k + 1, [*bins[:n], room - lengths[k], *bins[n + 1 :]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best


def is_packing(bins, lengths, capacity):
    return sorted(itertools.chain(*bins)) == sorted(n for n in lengths if n) and all(sum(b) <= capacity for b in bins)


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(1, 14) for _ in range(rng.randint(1, 9))]
        bins = complete(lengths, 14, EXACT)
        assert is_packing(bins, lengths, 14) and len(bins) == fewest(lengths, 14)
        assert lower_bound(lengths, 14) <= len(bins) <= len(complete(lengths, 14)) <= len(best_fit(lengths, 14))


@pytest.mark.parametrize(("low", "high", "capacity", "most"), [(600, 1100, 2048, 900), (400, 1000, 2048, 707), (200, 700, 1000, 914), (20, 50, 100, 730), (300, 800, 2048, 546), (1, 2048, 2048, 1011)])
def test_bin_completion_as_shipped(low, high, capacity, most):
    """Sequences for 2000 lengths; best fit alone takes 923, 736, 923, 749, 556 and 1011, the bound of the last."""
    rng = random.Random(1)
    lengths = [rng.randint(low, high) for _ in range(2000)]
    bins = complete(lengths, capacity)
    assert is_packing(bins, lengths, capacity) and len(bins) <= most


def test_bin_completion_beats_best_fit_and_never_loses_to_it():
    assert len(best_fit([6, 5, 4, 3, 3, 3], 12)) >= len(complete([6, 5, 4, 3, 3, 3], 12)) == 2
    rng = random.Random(6)
    for _ in range(20):
        lengths = [rng.randint(1, 2048) for _ in range(rng.randint(1, 400))]
        bins = complete(lengths, 2048)
        assert is_packing(bins, lengths, 2048) and len(bins) <= len(best_fit(lengths, 2048))
    assert complete([], 10) == [] and complete([0, 0], 10) == []


def test_both_tokenizer_libraries_give_the_same_ids():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_tokenizer())
    exact.encode_special_tokens = True
    encode, rng = load_tokenizer(default_tokenizer()), random.Random(7)
    letters = [chr(k) for k in range(1, COMMON)]
    texts = ["", "<|endoftext|>", "It's we'll 12,5 don't", "  two  spaces \n\n\t x ", "日本語 ✓ 😀", *("".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(2000)), *("".join(rng.choices("ab 'st1.\n\té", k=40)) for _ in range(2000))]
    for text in texts:
        assert list(encode(text)) == exact.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_untouched_tokenizer(documents):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_tokenizer())
    texts = ["<|endoftext|>", "one <|endoftext|> two<|endoftext|>", "日本語<|endoftext|>", "<|endoftext", "plain é"]
    got = {r["doc_id"]: r["ids"] for r in pack_documents(documents(*enumerate(texts)), with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = [*exact.encode(text, add_special_tokens=False).ids, 0]
        assert got[k] == struct.pack(f"<{len(ids)}I", *ids)


def check_pieces(docs, pieces, capacity):
    encode = load_tokenizer(default_tokenizer())
    rows = [r.asDict() for r in pieces.collect()]
    want = []
    for d in docs.select("doc_id", "text").collect():
        ids = [*encode(d["text"] or ""), 0]
        cuts = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want.append((d["doc_id"], k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_packing_of_awkward_rows(awkward):
    n, total = check_pieces(awkward, pack_documents(awkward), 2048)
    assert n == -(-total // 2048)
    assert pack_documents(awkward.limit(0)).count() == 0


def test_packing_keeps_ids_on_demand(documents):
    rows = pack_documents(documents((1, "hello world"), (2, None)), capacity=8, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_packing_in_several_buckets(documents):
    from textloom.llm.packing import cut_pieces, pack_pieces

    rng = random.Random(8)
    docs = documents(*((k, "word " * rng.randint(1, 60)) for k in range(400)))
    n, total = check_pieces(docs, pack_pieces(cut_pieces(docs, capacity=64), 64, bucket_pieces=80), 64)
    assert n <= -(-total // 64) + 12


def test_repeated_rows_are_packed_in_all_buckets(documents):
    from textloom.llm.packing import cut_pieces, pack_pieces
    from textloom.llm.shared import write_table

    docs = documents(*((1, "word " * 20) for _ in range(600)), *((k, "word " * 9) for k in range(2, 40)))
    rows = pack_pieces(write_table(cut_pieces(docs, capacity=64), "pieces"), 64, bucket_pieces=80).collect()
    per_bucket = {}
    for r in rows:
        per_bucket[r["sequence_id"] >> 32] = per_bucket.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) == 638 and len(per_bucket) == 8 and max(per_bucket.values()) < 160


# Mixing


def brute_targets(sizes, most=3):
    """The rule as it is told: share by weight, stop at the bound, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 1}, {"a": 0, "b": 0}, {"z": 3, "B": 900, "a": 0, "é": 40}, {f"s{k}": (k * k * 37) % 101 for k in range(20)}])
def test_targets_follow_the_rule(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def made(documents, seed=9, n=600):
    rng = random.Random(seed)
    source = lambda: rng.choice(["a"] * 12 + ["b", "c", "d", None])
    return documents(*((k, "w " * rng.randint(0, 40), "en", source()) for k in range(n)))


def test_mix_is_near_its_targets_and_repeats(documents):
    docs = made(documents)
    rows = mix_sources(docs).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=repr)
    text = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = {s: sum(n for d, n in text.items() if source[d] == s) for s in set(source.values())}
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == text[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 20, s


def brute_expected(words, target, most=3):
    """Expected copies by class (words: class to words), the factor found by halving."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(w * min(most, mid * (8 + k)) for k, w in words.items()) < target else (low, mid)
    return {k: min(most, high * (8 + k)) for k in words}


@pytest.mark.parametrize("target", [0.0, 40.0, 333.0, 1000.0, 1499.0, 1500.0])
def test_expected_copies_rise_with_length_and_add_up(spark, target):
    from textloom.llm.mixing import expected_copies

    words = {0: 7, 1: 0, 3: 93, 9: 400}
    rows = spark.createDataFrame([("a", k, w, 500, target) for k, w in words.items()], "source string, class int, words long, source_size long, target double")
    got = {r["class"]: r for r in expected_copies(rows).collect()}
    want = brute_expected(words, target)
    for k in words:
        assert got[k]["copies"] + got[k]["share"] == pytest.approx(want[k], abs=1e-6) and 0 <= got[k]["share"] < 1
        assert got[k]["wanted"] == pytest.approx(target - sum(int(got[j]["copies"]) * words[j] for j in words))


def test_the_sample_has_unequal_probabilities(documents):
    """Of two lengths in one source, each is taken about as often as its share says; which is not the order of the random numbers."""
    docs = documents(*((k, "w " * (2 if k % 2 else 300), "en", "b" if k % 40 else "a") for k in range(4000)))
    rows = mix_sources(docs).where("source_size > 100000").collect()
    target = rows[0]["target"]
    size = {n: sum(r["size"] for r in rows if r["size"] == n) for n in (2, 300)}
    want = brute_expected({1: size[2], 8: size[300]}, target)
    taken = {n: [r["taken"] // n for r in rows if r["size"] == n] for n in (2, 300)}
    for n, k in ((2, 1), (300, 8)):
        share = want[k] - int(want[k])
        assert set(taken[n]) <= {int(want[k]), int(want[k]) + 1}
        assert abs(sum(taken[n]) / len(taken[n]) - want[k]) < 5 * (share * (1 - share) / len(taken[n])) ** 0.5 + 0.01
    assert sum(taken[300]) / len(taken[300]) > 1.5 * sum(taken[2]) / len(taken[2])
    u = lambda d: int(hashlib.sha256(str(d).encode()).hexdigest()[:12], 16)
    extra = {r["doc_id"]: r["taken"] // r["size"] - int(want[1 if r["size"] == 2 else 8]) for r in rows}
    assert max(u(d) for d, x in extra.items() if x) > min(u(d) for d, x in extra.items() if not x)


def test_sources_are_ranked_by_code_point(spark):
    from textloom.llm.mixing import ranked

    names = [*(f"s{k}" for k in range(300)), "B", "é", "", None, "z", "Z"]
    rows = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5)
    got = {r["source"]: r["place"] for r in ranked(rows).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda s: (s is None, (s or "").encode())))}


def test_a_repeated_id_does_not_meet_in_one_task_row_by_row(documents):
    docs = documents(*((1, "w w w", "en", "a") for _ in range(500)), *((k, "w " * 5, "en", "b") for k in range(2, 60)))
    rows = mix_sources(docs).collect()
    assert len(rows) == 558 and len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1


def test_mixed_documents_are_what_the_mix_takes(documents):
    docs = made(documents, 10, 200)
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(docs).collect() if r["size"]}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.where("length(trim(text)) > 0").groupBy("doc_id").count().collect()} == {d: n for d, n in times.items() if n}


def test_mix_with_empty_texts_agrees_with_its_sql(documents):
    import duckdb

    rng = random.Random(11)
    docs = documents(*((k, rng.choice([None, "", " \n", "w " * rng.randint(1, 40)]), "en", rng.choice(["a"] * 12 + ["b", "c", "d", None])) for k in range(600)))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(SQL["op7_source_mixing"]).fetchall()
    got = [tuple(r) for r in mix_sources(docs).collect()]
    assert sorted((r[0], r[1], r[2], r[4]) for r in got) == sorted((r[0], r[1], r[2], r[4]) for r in want)
    assert [x[3] for x in sorted(got)] == pytest.approx([x[3] for x in sorted(want)])


def test_mixing_awkward_rows(awkward):
    rows = mix_sources(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert next(r["size"] for r in rows if r["doc_id"] == 6) == 30_000
    assert mixed_documents(awkward).columns == awkward.columns and mixed_documents(awkward).where(F.col("text") == "x").count() <= 3
    assert mix_sources(awkward.limit(0)).count() == 0 and mixed_documents(awkward.limit(0)).count() == 0
