import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.exact_dedup import drop_copies, exact_dedup
from textloom.llm.jaccard_join import jaccard_components, least_overlap, one_of_each_component
from textloom.llm.shared import BloomFilter, held_out

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Exact deduplication


def brute_dedup(rows):
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault((r["text"] or "").translate(LOW), []).append(k)
    out = []
    for text, own in groups.items():
        last = max(own, key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, k))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[k]["doc_id"], rows[last]["doc_id"], len(own), k == last, sha) for k in own]
    return sorted(out, key=repr)


def test_exact_dedup(awkward):
    rows = awkward.select("doc_id", "text").collect()
    assert rows_of(exact_dedup(awkward)) == brute_dedup(rows)
    assert exact_dedup(awkward.limit(0)).count() == 0


def test_drop_copies_keeps_what_dedup_keeps(awkward):
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns
    want = sorted(((r["text"] or "").translate(LOW) for r in awkward.select("text").distinct().collect()), key=repr)
    assert sorted(((r["text"] or "").translate(LOW) for r in kept.select("text").collect()), key=repr) == sorted(set(want), key=repr)
    assert {r["doc_id"] for r in kept.where("lower(text) like 'the cat%'").collect()} == {2}
    assert drop_copies(awkward.limit(0)).count() == 0


def test_dedup_in_several_parts_with_a_filter_each(awkward, documents):
    many = documents(*((k, f"text {k % 2500}") for k in range(6000)), *((9, "often") for _ in range(300)), *((k, "OFTEN" if k % 2 else "often") for k in range(300)))
    for docs in (awkward, many):
        rows = docs.select("doc_id", "text").collect()
        assert rows_of(exact_dedup(docs, max_bits=2**15)) == brute_dedup(rows)
        kept = drop_copies(docs, max_bits=2**15)
        assert kept.columns == docs.columns
        assert kept.count() == len({(r["text"] or "").translate(LOW) for r in rows})
    assert {r["doc_id"] for r in drop_copies(many, max_bits=2**15).where("text like 'text%'").collect()} == {k for k in range(6000) if k + 2500 >= 6000}
    assert drop_copies(awkward.limit(0), max_bits=2**15).count() == 0


def test_bloom_filter_misses_nothing_and_is_bounded(spark):
    df = spark.range(5000).select((F.col("id") % 4000).alias("k"))
    for bits in (2**15, 2**30):
        marked = BloomFilter(df, "k", 5000, max_bits=bits).mark(df, "k")
        assert marked.where("k < 1000 and not maybe").count() == 0
        assert marked.count() == 5000
    assert marked.where("k >= 1000 and maybe").count() < 400
    once = BloomFilter(spark.range(100), "id", 100, least=1).mark(spark.range(3000), "id")
    assert once.where("id < 100 and not maybe").count() == 0 and once.where("maybe").count() < 500


# Components


def test_components_of_chains_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[300] == got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=3, deadline=None)
@given(links=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_against_brute_force(spark, links):
    root = {k: k for link in links for k in link}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


# Jaccard join


def brute_components(rows, width=5, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got_components(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **more).collect()}


def near_copies(seed, n_base=6, n_copies=14, words=80):
    """Families of edited copies with shared passages, so that likeness straddles the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows, doc_id = [], 0
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(words)] + (passage if rng.random() < 0.5 else [])
        for _ in range(n_copies):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_loses_no_link(documents, seed):
    rows = near_copies(seed)
    assert got_components(documents(*rows)) == brute_components(rows)


def test_join_with_other_width_and_threshold(documents):
    rows = near_copies(3, n_base=4)
    assert got_components(documents(*rows), width=3, percent=60) == brute_components(rows, 3, 60)


def test_join_at_the_threshold(documents):
    """Four of five shingles shared is a link; one word less is not."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q r s t u v w"), (4, "q r s t u v w x"), (5, "one two"), (6, "ONE  two"), (7, "one two three"), (8, ""), (9, ""), (10, None)]
    want = brute_components(rows)
    assert got_components(documents(*rows)) == want
    assert want[2][1] == 1 and want[4][1] == 4 and want[6][1] == 5 and want[7][1] == 7 and want[9][1] == 9


def test_join_on_awkward_rows(awkward):
    got = rows_of(jaccard_components(awkward).select("doc_id", "n_shingles", "component_id"))
    assert len(got) == awkward.count()
    by = {r[0]: r for r in got}
    assert by[1][2] == by[2][2] == 1 and by[3][1] == by[4][1] == by[7][1] == 0 and by[4][2] == 4 and by[5][1] == 1 and by[6][1] == 1
    assert by[None][2] is None
    assert jaccard_components(awkward.limit(0)).count() == 0


def test_one_of_each_component(documents, awkward):
    rows = near_copies(4, n_base=4)
    want = {c for _, c in brute_components(rows).values()}
    kept = one_of_each_component(documents(*rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    kept = one_of_each_component(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, None, 5, 6, 7, 8, 9], key=repr)
    assert one_of_each_component(documents((1, "a b c d e f"), (1, "a b c d e f"))).count() == 1


def test_texts_of_one_id_are_judged_each_by_its_own_component(documents):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(500)], k=60))
    one, two, three, unique = text(), text(), text(), text()
    near = lambda x: x + " more"
    rows = [(1, one), (5, near(one)), (5, unique), (5, unique), (5, ""), (6, two), (6, three), (7, near(two)), (8, near(three)), (9, near(unique)), (None, near(one))]
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(*rows)).collect()), key=repr)
    want = [1, 1, 5, 5, 5, 6, 6, 6, 6, 5, 1]
    assert got == sorted(((d or 0, max(0, len(x.split()) - 4), c) for (d, x), c in zip(rows, want)), key=repr)
    kept = one_of_each_component(documents(*rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted((d or 0, x) for d, x in {*rows} if (d, x) == (1, one) or d is None or (d == 5 and x in (unique, "")) or d == 6)


def test_arithmetic_of_the_threshold():
    for a in range(1, 40):
        for b in range(1, 40):
            i = least_overlap(a, b)
            assert 100 * i >= 80 * (a + b - i) and 100 * (i - 1) < 80 * (a + b - i + 1)


def test_fold_rule(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_common_shingles_and_large_groups_against_brute_force(spark, documents, monkeypatch):
    """Passages that most documents share, families with one prefix, and copies: with every shingle of two sets of a batch
    taken as common, and without."""
    from textloom.llm import jaccard_join

    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    passage, rows = rng.choices(words, k=60), []
    for k in range(40):
        rows.append((len(rows), " ".join([*passage, *rng.choices(words, k=rng.choice([5, 10, 14, 20, 60]))])))
    family = rng.choices(words, k=90)
    for k in range(50):
        copy = list(family)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            copy[rng.randrange(90)] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, rows[60][1]) for k in range(30)]
    want = brute_components(rows)
    for common, parts in ((2, 3), (16, 1)):
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        assert got_components(documents(*rows).repartition(parts)) == want, (common, parts)
