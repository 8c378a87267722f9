import random

from textloom.operators.graph import has_cycle


def brute(links):
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    state = {}

    def visit(v):
        state[v] = 1
        for w in after.get(v, ()):
            if state.get(w) == 1 or (w not in state and visit(w)):
                return True
        state[v] = 2
        return False

    return any(v not in state and visit(v) for v in list(after))


def edges(spark, links):
    return spark.createDataFrame([(a, b, 0.0) for a, b in links], "from_ord long, to_ord long, weight double")


def test_long_chains_and_trees_take_few_rounds(spark):
    chain = [(k, k + 1) for k in range(3000)]
    assert not has_cycle(edges(spark, chain))
    assert has_cycle(edges(spark, [*chain, (3000, 0)]))
    tree = [((k - 1) // 2, k) for k in range(1, 500)]
    assert not has_cycle(edges(spark, [*tree, *((b + 1000, a + 1000) for a, b in tree)]))


def test_cycles_against_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((4, 3), (8, 9), (12, 14), (20, 22)):
        for _ in range(2):
            links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            rising = [(min(x), max(x)) for x in links if x[0] != x[1]]
            assert has_cycle(edges(spark, links)) == brute(links) and not has_cycle(edges(spark, rising))
    assert not has_cycle(edges(spark, [])) and has_cycle(edges(spark, [(1, 1)]))
