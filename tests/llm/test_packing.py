import random

import pytest

from codexmill.llm import packing as P


def check(bins, size, capacity):
    assert sorted(i for b in bins for i in b[2]) == list(range(len(size)))
    for fill, mask, members in bins:
        assert fill == sum(size[i] for i in members) <= capacity and mask == sum(1 << i for i in members)


def test_evolution_keeps_and_improves():
    rng = random.Random(1)
    for trial in range(5):
        size = [rng.randint(1, 70) for _ in range(200)]
        first = P.best_fit(list(range(200)), size, 100, [])
        best = P.evolve(size, 100, trial)
        check(first, size, 100)
        check(best, size, 100)
        assert len(best) <= len(first) and len(best) <= sum(size) / 100 * 1.03 + 1
    assert P.evolve([], 10, 1) == []
    check(P.evolve([0, 0, 10], 10, 1), [0, 0, 10], 10)


def test_known_optimum():
    # pairs that must be found: each item has exactly one partner that fills the container
    size = [x for a in range(51, 80) for x in (a, 100 - a)]
    assert len(P.evolve(size, 100, 3)) == 29


def test_crossover_keeps_items():
    import numpy as np

    rng = random.Random(2)
    size = [rng.randint(1, 60) for _ in range(80)]
    a = P.best_fit(list(range(80)), size, 100, [])
    b = P.best_fit(list(reversed(range(80))), size, 100, [])
    check(P.cross(a, b, size, 100, np.random.default_rng(1)), size, 100)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, "a " * rng.randint(1, 200)) for i in range(300)] + [(900, None), (901, ""), (902, "b " * 1300), (902, "b " * 1300), (903, "c " * 512), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as size")
    got = P.pack(df, "doc_id", "text", "byte_bpe_50k", 512).collect()
    from codexmill.llm.bpe import encoder

    n = {i: len(encoder("byte_bpe_50k").ids(t)) for i, t in rows if i is not None}
    tokens, fill = {}, {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["tokens"]
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert tokens == n and max(fill.values()) <= 512
    whole = {r["doc_id"] for r in got if r["whole"]}
    assert whole == {i for i, k in n.items() if k <= 512} and len([r for r in got if r["doc_id"] in whole]) == len(whole)
    assert len(fill) <= sum(n.values()) / 512 * 1.05 + 2
    assert P.pack(df.limit(0), "doc_id", "text", "byte_bpe_50k", 512).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, "doc_id", "text", "byte_bpe_50k", 0)


def test_best_set_against_all_sets():
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(200):
        size = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        got = P.best_set(list(range(len(size))), size, room)
        assert len(set(got)) == len(got)
        want = max(sum(c) for n in range(len(size) + 1) for c in combinations(size, n) if sum(c) <= room)
        assert sum(size[i] for i in got) == want


def test_lower_bound():
    rng = random.Random(6)

    def optimum(items, capacity):
        best = len(items)

        def go(at, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if at == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[at] <= capacity:
                    bins[k] += items[at]
                    go(at + 1, bins)
                    bins[k] -= items[at]
            go(at + 1, bins + [items[at]])

        go(0, [])
        return best

    for _ in range(60):
        size = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        least = optimum(size, 20)
        assert P.least_bins(size, 20) <= least == len(P.evolve(size, 20, 1))


def test_fewer_than_best_fit():
    """Where best-fit decreasing over all documents leaves a container too many, the population finds it."""
    rng = random.Random(11)
    size = [rng.randint(1, 140) if rng.random() < 0.7 else rng.randint(140, 500) for _ in range(400)]
    first = P.best_fit(sorted(range(len(size)), key=lambda i: -size[i]), size, 512, [])
    triples = [x for _ in range(60) for a in (rng.randint(110, 200),) for b in (rng.randint(120, 200),) for x in (a, b, 512 - a - b)]
    decreasing = P.best_fit(sorted(range(len(triples)), key=lambda i: -triples[i]), triples, 512, [])
    found = P.evolve(triples, 512, 2)
    check(found, triples, 512)
    assert len(found) < len(decreasing) and len(P.evolve(size, 512, 1)) <= len(first)
