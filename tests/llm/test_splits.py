import random

from codexmill.llm import splits as S


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(110)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a chain
    edges += [("hub", f"s{i}") for i in range(200)] + [("x", "x"), (None, "y")]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain_components([e for e in edges if e[0]])
    assert S.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_differencing():
    rng = random.Random(3)
    w = [rng.randint(1, 40) for _ in range(300)]
    bins = S.differencing([[(float(x), (i,))] for i, x in enumerate(w)], 10)
    members = [m for _, link in bins for m in S._members(link)]
    assert sorted(members) == list(range(300)) and len(bins) == 10
    for total, link in bins:
        assert sum(w[m] for m in S._members(link)) == total
    assert max(b[0] for b in bins) - min(b[0] for b in bins) <= 3
    assert S.differencing([], 4) == []


def test_bins_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 20)
    monkeypatch.setattr(S, "FAN", 3)
    rng = random.Random(4)
    rows = [(f"i{k}", float(rng.randint(1, 30))) for k in range(400)]
    where, sums = S.bins_of(spark.createDataFrame(rows, "item string, weight double"), 8)
    got = {r["item"]: r["bin"] for r in where.collect()}
    weight = dict(rows)
    assert set(got) == set(weight)
    by = {}
    for i, b in got.items():
        by[b] = by.get(b, 0) + weight[i]
    assert by == {b: w for b, w in sums if w} and max(by.values()) - min(by.values()) <= 12


def tables(spark):
    books = spark.createDataFrame(
        [("kcac_000001", "A; B", None, 1), ("kcac_000002", "B", None, 1), ("kcac_000003", "?", "2", 1), ("kcac_000004", "C", None, 1), ("kcac_000005", "?", None, 1), ("kcac_000006", None, None, 1)],
        "book_id string, authors string, copy_of string, split int",
    )
    pages = spark.createDataFrame(
        [(f"Kcac {b}", f"kcac_00000{b}_p{p:04d}", 1, "train") for b in range(1, 8) for p in range(4)] + [(None, "kcac_000003_p0009", 1, None), (None, "odd", 1, None), ("1", "kcac_000001_p0000", 2, "x"), (None, None, 1, None)],
        "book_id string, page_id string, ingested_at int, split string",
    )
    configs = spark.createDataFrame([(["3", "3", "99"], ["kcac_000004"]), (None, ["999"])], "test_book_ids array<string>, val_book_ids array<string>")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, share double")
    return pages, books, configs, targets


def test_listed_components(spark):
    pages, books, configs, targets = tables(spark)
    grouped, forced = S.grouped_pages(pages, books, configs)
    got = {r["page_id"]: r["split"] for r in S.assign(grouped, forced, targets).collect()}
    assert len(got) == 7 * 4 + 2
    for b in (1, 2, 3):
        assert {v for k, v in got.items() if k.startswith(f"kcac_00000{b}")} == {"test"}
    assert {v for k, v in got.items() if k.startswith("kcac_000004")} == {"val"}
    for b in (5, 6, 7):
        assert len({v for k, v in got.items() if k.startswith(f"kcac_00000{b}")}) == 1


def test_nothing(spark):
    pages, books, configs, targets = tables(spark)
    grouped, forced = S.grouped_pages(pages.limit(0), books.limit(0), configs.limit(0))
    assert S.assign(grouped, forced, targets).count() == 0


def test_allocation():
    assert S.allocate([(1, 5.0), (2, 3.0), (3, 2.0)], {"a": 8.0, "b": 2.0}) == {1: "a", 2: "a", 3: "b"}
