import random

from pyspark.sql import functions as F

from codexmill.llm import annotators as A


def table_of(stats):
    return {r["annotator"]: r for r in stats.collect()}


def votes(spark, rows):
    flat = [(i, a, x) for i, v in rows for a, x in v]
    df = spark.createDataFrame(flat, "line_id string, annotator string, answer string")
    return df.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "answer"))).alias("votes"))


def test_minority_of_the_reliable_wins(spark):
    rng = random.Random(1)
    skill = {"good1": 0.97, "good2": 0.95, "poor1": 0.45, "poor2": 0.45, "wrong": 0.05}
    rows, truth = [], {}
    for i in range(600):
        t = rng.choice("xyz")
        truth[str(i)] = t
        rows.append((str(i), [(a, t if rng.random() < p else rng.choice([c for c in "xyz" if c != t])) for a, p in skill.items()]))
    decided, stats, patterns = A.decide(votes(spark, rows), 3)
    got = {r["line_id"]: r["consensus"] for r in decided.collect()}
    majority = {i: max("xyz", key=lambda c: sum(x == c for _, x in v)) for i, v in rows}
    right = sum(got[i] == t for i, t in truth.items())
    assert right > sum(majority[i] == t for i, t in truth.items()) and right > 560
    stats = table_of(stats)
    assert stats["good1"]["accuracy"] > 0.85 and stats["wrong"]["weight"] < 0 < stats["poor1"]["weight"] < stats["good2"]["weight"]
    lost = {(r["line_id"], r["annotator"]) for r in A.dissent(decided, 1).collect()}
    assert lost == {(i, a) for i, v in rows for a, x in v if x != got[i]}


def test_single_votes_and_ties(spark):
    decided, stats, _ = A.decide(votes(spark, [("a", [("r", "x")]), ("b", [("r", "x"), ("s", "y")])]), 3)
    assert {r["line_id"]: r["consensus"] for r in decided.collect()} == {"a": "x", "b": "y"}
    assert {k: v["n"] for k, v in table_of(stats).items()} == {"r": 1, "s": 1}


def test_alpha(spark):
    # the published example of nominal data with missing ratings: alpha 0.743
    a = "*****342114333*4*"[5:]
    grid = {"A": "*****34121133*3", "B": "1*21334412*4334"}
    grid = {"A": "*****3412113311", "B": "1*213344*******", "C": "**213443*2133*4"}
    rows = [(str(i), [(k, v[i]) for k, v in grid.items() if v[i] != "*"]) for i in range(len(a)) if any(v[i] != "*" for v in grid.values())]
    p = votes(spark, rows).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    got = A.alpha(p).first()
    pairs, marg, total = 0.0, {}, 0
    for _, v in rows:
        if len(v) > 1:
            for x in v:
                marg[x[1]] = marg.get(x[1], 0) + 1
            total += len(v)
            pairs += sum(x[1] != y[1] for i, x in enumerate(v) for j, y in enumerate(v) if i != j) / (len(v) - 1)
    want = 1 - (pairs / total) / ((total * total - sum(k * k for k in marg.values())) / (total * (total - 1)))
    assert abs(got["alpha"] - want) < 1e-9
    assert A.alpha(p.limit(0)).first()["alpha"] is None


def test_readings(spark):
    df = spark.createDataFrame(
        [("l1", {"e": "كا", "f": "کا", "g": "x", "h": "", "i": None}, 1), ("l1", {"e": "كا", "f": "کا", "g": "x"}, 2), ("l2", None, 1), ("l3", {}, 1), (None, {"e": "a"}, 1)],
        "line_id string, engine_outputs map<string,string>, votes int",
    )
    got = A.reading_items(df, True).collect()
    assert len(got) == 1 and [tuple(v) for v in got[0]["votes"]] == [("e", 0), ("f", 0), ("g", 1)] and got[0]["readings"] == ["کا", "x"]


def test_confident_reading_wins(spark):
    # two engines, equally good over all, each right where it is sure of itself; their scales differ; a third reads some of the lines
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(400):
        t, sure = f"{i} right", i % 2
        truth[str(i)] = t
        a, b = (t, t) if rng.random() < 0.4 else (t, f"{i} a") if sure else (f"{i} b", t)
        rows.append((str(i), {"e": a, "f": b} | ({"g": t} if i < 300 else {}), {"e": 0.9 + 0.05 * sure + rng.random() / 50, "f": 0.3 - 0.2 * sure + rng.random() / 50}))
    rows.append(("null", {"e": "x"}, None))
    df = spark.createDataFrame(rows, "line_id string, engine_outputs map<string,string>, engine_confidences map<string,double>")
    items = A.reading_items(df, True)
    decided, stats, _ = A.decide(items, A.OPEN_ANSWERS)
    got = {r["line_id"]: r["readings"][r["consensus"]] for r in decided.collect()}
    assert got.pop("null") == "x" and sum(got[k] == t for k, t in truth.items()) > 0.95 * len(truth)
    votes = {r["line_id"]: r["votes"] for r in items.collect()}
    assert votes["null"][0]["part"] is None and votes["0"][2]["part"] is None and votes["1"][0]["part"] > votes["0"][0]["part"]
    stats = table_of(stats)
    assert set(stats) == {"e", "f", "g"} and stats["g"]["parts"] == {} and stats["e"]["parts"][3] > stats["e"]["weight"] > stats["e"]["parts"][0]


def test_labels(spark):
    df = spark.createDataFrame(
        [("l", "r", "x", 1, 1), ("l", "r", "y", 2, 1), ("l", "r", None, 3, 1), ("l", "s", " x ", 1, 1), ("m", None, "x", 1, 1), ("n", "r", "", 1, 1)],
        "line_id string, reviewer_id string, confidence_label string, reviewed_at int, ingested_at int",
    )
    assert [[tuple(v) for v in r["votes"]] for r in A.label_items(df).collect()] == [[("r", "y"), ("s", "x")]]


def test_own_label_votes_silently(spark):
    df = spark.createDataFrame([("l", "r", "x", 1, 1), ("m", "r", "x", 1, 1)], "line_id string, reviewer_id string, confidence_label string, reviewed_at int, ingested_at int")
    lines = spark.createDataFrame([("l", "y", 1), ("l", "y", 2), ("m", None, 1), ("n", "x", 1)], "line_id string, confidence_label string, votes int")
    items = A.label_items(df, lines)
    assert {r["line_id"]: [tuple(v) for v in r["votes"]] for r in items.collect()} == {"l": [("r", "x"), ("~pipeline", "y")], "m": [("r", "x")]}
    decided, _, _ = A.decide(items, 3)
    assert all(r["annotator"] == "r" for r in A.dissent(decided, 1).collect())


def test_nothing(spark):
    decided, stats, patterns = A.decide(votes(spark, [("a", [("r", "x")])]).limit(0), 3)
    assert decided.count() == 0 and stats.count() == 0


def plain_rounds(rows, answers, rounds=60):
    """The same rounds over plain lists."""
    import math

    rows = [v for _, v in rows if len(v) > 1]
    accuracy = {}
    for turn in range(1, rounds + 1):
        w = {a: math.log(x / (1 - x)) + math.log(answers - 1) for a, x in accuracy.items()}
        right, n = {}, {}
        for v in rows:
            for a, x in v:
                score = {}
                for b, y in v:
                    if b != a:
                        score[y] = score.get(y, 0) + w.get(b, 1.0)
                top = max(score.values())
                tied = [y for y, s in score.items() if s >= top - 1e-8]
                right[a] = right.get(a, 0) + (1 / len(tied) if x in tied else 0)
                n[a] = n.get(a, 0) + 1
        new = {a: (right[a] + A.RIGHT) / (n[a] + A.RIGHT + A.WRONG) for a in n}
        moved = max(abs(new[a] - accuracy.get(a, 2)) for a in new)
        accuracy = {a: new[a] if a not in accuracy or turn <= A.DAMPED else accuracy[a] + (new[a] - accuracy[a]) / 2 for a in new}
        if moved < A.STABLE:
            return accuracy, turn
    return accuracy, None


def test_against_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(str(i), [(a, rng.choice("xxxyz")) for a in "pqrst" if rng.random() < 0.8]) for i in range(300)]
    rows = [(i, v) for i, v in rows if v]
    stats, turns, settled = A.reliability(A.count_patterns(votes(spark, rows)), 3)
    want, plain = plain_rounds(rows, 3)
    assert settled == (plain is not None) and turns == (plain or 60)
    got = table_of(stats)
    assert set(got) == set(want) and all(abs(got[a]["accuracy"] - x) < 1e-6 for a, x in want.items())


def test_many_annotators(spark):
    """No bound on annotators: more of them than votes on any item, in both directions."""
    n = 30_000
    df = spark.range(n).selectExpr("cast(id div 3 as string) line_id", "concat('r', id) annotator", "if(id % 3 = 2, 'y', 'x') answer")
    items = df.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "answer"))).alias("votes"))
    decided, stats, _ = A.decide(items, 3)
    assert stats.count() == n and decided.filter("consensus = 'x'").count() == n // 3


def test_alpha_of_open_text(spark):
    # two engines that mostly read one frequent word agree often by chance
    rows = [(str(i), {"e": "the", "f": "the" if i % 10 else "a"}) for i in range(100)] + [(f"b{i}", {"e": f"w{i}", "f": f"w{i}"}) for i in range(20)]
    items = A.reading_items(spark.createDataFrame(rows, "line_id string, engine_outputs map<string,string>"), True)
    got = A.alpha(A.count_patterns(items), A.read_texts(items)).first()
    texts = [t for _, m in rows for t in m.values()]
    counts = {t: texts.count(t) for t in texts}
    expected = 1 - sum(k * (k - 1) for k in counts.values()) / (len(texts) * (len(texts) - 1))
    assert abs(got["expected"] - expected) < 1e-9 and abs(got["alpha"] - (1 - 10 / 120 / expected)) < 1e-9
