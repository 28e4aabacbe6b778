import random

import numpy as np
import pytest

from codexmill.llm import overlap as O
from codexmill.session import materialise


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, t, edits, letters):
    t = list(t)
    for _ in range(edits):
        p, kind = rng.randrange(len(t)), rng.randrange(3)
        if kind == 0:
            t[p] = rng.choice(letters)
        elif kind == 1:
            t.insert(p, rng.choice(letters))
        elif len(t) > 1:
            del t[p]
    return "".join(t)


def near(spark, rows, **more):
    df = spark.createDataFrame([(i, t, int(k == "train"), int(k != "train")) for i, (t, k) in enumerate(rows)], "id long, form string, train int, eval int")
    return {(r["eval_id"], r["train_id"]) for r in O.near_classes(materialise(df), **more).collect()}


def brute(rows):
    return {(i, j) for i, (a, k) in enumerate(rows) if k != "train" for j, (b, m) in enumerate(rows) if m == "train" and a != b and distance(a, b) <= O.allowed(len(a), len(b))}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "کتێبژمارە "])
def test_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    rows = []
    for _ in range(40):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(30, 60)))
        rows.append((t, "train"))
        for _ in range(2):
            rows.append((mutate(rng, t, rng.randint(1, len(t) // 5 + 2), letters), rng.choice(["val", "test", "train"])))
    rows = [(t, k) for t, k in dict(rows).items() if len(t) >= 30]
    assert near(spark, rows) == brute(rows)


def test_long_texts(spark):
    rng = random.Random(9)
    rows = []
    for n in (130, 155, 161, 190, 240, 400):
        t = "".join(rng.choice("abcdefghij ") for _ in range(n))
        rows += [(t, "train"), (mutate(rng, t, n // 6, "abc"), "val"), (mutate(rng, t, n // 5, "abc"), "test")]
    assert near(spark, rows) == brute(rows)


def test_slices(spark):
    """A filter far too small for the keys: lengths and long texts go in many slices, and nothing is lost."""
    rng = random.Random(4)
    rows = []
    for n in [44] * 12 + [51] * 3 + [130] * 3:
        t = "".join(rng.choice("abcdefghij ") for _ in range(n))
        rows += [(t, "train"), (mutate(rng, t, n // 6, "abc"), "val")]
    counts = {44: 12, 51: 3}
    cut = O.slices(counts, 390, 13)
    assert len(cut) > 6 and {x.lengths for x in cut} >= {(44,), None} and all(x.parts > 1 for x in cut if x.lengths == (44,))
    assert near(spark, rows, most_bits=13) == brute(rows)


def test_last_passage():
    """The segment the keys rest on: unchanged, with so many edits before and behind it, and one edit at most in the next."""
    rng = random.Random(8)
    for _ in range(3000):
        m = rng.randint(2, 14)
        edits = [0] * m
        for _ in range(rng.randint(0, m - 1)):
            edits[rng.randrange(m)] += 1
        found = [i for i in range(m) if edits[i] == 0 and sum(edits[:i]) <= i and sum(edits[i + 1 :]) <= m - 1 - i and (i == m - 1 or edits[i + 1] <= 1)]
        assert found


def test_chance_meetings_of_long_texts():
    """Random texts of 300 characters from 3,000 words share less than one key a pair."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    make = lambda: " ".join(rng.choice(words) for _ in range(100))[:300]
    a, b = ([make() for _ in range(30)] for _ in range(2))
    codes = lambda t: np.array([[ord(c) for c in x] for x in t], dtype=np.uint64)
    powers = O._powers(300)
    keys, many = np.unique(O._index_keys(O._prefixes(codes(a)), 300, powers), return_counts=True)
    rows = 0
    for block in O._long_probe(O._prefixes(codes(b)), 300, powers, 1, 0):
        at = np.minimum(np.searchsorted(keys, block.ravel()), len(keys) - 1)
        rows += many[at][keys[at] == block.ravel()].sum()
    assert rows < len(a) * len(b)


def test_signature_bound():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abcdef") for _ in range(40))
        e = rng.randint(0, 8)
        b = mutate(rng, a, e, "abcdef")
        s = [O.signature(np.array([[ord(c) for c in t]], dtype=np.uint64))[0] for t in (a, b)]
        x, y = (int(v) & (1 << 64) - 1 for v in s)
        assert sum(abs((x >> 4 * i & 15) - (y >> 4 * i & 15)) for i in range(16)) <= 2 * e


def test_signature_in_expressions(spark):
    df = spark.createDataFrame([(-1, 0), (0x123, 0x321), (-1, -1)], "a long, b long")
    assert [r["v"] for r in df.select(O.unlike("a", "b").alias("v")).collect()] == [240, 4, 0]


def test_cuts():
    for n in range(1, 80):
        for k in range(0, 20):
            c = O.cuts(n, k)
            assert sum(s for _, s in c) == n and len(c) == k + 1 and all(c[i][0] + c[i][1] == c[i + 1][0] for i in range(k))


def lines(spark):
    a = "x" * 10 + "abcdefghijklmnopqrstuvwxyz"
    rows = [
        ("t1", "p1", a, 1), ("t1", "p1", a, 2), ("t2", "p1", a, 1), ("e1", "p2", a, 1), ("e2", "p3", a[:-2] + "ab", 1), ("e3", "p3", "short", 1),
        ("u", "p4", a, 1), ("n", "p2", None, 1), ("w", "p9", a, 1), ("e4", "p2", a.replace("a", "а").replace("x", "х"), 1), (None, "p2", a, 1),
    ]
    df = spark.createDataFrame([(i, p, f"kcac_00000{p[-1]}", t, k) for i, p, t, k in rows], "line_id string, page_id string, book_id string, text_normalised string, split int")
    pages = spark.createDataFrame([("p1", "TRAIN ", 1), ("p2", "train", 1), ("p2", "Validation", 2), ("p3", " test", 1), ("p4", None, 1)], "page_id string, split string, ingested_at int")
    return O.split_lines(df, pages)


def test_pairs_and_report(spark):
    s = materialise(lines(spark))
    got = {(r["eval_line"], r["train_line"], r["eval_split"], r["exact"]) for r in O.overlaps(s).collect()}
    assert got == {(e, t, k, x) for e, k, x in (("e1", "val", True), ("e4", "val", True), ("e2", "test", False)) for t in ("t1", "t2")}
    rep = {(r["split"], r["book_key"]): (r["lines"], r["overlapping"], r["exact"]) for r in O.report(s).collect()}
    assert rep == {("val", "kcac_000002"): (2, 2, 2), ("test", "kcac_000003"): (1, 1, 0)}


def test_linked_lines(spark):
    s = materialise(lines(spark))
    got = {r["line_id"]: (r["split"], r["class_id"], r["links"]) for r in O.linked_lines(s).collect()}
    # the text on both sides is linked to itself and, in training, to e2's text; e2's to the one training text
    assert {k: v[2] for k, v in got.items()} == {"t1": 2, "t2": 2, "e1": 2, "e4": 2, "e2": 1}
    assert len({got[k][1] for k in ("t1", "t2", "e1", "e4")}) == 1 and got["e2"][1] != got["t1"][1]


def test_nothing(spark):
    s = materialise(lines(spark).limit(0))
    assert O.overlaps(s).count() == 0 and O.report(s).count() == 0 and O.linked_lines(s).count() == 0
