"""Splits that keep related records together (problem 1).

Records are tied through shared entities and stated copies; connected components are found by
alternating star contractions, each a grouped minimum and a join. Components with a listed member
take the list's split. The others are balanced by largest differencing into many equal bins: each
component starts as a tuple of one weight and empty bins, and the two tuples of the widest spread
are combined, largest bin with smallest, until one tuple is left. Shards of bounded size do this
apart; their tuples are combined in the same way, level by level, so no task and not the driver
ever holds all components. Whole bins then go to the splits by target share.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.keys import authors_udf, book_key_udf, book_or_page_udf
from codexmill.session import discard, materialise

#: Bins of equal weight, components in a shard, tuples combined in one task.
BINS, SHARD, FAN = 60, 2000, 100
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), strings: root is the component's smallest node.

    Loops and repeated edges are allowed, nulls are ignored. A node's neighbours are never gathered:
    a round takes the minimum of each node's neighbours (combined before the shuffle) and joins it
    back, a join that splits a hot node's rows.
    """
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    now = materialise(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.filter("u <> v").select("u", "v").union(now.filter("u <> v").select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = materialise(small.distinct(), "small")
        state = nxt.filter("u <> v").agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        discard(large)
        now = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("root"))
    return root.union(tops).union(alone).groupBy("node").agg(F.min("root").alias("root"))


def book_edges(books: DataFrame) -> DataFrame:
    """Edges from books (book_id, authors, copy_of): every book to itself, to its known authors and to the book it copies."""
    b = books.select(book_key_udf("book_id").alias("a"), authors_udf("authors").alias("authors"), book_key_udf("copy_of").alias("copy")).filter(F.col("a").isNotNull())
    return (
        b.select("a", F.col("a").alias("b"))
        .union(b.select("a", F.explode("authors").alias("b")).select("a", F.concat(F.lit("~author:"), "b").alias("b")))
        .union(b.filter(F.col("copy").isNotNull()).select("a", "copy"))
    )


def listed_books(configs: DataFrame) -> DataFrame:
    """(book_key, split) of the lists in any configuration; a book in both lists is a test book."""
    one = lambda c, s: configs.select(F.explode(c).alias("b")).select(book_key_udf("b").alias("book_key"), F.lit(s).alias("split"))
    both = one("test_book_ids", "test").union(one("val_book_ids", "val"))
    return both.filter(F.col("book_key").isNotNull()).groupBy("book_key").agg(F.min("split").alias("split"))


def page_books(page_refs: DataFrame) -> DataFrame:
    """(page_id, book_key) of every page once; a page whose book can't be read stands for itself."""
    pages = page_refs.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max_by("book_id", F.struct(F.col("book_id").isNotNull(), "ingested_at", "book_id")).alias("book_id"))
    return pages.select("page_id", F.coalesce(book_or_page_udf("book_id", "page_id"), F.concat(F.lit("~page:"), "page_id")).alias("book_key"))


def grouped_pages(page_refs: DataFrame, books: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, root) and (root, split) of the components that the lists decide: test before val."""
    root = materialise(components(book_edges(books)), "components")
    forced = (
        listed_books(configs)
        .join(root.withColumnRenamed("node", "book_key"), "book_key", "left")
        .groupBy(F.coalesce("root", "book_key").alias("root"))
        .agg(F.min("split").alias("split"))
    )
    pages = page_books(page_refs).join(root.withColumnRenamed("node", "book_key"), "book_key", "left")
    return pages.select("page_id", F.coalesce("root", "book_key").alias("root")), forced


def differencing(tuples: list[list[tuple[float, tuple]]], bins: int) -> list[tuple[float, list]]:
    """Combine tuples of (weight, members) into one tuple of `bins` bins, widest spread first, largest bin with smallest."""
    heap = []
    for no, t in enumerate(tuples):
        full = sorted(t, key=lambda x: -x[0]) + [(0.0, ())] * (bins - len(t))
        heap.append((full[-1][0] - full[0][0], no, full))
    heapq.heapify(heap)
    no = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # members are linked pairs, flattened once at the end
        both = sorted(((x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b))), key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], no, both))
        no += 1
    return heap[0][2] if heap else []


def _members(link) -> list:
    out, stack = [], [link]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def bins_of(weights: DataFrame, bins: int = BINS) -> tuple[DataFrame, list[tuple[int, float]]]:
    """weights (item, weight) as (item, bin), and the bins' weights: one task holds at most SHARD items or FAN tuples."""
    n = weights.count()
    shards = max(1, -(-n // SHARD))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
        done = differencing([[(float(w), (i,))] for i, w in enumerate(pdf["weight"])], bins)
        rows = [(m, b) for b, (_, link) in enumerate(done) for m in _members(link)]
        at = np.full(len(pdf), 0)
        for m, b in rows:
            at[m] = b
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "weight": pdf["weight"].to_numpy(), "shard": pdf["shard"].to_numpy(), "bin": at})

    kind = weights.schema["item"].dataType.simpleString()
    where = weights.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("long"))
    where = materialise(where.groupBy("shard").applyInPandas(first, f"item {kind}, weight double, shard long, bin long"), "bins")
    sums = where.groupBy("shard", "bin").agg(F.sum("weight").alias("weight"))
    where = where.select("item", "shard", "bin")
    while shards > 1:
        shards = -(-shards // FAN)

        def higher(pdf: pd.DataFrame) -> pd.DataFrame:
            tuples = [[(float(w), ((s, b),)) for b, w in zip(g["bin"], g["weight"])] for s, g in pdf.groupby("shard")]
            tuples = [[(w, (i,)) for i, (w, _) in enumerate(t, start=1000 * k)] for k, t in enumerate(tuples)]
            names = [list(zip(g["shard"], g["bin"])) for _, g in pdf.groupby("shard")]
            done = differencing(tuples, bins)
            rows = [(*names[m // 1000][m % 1000], b) for b, (_, link) in enumerate(done) for m in _members(link)]
            return pd.DataFrame(rows, columns=["shard", "bin", "to"]).assign(group=int(pdf["group"].iloc[0]))

        grouped = sums.withColumn("group", F.pmod(F.col("shard"), F.lit(shards)).cast("long"))
        move = materialise(grouped.groupBy("group").applyInPandas(higher, "shard long, bin long, to long, group long"), "moves")
        sums = sums.join(move, ["shard", "bin"]).groupBy(F.col("group").alias("shard"), F.col("to").alias("bin")).agg(F.sum("weight").alias("weight"))
        where = where.join(move, ["shard", "bin"]).select("item", F.col("group").alias("shard"), F.col("to").alias("bin"))
    return where.select("item", "bin"), [(int(r["bin"]), float(r["weight"])) for r in sums.select("bin", "weight").collect()]


def allocate(bins: list[tuple[int, float]], room: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits, largest first, each to the split with the most room left."""
    left = dict(room)
    out = {}
    for b, w in sorted(bins, key=lambda x: (-x[1], x[0])):
        best = max(sorted(left), key=lambda s: left[s])
        out[b] = best
        left[best] -= w
    return out


def assign(pages: DataFrame, forced: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, split) of every page (page_id, root): listed components as forced, the others by balance to targets (split, share).

    Shares are scaled to their sum. Targets are few rows. No pages give no rows; a component
    heavier than a split's room goes where most room is left.
    """
    pages = materialise(pages.join(forced, "root", "left"), "pages")
    share = {r["split"].strip().lower(): float(r["share"]) for r in targets.filter(F.col("split").isNotNull() & (F.col("share") > 0)).collect()}
    counts = {r["split"]: r["n"] for r in pages.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    room = {s: x / sum(share.values()) * total - counts.get(s, 0) for s, x in share.items()}
    free = pages.filter(F.col("split").isNull())
    where, sums = bins_of(free.groupBy(F.col("root").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    rows = list(allocate(sums, room).items()) if room else []
    spark = pages.sparkSession
    table = spark.createDataFrame(rows, "bin long, split string")
    placed = free.select("page_id", F.col("root").alias("item")).join(where, "item").join(F.broadcast(table), "bin").select("page_id", "split")
    return pages.filter(F.col("split").isNotNull()).select("page_id", "split").unionByName(placed)
