"""Filling fixed-capacity containers by a grouping genetic algorithm on islands (problem 8).

The genes are whole containers. A child takes well-filled containers of one parent unchanged and keeps
those of the other parent that share no document with them, but for its loosest and a few at random,
which are broken up. Displaced documents are first exchanged for smaller ones where that fills a
kept container better; the others, largest first, open containers that are each filled with the best
fitting set of the rest (sums of sizes as bits, so no set is missed). Documents are dealt to shards
of bounded size; several islands evolve each shard apart, then the islands' elites migrate to one
population, which evolves on. Documents of containers that are still loose are dealt anew once, so
that shards help each other out. A population rests when it meets a lower bound. Only a document
larger than a container is split: into full containers and one rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.bpe import TOKENIZERS, sizes
from codexmill.session import materialise

#: Documents in a shard, islands, members of a population, children an epoch, and the fill under which a container is dealt anew.
SHARD, ISLANDS, POPULATION, CHILDREN, LOOSE = 2000, 2, 6, 40, 0.985
#: Containers of up to so many documents are searched for pairs to exchange.
PAIRED = 12


def best_fit(items: list[int], size: list[int], capacity: int, bins: list[list]) -> list[list]:
    """Put items into bins ([fill, mask, members]) in the given order, each where the least room is left, else into a new one."""
    room = sorted((capacity - b[0], i) for i, b in enumerate(bins))
    for it in items:
        s = size[it]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, i = room.pop(at)
            b = bins[i]
            bins[i] = [b[0] + s, b[1] | 1 << it, b[2] + (it,)]
            insort(room, (left - s, i))
        else:
            bins.append([s, 1 << it, (it,)])
            insort(room, (capacity - s, len(bins) - 1))
    return bins


def fitness(bins: list[list], capacity: int) -> float:
    """Mean squared fill: prefers few containers and, among equals, fuller ones."""
    return sum(b[0] * b[0] for b in bins) / (max(1, len(bins)) * capacity * capacity)


def least_bins(size: list[int], capacity: int) -> int:
    """A lower bound: documents over half a container need one each, and what is left of these takes only so much of the others."""
    items = sorted(size)
    sums = [0]
    for x in items:
        sums.append(sums[-1] + x)
    half = bisect_right(items, capacity // 2)
    best = -(-sums[-1] // capacity)
    for a in {0, *(x for x in items[:half])}:
        # over capacity - a: alone; from there down to half: with others of at least a
        top = bisect_right(items, capacity - a)
        top = max(top, half)
        room = (top - half) * capacity - (sums[top] - sums[half])
        small = sums[half] - sums[bisect_left(items, a)]
        best = max(best, len(items) - half + max(0, -(-(small - room) // capacity)))
    return best


def exchange(bins: list[list], out: list[int], size: list[int], capacity: int) -> list[int]:
    """Put displaced documents in place of one or two smaller ones where they fill a container better; gives what is displaced then, largest first."""
    loose = sorted((size[i], i) for i in out)
    for k in sorted(range(len(bins)), key=lambda k: bins[k][0]):
        fill, mask, members = bins[k]
        held = list(members)
        while fill < capacity and loose:
            room, best = capacity - fill, (0, (), -1)
            pairs = [(held[a], held[b]) for a in range(len(held)) for b in range(a)] if len(held) <= PAIRED else []
            for given in [(x,) for x in held] + pairs:
                was = sum(size[x] for x in given)
                p = bisect_right(loose, (was + room, len(size))) - 1
                if p >= 0 and loose[p][0] - was > best[0]:
                    best = (loose[p][0] - was, given, p)
                    if best[0] == room:
                        break
            if not best[0]:
                break
            _, taken = loose.pop(best[2])
            for x in best[1]:
                held.remove(x)
                mask ^= 1 << x
                insort(loose, (size[x], x))
            held.append(taken)
            mask |= 1 << taken
            fill += best[0]
        bins[k] = [fill, mask, tuple(held)]
    return [i for _, i in reversed(loose)]


def best_set(order: list[int], size: list[int], room: int) -> list[int]:
    """Of the documents in order a set with the largest sum within the room."""
    reach, full = [1], (1 << room + 1) - 1
    for i in order:
        reach.append((reach[-1] | reach[-1] << size[i]) & full)
        if reach[-1] >> room & 1:
            break
    left, out = reach[-1].bit_length() - 1, []
    for k in range(len(reach) - 2, -1, -1):
        if not reach[k] >> left & 1:
            out.append(order[k])
            left -= size[order[k]]
    return out


def fill_up(out: list[int], size: list[int], capacity: int, bins: list[list]) -> list[list]:
    """Containers for displaced documents: each of the largest one left and the best fitting set of the others. Documents without size go anywhere."""
    rest = sorted((i for i in out if size[i]), key=lambda i: -size[i])
    while rest:
        first = rest.pop(0)
        members = (first, *best_set(rest, size, capacity - size[first]))
        held = set(members)
        bins.append([sum(size[x] for x in members), sum(1 << x for x in members), members])
        rest = [i for i in rest if i not in held]
    empty = [i for i in out if not size[i]]
    if empty:
        fill, mask, members = bins.pop() if bins else (0, 0, ())
        bins.append([fill, mask | sum(1 << x for x in empty), (*members, *empty)])
    return bins


def cross(one: list[list], two: list[list], size: list[int], capacity: int, rng) -> list[list]:
    """Inject well-filled containers of `two` into `one`."""
    good = sorted(two, key=lambda b: -b[0])
    good = good[: max(1, int(len(good) * 0.6))]
    take = [b for b in good if rng.random() < 0.5] or good[:1]
    used = 0
    for b in take:
        used |= b[1]
    child = [list(b) for b in take]
    displaced: list[int] = []
    kept = []
    for b in one:
        if b[1] & used:
            displaced.extend(i for i in b[2] if not used >> i & 1)
        else:
            kept.append(b)
    # of the first parent the loosest containers, and as many at random, are broken up as well
    kept.sort(key=lambda b: b[0])
    n = max(2, len(one) // 12)
    broken = set(range(min(n, len(kept)))) | (set(rng.integers(0, len(kept), n).tolist()) if kept else set())
    for k, b in enumerate(kept):
        if k in broken:
            displaced.extend(b[2])
        else:
            child.append(list(b))
    return fill_up(exchange(child, displaced, size, capacity), size, capacity, child)


def evolve(size: list[int], capacity: int, seed: int, members: list[list[list]] | None = None, population: int = POPULATION, children: int = CHILDREN) -> list[list]:
    """The best solution after an epoch; `members` are immigrants."""
    rng = np.random.default_rng(seed)
    n = len(size)
    down = sorted(range(n), key=lambda i: -size[i])
    pop = list(members or [])
    if not pop:
        pop.append(best_fit(down, size, capacity, []))
    while len(pop) < population:
        noise = rng.random(n)
        spread = 0.05 + 0.3 * rng.random()
        pop.append(best_fit(sorted(range(n), key=lambda i: -size[i] * (1 - spread * noise[i])), size, capacity, []))
    pop = sorted(((fitness(p, capacity), k, p) for k, p in enumerate(pop)), key=lambda x: -x[0])
    least = least_bins(size, capacity)
    for k in range(children):
        if len(pop[0][2]) <= least:
            break
        a, b = (min(rng.integers(0, len(pop), 2)) for _ in range(2))
        if a == b:
            b = (a + 1) % len(pop)
        child = cross(pop[a][2], pop[b][2], size, capacity, rng)
        f = fitness(child, capacity)
        # a copy of a member would only crowd it
        if f > pop[-1][0] and all(abs(f - p[0]) > 1e-12 for p in pop):
            pop[-1] = (f, population + k, child)
            pop.sort(key=lambda x: -x[0])
    return pop[0][2]


def _rows(pdf: pd.DataFrame, bins: list[list], **more) -> pd.DataFrame:
    at = np.zeros(len(pdf), dtype=np.int64)
    for b, (_, _, members) in enumerate(bins):
        at[list(members)] = b
    return pdf[["key", "size", "shard"]].assign(bin=at, **more)


def _fill(items: DataFrame, capacity: int, turn: int) -> DataFrame:
    """items (key, size) as (key, size, shard, bin)."""
    n = items.count()
    shards = max(1, -(-n // SHARD))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(shards)).cast("long"))
    kind = items.schema["key"].dataType.simpleString()

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        who = int(pdf["island"].iloc[0])
        return _rows(pdf, evolve(pdf["size"].tolist(), capacity, int(pdf["shard"].iloc[0]) * 31 + who + 1000 * turn), island=who)

    def migrate(pdf: pd.DataFrame) -> pd.DataFrame:
        members, base, size = [], None, None
        for _, g in pdf.groupby("island"):
            g = g.sort_values("key").reset_index(drop=True)
            if base is None:
                base, size = g, g["size"].tolist()
            bins: dict[int, list] = {}
            for i, b in enumerate(g["bin"].tolist()):
                x = bins.setdefault(b, [0, 0, ()])
                bins[b] = [x[0] + size[i], x[1] | 1 << i, x[2] + (i,)]
            members.append(list(bins.values()))
        return _rows(base, evolve(size, capacity, int(base["shard"].iloc[0]) * 31 + 7 + 1000 * turn, members))

    apart = dealt.withColumn("island", F.explode(F.array(*[F.lit(i).cast("long") for i in range(ISLANDS)])))
    # a shard is little to read and much to compute: its tasks are not to be put together by their bytes
    tasks = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    elites = apart.repartition(min(tasks, shards * ISLANDS), "shard", "island").groupBy("shard", "island").applyInPandas(island, f"key {kind}, size long, shard long, bin long, island long")
    return elites.repartition(min(tasks, shards), "shard").groupBy("shard").applyInPandas(migrate, f"key {kind}, size long, shard long, bin long")


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(key, piece_no, tokens, whole): a row for each document that fits, and for an oversize one a row for each full piece and the rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(capacity))).cast("int")
    cut = sized.select("key", "size", F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    return cut.select("key", "piece_no", F.least(F.lit(capacity).cast("long"), F.col("size") - (F.col("piece_no") - 1) * F.lit(capacity)).alias("tokens"), (F.col("size") <= capacity).alias("whole"))


def pack(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int, folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece_no, tokens, whole, container): every document's place.

    whole says that the document is in one piece; only one larger than the capacity is not. Null
    and empty texts have 0 tokens and take a place without space. A repeated key counts once, with
    its largest text. An empty table gives no rows; a capacity under 1 is an error.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = sizes(df, key, text, tokenizer, folder).select(F.col(key).alias("key"), "size").filter(F.col("key").isNotNull())
    cut = materialise(pieces(sized.groupBy("key").agg(F.max("size").alias("size")), capacity), "pieces")
    full = cut.filter(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), F.col("key").cast("string"), "piece_no"))
    # a document has at most one piece that is not full, so the key names the item
    rest = cut.filter(F.col("tokens") < capacity)
    first = materialise(_fill(rest.select("key", F.col("tokens").alias("size")), capacity, 1), "packed")
    fill = first.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
    judged = first.join(fill, ["shard", "bin"])
    kept = judged.filter(F.col("fill") >= LOOSE * capacity).select("key", F.concat_ws("-", F.lit("a"), "shard", "bin").alias("container"))
    loose = materialise(judged.filter(F.col("fill") < LOOSE * capacity).select("key", "size"), "loose")
    again = _fill(loose, capacity, 2).select("key", F.concat_ws("-", F.lit("b"), "shard", "bin").alias("container"))
    placed = rest.join(kept.unionByName(again), "key")
    return full.unionByName(placed).withColumnRenamed("key", key)
