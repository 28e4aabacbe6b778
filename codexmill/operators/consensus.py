"""Alignment of engine lines, plurality vote and agreement labels.

Alignment follows the order of engines and lines, which no set operation can express: it runs as a
grouped map over one page at a time. Everything after it is built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions.geometry import polygon_iou
from codexmill.functions.text import normalise_sorani
from codexmill.functions.ids import line_id as line_key
from codexmill.operators.grouped import stream_groups


def _rectangle(poly: list) -> tuple | None:
    """(x1, y1, x2, y2) if the polygon is an upright rectangle."""
    if len(poly) != 4:
        return None
    xs, ys = sorted({p[0] for p in poly}), sorted({p[1] for p in poly})
    if len(xs) != 2 or len(ys) != 2 or len({(p[0], p[1]) for p in poly}) != 4:
        return None
    if poly[0][0] != poly[1][0] and poly[0][1] != poly[1][1]:
        return None
    return xs[0], ys[0], xs[1], ys[1]


class _Page:
    """Lines of a page with their clusters. Upright rectangles are compared with all earlier lines at once."""

    def __init__(self, most: int):
        self.polys: list = []
        self.boxes = np.zeros((most, 4))
        self.areas = np.zeros(most)
        self.owner = np.full(most, -1, dtype=np.int64)
        self.odd: list[int] = []  # lines that are no upright rectangles

    def best(self, poly, box) -> tuple[float, int]:
        """The largest overlap with a present line, and the earliest cluster that has it."""
        n = len(self.polys)
        if not n:
            return 0.0, -1
        if box is not None:
            b = self.boxes[:n]
            w = np.minimum(b[:, 2], box[2]) - np.maximum(b[:, 0], box[0])
            h = np.minimum(b[:, 3], box[3]) - np.maximum(b[:, 1], box[1])
            common = np.maximum(w, 0) * np.maximum(h, 0)
            score = common / np.maximum(self.areas[:n] + (box[2] - box[0]) * (box[3] - box[1]) - common, 1e-300)
            rest = self.odd
        else:
            score, rest = np.zeros(n), range(n)
        for i in rest:
            score[i] = polygon_iou(self.polys[i], poly)
        owner = self.owner[:n]
        score[owner < 0] = 0.0
        top = float(score.max())
        return (top, int(owner[score == top].min())) if top > 0 else (0.0, -1)

    def add(self, poly, box, cluster: int) -> None:
        n = len(self.polys)
        self.polys.append(poly)
        self.owner[n] = cluster
        if box is None:
            self.odd.append(n)
        else:
            self.boxes[n] = box
            self.areas[n] = (box[2] - box[0]) * (box[3] - box[1])


def cluster_lines(lines: list[tuple], threshold: float) -> list[tuple[int, bool]]:
    """(cluster, overwritten) for lines (engine, polygon) in order.

    A line joins the earliest cluster of the largest overlap with any present member, if that is at
    least the threshold and above 0; it takes the place of a line of its own engine there.
    """
    page, out, present = _Page(len(lines)), [], []
    for at, (engine, poly) in enumerate(lines):
        box = _rectangle(poly)
        best, arg = page.best(poly, box)
        if arg >= 0 and best >= threshold:
            old = present[arg].get(engine)
            if old is not None:
                out[old] = (out[old][0], True)
                page.owner[old] = -1
            present[arg][engine] = at
        else:
            arg = len(present)
            present.append({engine: at})
        page.add(poly, box, arg)
        out.append((arg, False))
    return out


def align_lines(lines: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """lines (page_id, engine, engine_rank, line_ord, polygon, ...) with `cluster` (from 1) and `overwritten`.

    Within a page, lines are taken by (engine_rank, engine, line_ord). One shuffle brings a page's
    lines together, sorted; a worker then streams over its pages and holds one at a time, the lines
    printed on it. A null polygon overlaps nothing; lines of a null page, which lie on no known page, are left out.
    """
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    schema = T.StructType(lines.schema.fields + [T.StructField("cluster", T.IntegerType()), T.StructField("overwritten", T.BooleanType())])

    def settle(table: pa.Table, spans: list[tuple[int, int]]) -> pa.Table:
        engines, polys, limits = (table.column(c).to_pylist() for c in ("engine", "polygon", "_threshold"))
        cluster, lost = [], []
        for at, end in spans:
            done = cluster_lines([(engines[i], [tuple(q) for q in polys[i] or ()]) for i in range(at, end)], limits[at])
            cluster += [c + 1 for c, _ in done]
            lost += [o for _, o in done]
        return table.drop_columns(["_threshold"]).append_column("cluster", pa.array(cluster, pa.int32())).append_column("overwritten", pa.array(lost, pa.bool_()))

    return stream_groups(lines.withColumn("_threshold", thr), ["page_id"], ["engine_rank", "engine", "line_ord"], settle, schema)


def plurality(votes: DataFrame, item: list[str], text: str = "text", rank: str = "rank") -> DataFrame:
    """(item..., text, votes): the text most often given.

    Empty and null texts don't vote. Ties go to the text given by the voter of the lowest rank,
    then to the smallest text; voters without a rank come last. Items without a vote have no row.
    """
    full = votes.filter(F.length(text) > 0)
    each = full.groupBy(*item, text).agg(F.count(F.lit(1)).alias("votes"), F.min(rank).alias("_first"))
    # the maximum of a struct combines before the shuffle, where a window would not
    no = F.coalesce(F.col("_first").cast("double"), F.lit(float("inf")))
    best = F.min_by(F.struct(text, "votes"), F.struct(-F.col("votes"), no, F.col(text)))
    return each.groupBy(*item).agg(best.alias("_b")).select(*item, F.col(f"_b.{text}").alias(text), F.col("_b.votes").alias("votes"))


def max_pairwise(texts: Column) -> Column:
    """Largest edit distance between any two of an array of texts, 0 for fewer than two."""
    some = F.array_distinct(texts)  # equal texts add no distance, and most texts are equal
    later = lambda i: F.slice(some, i + 2, F.greatest(F.size(some) - i - 1, F.lit(0)))
    far = F.transform(some, lambda a, i: F.coalesce(F.array_max(F.transform(later(i), lambda b: F.levenshtein(a, b))), F.lit(0)))
    return F.coalesce(F.array_max(far), F.lit(0))


def agreement_label(texts: Column, votes: Column, agreeing: Column, most_edits: Column, near_edits: Column) -> Column:
    """auto_accept, near_agreement or disagreement of texts in engine order; nearness is to the first text."""
    near = F.size(F.filter(texts, lambda t: (t == texts[0]) | (F.levenshtein(t, texts[0]) <= near_edits)))
    return (
        F.when((votes >= agreeing) & (max_pairwise(texts) <= most_edits), "auto_accept")
        .when((votes >= agreeing) | (near >= agreeing), "near_agreement")
        .otherwise("disagreement")
    )


def consensus_of_clusters(aligned: DataFrame, agreeing: int = 3, most_edits: int = 0, near_edits: int = 3, strip: bool = True, form: str = "NFC") -> DataFrame:
    """One consensus line per cluster of `align_lines` (with columns line_id, text, reading_order, baseline, confidence).

    text_raw and text_normalised are voted apart; the first member gives the geometry, the key and the order.
    """
    live = aligned.filter(~F.col("overwritten")).withColumn("text", F.coalesce("text", F.lit("")))
    live = live.withColumn("normal", normalise_sorani(F.col("text"), strip, form))
    item = ["page_id", "cluster"]
    member = F.struct("engine_rank", "engine", "line_ord", "line_id", "polygon", "baseline", "text", "normal", "confidence", "reading_order")
    # one cluster holds at most one line an engine: the list is bounded by the engines
    grouped = live.groupBy(*item).agg(F.array_sort(F.collect_list(member)).alias("m"))

    def vote(field: str) -> Column:
        texts = F.filter(F.transform("m", lambda x: x[field]), lambda t: F.length(t) > 0)
        ranked = F.transform(F.array_distinct(texts), lambda t, i: F.struct((-F.size(F.filter(texts, lambda u: u == t))).alias("n"), i.alias("i"), t.alias("t")))
        return F.array_min(ranked)

    g = grouped.withColumn("raw", vote("text")).withColumn("top", vote("normal"))
    texts = F.transform("m", lambda x: x["normal"])
    votes = F.coalesce(-F.col("top.n"), F.lit(0))
    first = F.col("m")[0]
    lit = F.lit
    return g.select(
        "page_id",
        F.coalesce(F.nullif(first["line_id"], lit("")), line_key(F.col("page_id"), F.col("cluster"))).alias("line_id"),
        first["polygon"].alias("polygon"),
        first["baseline"].alias("baseline"),
        F.coalesce("raw.t", lit("")).alias("text_raw"),
        F.coalesce("top.t", lit("")).alias("text_normalised"),
        agreement_label(texts, votes, lit(agreeing), lit(most_edits), lit(near_edits)).alias("confidence_label"),
        F.map_from_entries(F.transform("m", lambda x: F.struct(x["engine"], x["text"]))).alias("engine_outputs"),
        F.map_from_entries(F.transform("m", lambda x: F.struct(x["engine"], x["confidence"]))).alias("engine_confidences"),
        votes.cast("long").alias("engine_consensus_count"),
        max_pairwise(texts).cast("long").alias("max_pairwise_distance"),
        F.coalesce(F.nullif(first["reading_order"], lit(0).cast("long")), F.col("cluster").cast("long")).alias("reading_order"),
    )


def consensus_pages(lines: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(page_id, lines, failed_engines): lines in reading order; the map holds engines that failed only."""
    fields = [c for c in lines.columns if c != "page_id"]
    ordered = ["reading_order", *[c for c in fields if c not in ("reading_order", "engine_outputs", "engine_confidences")]]
    maps = [c for c in fields if c in ("engine_outputs", "engine_confidences")]
    # maps have no order, so they ride behind the sort key
    entry = F.struct(F.struct(*ordered).alias("k"), *maps)
    by = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(entry), by).alias("lines"))
    pages = pages.withColumn("lines", F.transform("lines", lambda x: F.struct(*[x["k"][c].alias(c) for c in ordered], *[x[c].alias(c) for c in maps])))
    if failures is None:
        return pages
    failed = failures.groupBy("page_id", "engine").agg(F.collect_list(F.struct("error_type", "message", "recoverable")).alias("f"))
    failed = failed.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("engine", "f"))).alias("failed_engines"))
    return pages.join(failed, "page_id", "left")


def pairs_of_engines(lines: DataFrame, key: list[str], engine: str = "engine", text: str = "text") -> DataFrame:
    """(key..., engine_a, engine_b, text_a, text_b): unordered pairs of engines with a text on the same line."""
    a = lines.select(*key, F.col(engine).alias("engine_a"), F.col(text).alias("text_a"))
    b = lines.select(*key, F.col(engine).alias("engine_b"), F.col(text).alias("text_b"))
    return a.join(b, key).filter(F.col("engine_a") < F.col("engine_b"))


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order, ties by all other columns: a window-free last-wins."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def reading_order(df: DataFrame, group: list[str], order: str, tie: list[str]) -> DataFrame:
    """df with `ord`: the given order, or the row's own place where it is null or 0, then `place` by it (stable)."""
    w = Window.partitionBy(*group).orderBy(*tie)
    with_ord = df.withColumn("ord", F.coalesce(F.nullif(F.col(order).cast("long"), F.lit(0).cast("long")), F.row_number().over(w).cast("long")))
    return with_ord.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("ord", *tie)).cast("long"))
