"""One-to-one box matching, visual reading order and covered area."""

from __future__ import annotations

from functools import reduce
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.operators.grouped import stream_groups


def iou(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    common = max(w, 0.0) * max(h, 0.0)
    union = max(a[2] - a[0], 0) * max(a[3] - a[1], 0) + max(b[2] - b[0], 0) * max(b[3] - b[1], 0) - common
    return common / union if union > 0 else 0.0


def greedy_match(predictions: list, truths: list, threshold: float) -> list[tuple[int, float]]:
    """For each predicted box in order, (index of its truth or -1, overlap): the best free truth, the earliest among equals."""
    free, out = set(range(len(truths))), []
    for p in predictions:
        best, arg = 0.0, -1
        for i in sorted(free):
            v = iou(p, truths[i])
            if v > best:
                best, arg = v, i
        if arg >= 0 and best >= threshold:
            free.discard(arg)
            out.append((arg, best))
        else:
            out.append((-1, best))
    return out


def match_boxes(predictions: DataFrame, truths: DataFrame, group: list[str], threshold: float = 0.5, by_score: bool = True) -> DataFrame:
    """(group..., pred_id, truth_id, overlap): boxes (group..., id, x1, y1, x2, y2; predictions also score) matched one to one per group.

    The group is an image and class: its boxes are few. Unmatched predictions have a null truth_id.
    by_score takes predictions by descending score, else by id. A prediction with a null in its
    group matches nothing.
    """
    box = ["x1", "y1", "x2", "y2"]
    score = -F.col("score").cast("double") if by_score else F.lit(0.0)
    p = predictions.select(*group, F.lit(0).alias("_side"), score.alias("_score"), F.col("id").alias("pred_id"), F.lit(None).cast(truths.schema["id"].dataType).alias("truth_id"), *box)
    t = truths.select(*group, F.lit(1).alias("_side"), F.lit(0.0).alias("_score"), F.lit(None).cast(predictions.schema["id"].dataType).alias("pred_id"), F.col("id").alias("truth_id"), *box)
    fields = [predictions.schema[g] for g in group] + [T.StructField("pred_id", predictions.schema["id"].dataType), T.StructField("truth_id", truths.schema["id"].dataType), T.StructField("overlap", T.DoubleType())]

    def run(table: pa.Table, spans: list[tuple[int, int]]) -> pa.Table:
        sides, ids = table.column("_side").to_pylist(), table.column("truth_id").to_pylist()
        boxes = list(zip(*[table.column(c).to_pylist() for c in box]))
        keep, truth, overlap = [], [], []
        for at, end in spans:
            cut = next((i for i in range(at, end) if sides[i]), end)
            for i, (k, v) in enumerate(greedy_match(boxes[at:cut], boxes[cut:end], threshold), at):
                keep.append(i)
                truth.append(ids[cut + k] if k >= 0 else None)
                overlap.append(v)
        own = table.select([*group, "pred_id"]).take(pa.array(keep, pa.int64()))
        return own.append_column("truth_id", pa.array(truth, table.schema.field("truth_id").type)).append_column("overlap", pa.array(overlap, pa.float64()))

    done = stream_groups(p.unionByName(t), group, ["_side", "_score", "pred_id", "truth_id"], run, T.StructType(fields))
    lost = p.filter(reduce(lambda a, b: a | b, (F.col(g).isNull() for g in group)))
    return done.unionByName(lost.select(*group, "pred_id", "truth_id", F.lit(0.0).alias("overlap")))


def precision_recall(counts: DataFrame, by: str) -> DataFrame:
    """counts (by, tp, fp, fn) as precision, recall and f1 per class and, with a null class, overall."""
    s = counts.rollup(by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    d = lambda v: F.round(v.cast("decimal(38,12)"), 4).cast("double")
    return s.select(by, "tp", "fp", "fn", d(p).alias("precision"), d(r).alias("recall"), d(f).alias("f1"))


def visual_rows(boxes: list[tuple], share: float = 0.6) -> list[tuple[int, int]]:
    """(row, place from the right) of boxes (x1, y1, x2, y2): rows gather boxes near a row's running mean centre."""
    if not boxes:
        return []
    reach = share * median([b[3] - b[1] for b in boxes])
    order = sorted(range(len(boxes)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, i))
    rows: list[list[int]] = []
    centre = 0.0
    for i in order:
        c = (boxes[i][1] + boxes[i][3]) / 2
        if rows and abs(c - centre) <= reach:
            rows[-1].append(i)
            centre += (c - centre) / len(rows[-1])
        else:
            rows.append([i])
            centre = c
    out = [(0, 0)] * len(boxes)
    for r, members in enumerate(rows, 1):
        for k, i in enumerate(sorted(members, key=lambda i: (-boxes[i][2], i)), 1):
            out[i] = (r, k)
    return out


def order_rows(boxes: DataFrame, group: str, share: float = 0.6) -> DataFrame:
    """boxes (group, id, x1, y1, x2, y2) with row_no and place_no, right to left within a row; both are null for a null group."""
    fields = [boxes.schema[group], boxes.schema["id"], T.StructField("row_no", T.IntegerType()), T.StructField("place_no", T.IntegerType())]

    def run(table: pa.Table, spans: list[tuple[int, int]]) -> pa.Table:
        all_ = list(zip(*[table.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2")]))
        done = [x for at, end in spans for x in visual_rows(all_[at:end], share)]
        return table.select([group, "id"]).append_column("row_no", pa.array([a for a, _ in done], pa.int32())).append_column("place_no", pa.array([b for _, b in done], pa.int32()))

    done = stream_groups(boxes.select(group, "id", "x1", "y1", "x2", "y2"), [group], ["id"], run, T.StructType(fields))
    none = F.lit(None).cast("int")
    return done.unionByName(boxes.filter(F.col(group).isNull()).select(group, "id", none.alias("row_no"), none.alias("place_no")))


def covered_area(boxes: DataFrame, group: str) -> DataFrame:
    """(group, area) covered by boxes (group, x1, y1, x2, y2), overlaps counted once.

    Vertical slabs between neighbouring edges; in each, the newly covered height of the boxes that
    span it, in order of their tops. Groups without area are there with 0.
    """
    b = boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    edges = b.select(group, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    w = Window.partitionBy(group).orderBy("x")
    slabs = edges.withColumn("to", F.lead("x").over(w)).filter("to is not null")
    inside = slabs.join(b, group).filter((F.col("x1") <= F.col("x")) & (F.col("x2") >= F.col("to")))
    up = Window.partitionBy(group, "x").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1)
    new = inside.withColumn("reach", F.max("y2").over(up))
    height = F.greatest(F.lit(0.0), F.col("y2") - F.greatest("y1", F.coalesce("reach", "y1")))
    area = new.select(group, ((F.col("to") - F.col("x")) * height).alias("a")).groupBy(group).agg(F.sum("a").alias("area"))
    return boxes.select(group).distinct().join(area, group, "left").select(group, F.coalesce("area", F.lit(0.0)).alias("area"))
