"""Consensus of several annotators by iteratively reweighted voting (problem 2).

Votes on an item are kept together as one array of (annotator, answer). Items whose votes form the
same pattern behave alike in every round, so patterns are counted once and the rounds run over the
patterns. A round finds each pattern's weighted consensus, then each annotator's accuracy against
the consensus of the others on the same item (leave one out), smoothed; the log-odds of the
accuracy, plus the log of the number of wrong answers there are to choose from, is the next weight.
An annotator worse than chance counts against its answer. Where votes carry the annotator's
confidence, as its part of all the confidences that annotator gave (so that scales that differ do
not matter), the accuracy of each part is found in the same rounds, drawn towards the annotator's
own, and weighs the votes in it; a vote without confidence has the annotator's own weight.

Weights are a table, one row an annotator, that votes are joined with: small ones Spark broadcasts
by their size, large ones meet their votes in a shuffle. From round DAMPED on a round moves half
its way, so that rounds which would swing between two states settle.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.llm.scripts import look
from codexmill.session import discard, materialise

#: Distinct wrong answers a reader of open text is taken to have: independent errors seldom coincide.
OPEN_ANSWERS = 20
#: A round that moves no accuracy by more than this is the last.
STABLE = 1e-4
#: Rounds that move half their way come after so many; after ROUNDS without rest the state is reported as not converged.
DAMPED, ROUNDS = 10, 60
#: Pseudo-counts of the smoothed accuracy.
RIGHT, WRONG = 1.0, 1.0
#: Parts of equal size that an annotator's confidences are cut into, and pseudo-votes of the annotator's own accuracy in each part.
PARTS, DRAWN = 4, 10.0


def _has_parts(items: DataFrame) -> bool:
    return "part" in items.schema["votes"].dataType.elementType.names


def count_patterns(items: DataFrame) -> DataFrame:
    """items (votes) as (pid, votes, n), written to the shared folder."""
    counted = items.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counted.select(F.monotonically_increasing_id().alias("pid"), "votes", "n"), "patterns")


def single_votes(patterns: DataFrame) -> DataFrame:
    """(pid, n, annotator, part, answer): a row for every vote; part is null without confidences."""
    part = F.col("v.part") if _has_parts(patterns) else F.lit(None).cast("int")
    return patterns.select("pid", "n", F.explode("votes").alias("v")).select("pid", "n", F.col("v.annotator").alias("annotator"), part.alias("part"), F.col("v.answer").alias("answer"))


def weighed(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(pid, n, votes array<struct<annotator, part, answer, w>>): the weight of a vote is that of its annotator's part, else the annotator's, else 0; 1 before there are weights."""
    if weights is None:
        joined = votes.withColumn("w", F.lit(1.0))
    else:
        joined = votes.join(weights.select("annotator", "weight", "parts"), "annotator", "left")
        joined = joined.withColumn("w", F.coalesce(F.col("parts")[F.coalesce("part", F.lit(-1))], "weight", F.lit(0.0)))
    return joined.groupBy("pid").agg(F.first("n").alias("n"), F.collect_list(F.struct("annotator", "part", "answer", "w")).alias("votes"))


def _scores() -> Column:
    """array<struct<score, best, n, answer>> of the distinct answers in weighed `votes`."""

    def of(a):
        own = F.filter("votes", lambda v: v["answer"] == a)
        # sums come in any order
        score = F.round(F.aggregate(own, F.lit(0.0), lambda s, v: s + v["w"]), 9)
        return F.struct(score.alias("score"), F.round(F.array_max(F.transform(own, lambda v: v["w"])), 9).alias("best"), F.size(own).alias("n"), a.alias("answer"))

    return F.transform(F.array_distinct(F.transform("votes", lambda v: v["answer"])), of)


def consensus(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """(votes, consensus) of every pattern: the answer of the largest weight.

    Ties go to the answer with the best single annotator, then to more votes, then to the larger answer.
    """
    chosen = weighed(single_votes(patterns), weights).select("pid", F.array_max(_scores())["answer"].alias("consensus"))
    return patterns.join(chosen, "pid").select("votes", "consensus")


def _credit(v: Column) -> Column:
    """Share of the answers that lead among the others' votes which v's answer has: v's own vote taken out, its answer dropped where nobody else gave it."""
    same = lambda s: s["answer"] == v["answer"]
    less = lambda s: F.struct(F.when(same(s), s["score"] - v["w"]).otherwise(s["score"]).alias("score"), (s["n"] - F.when(same(s), 1).otherwise(0)).alias("n"), s["answer"].alias("answer"))
    others = F.filter(F.transform("scores", less), lambda s: s["n"] > 0)
    top = F.array_max(F.transform(others, lambda s: s["score"]))
    tied = F.filter(others, lambda s: s["score"] >= top - 1e-8)
    return F.when(F.exists(tied, same), 1.0 / F.size(tied)).otherwise(0.0)


def _next(votes: DataFrame, weights: DataFrame | None, gain: float, share: float) -> DataFrame:
    """One round: (annotator, n, accuracy, weight, accuracies, parts, moved), going `share` of the way from the accuracies of `weights`."""
    scored = weighed(votes, weights).withColumn("scores", _scores())
    each = scored.select("n", F.explode(F.transform("votes", lambda v: F.struct(v["annotator"].alias("annotator"), v["part"].alias("part"), _credit(v).alias("credit")))).alias("v"))
    by_part = each.groupBy("v.annotator", "v.part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v.credit")).alias("right"))
    of = by_part.groupBy("annotator").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.array_sort(F.collect_list(F.struct("part", "n", "right"))).alias("of"))
    found = of.withColumn("fresh", (F.col("right") + RIGHT) / (F.col("n") + RIGHT + WRONG))
    found = found.withColumn("of", F.filter("of", lambda p: p["part"].isNotNull()))
    drawn = lambda p: (p["right"] + DRAWN * F.col("fresh")) / (p["n"] + DRAWN)
    found = found.withColumn("fresh_parts", F.map_from_arrays(F.transform("of", lambda p: p["part"]), F.transform("of", drawn)))
    if weights is None:
        found = found.withColumns({"accuracy": F.col("fresh"), "accuracies": F.col("fresh_parts"), "moved": F.lit(1.0)})
    else:
        last = weights.select("annotator", F.col("accuracy").alias("was"), F.col("accuracies").alias("were"))
        way = lambda old, new: F.when(old.isNull(), new).otherwise(old + share * (new - old))
        found = found.join(last, "annotator", "left")
        found = found.withColumns({"accuracy": way(F.col("was"), F.col("fresh")), "accuracies": F.transform_values("fresh_parts", lambda k, x: way(F.col("were")[k], x))})
        steps = F.map_values(F.transform_values("fresh_parts", lambda k, x: F.abs(x - F.coalesce(F.col("were")[k], F.lit(2.0)))))
        found = found.withColumn("moved", F.greatest(F.abs(F.col("fresh") - F.coalesce("was", F.lit(2.0))), F.coalesce(F.array_max(steps), F.lit(0.0))))
    odds = lambda a: F.log(a / (1 - a)) + F.lit(gain)
    return found.select("annotator", "n", "accuracy", odds(F.col("accuracy")).alias("weight"), "accuracies", F.transform_values("accuracies", lambda k, a: odds(a)).alias("parts"), "moved")


def reliability(patterns: DataFrame, answers: int, rounds: int = ROUNDS) -> tuple[DataFrame, int, bool]:
    """Per annotator (annotator, n, accuracy, weight, accuracies, parts): votes, smoothed accuracy, weight, and both by part; the rounds it took, and whether they settled.

    An item with one annotator says nothing of it. No items give no rows; annotators start equal.
    """
    votes = materialise(single_votes(patterns.filter(F.size("votes") > 1)), "votes")
    gain = math.log(max(answers - 1, 1))
    weights = None
    for turn in range(1, rounds + 1):
        new = materialise(_next(votes, weights, gain, 1.0 if turn <= DAMPED else 0.5), "weights")
        moved = new.agg(F.max("moved")).first()[0]
        if weights is not None:
            discard(weights)
        weights = new
        if moved is None or moved < STABLE:
            break
    discard(votes)
    return weights.drop("moved"), turn, moved is None or moved < STABLE


def alpha(patterns: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """One row (items, ratings, observed, expected, alpha): Krippendorff's nominal alpha, for missing ratings.

    Only items with two ratings or more are pairable. Answers are compared by value; for open text,
    where an answer's number has no meaning on another item, `readings` (answer, k) gives how often
    each text was read on pairable items, and chance is that of meeting the same text twice. Null
    where nothing is pairable or nothing could disagree.
    """
    p = patterns.filter(F.size("votes") > 1).withColumn("m", F.size("votes"))
    each = readings if readings is not None else p.select("n", "m", F.explode("votes").alias("v")).groupBy(F.col("v.answer").alias("answer")).agg(F.sum("n").alias("k"))
    agree = p.select(
        "n",
        "m",
        F.aggregate(
            F.transform(F.array_distinct(F.transform("votes", lambda v: v["answer"])), lambda a: F.size(F.filter("votes", lambda v: v["answer"] == a))),
            F.lit(0).cast("long"),
            lambda s, c: s + c * (c - 1),
        ).alias("same"),
    )
    total = agree.agg(
        F.sum("n").alias("items"),
        F.sum(F.col("n") * F.col("m")).alias("ratings"),
        F.sum(F.col("n") * (F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("differ"),
    )
    spread = each.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
    both = total.crossJoin(spread)  # two single rows
    observed = F.try_divide(F.col("differ"), F.col("ratings"))
    expected = F.try_divide(F.col("ratings").cast("double") * F.col("ratings") - F.col("squares"), F.col("ratings").cast("double") * (F.col("ratings") - 1))
    return both.select("items", "ratings", observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def read_texts(items: DataFrame) -> DataFrame:
    """(answer, k): how often each text was read on lines with two readings or more; items with `readings`."""
    votes = items.filter(F.size("votes") > 1).select(F.explode(F.transform("votes", lambda v: F.get("readings", v["answer"]))).alias("answer"))
    return votes.groupBy("answer").agg(F.count(F.lit(1)).alias("k"))


VOTES = T.ArrayType(T.StructType([T.StructField("annotator", T.StringType()), T.StructField("answer", T.IntegerType())]))
VOTES_WITH_PARTS = T.ArrayType(T.StructType([*VOTES.elementType.fields, T.StructField("part", T.IntegerType())]))


def part_edges(consensus_lines: DataFrame) -> dict[str, list[float]]:
    """Per engine the inner edges between its PARTS parts of equal size, from the confidences of all lines: one row for each engine that names a key of the maps."""
    c = consensus_lines.filter(F.col("line_id").isNotNull()).select(F.explode("engine_confidences").alias("engine", "c")).filter(F.col("c").isNotNull() & ~F.isnan("c"))
    rows = c.groupBy("engine").agg(F.percentile_approx("c", [k / PARTS for k in range(1, PARTS)]).alias("edges")).collect()
    return {r["engine"]: list(r["edges"]) for r in rows}


def reading_items(consensus_lines: DataFrame, texts: bool = False) -> DataFrame:
    """(line_id, votes[, readings]) of every line once: each engine's non-empty reading, numbered by its look.

    Readings that look the same are one answer. Lines with a null map or only empty readings have
    no votes and are left out; of a line's rows that differ the one with the largest votes stands. With a column
    engine_confidences a vote has the part its confidence falls in among the engine's, counted
    from 0; null where the confidence is null, no number or missing.
    """
    parts = "engine_confidences" in consensus_lines.columns
    edges = part_edges(consensus_lines) if parts else {}
    votes_type = VOTES_WITH_PARTS if parts else VOTES
    schema = T.StructType([T.StructField("line_id", T.StringType()), T.StructField("votes", votes_type)] + ([T.StructField("readings", T.ArrayType(T.StringType()))] if texts else []))
    vote_type = pa.list_(pa.struct([("annotator", pa.string()), ("answer", pa.int32())] + ([("part", pa.int32())] if parts else [])))

    def part(engine, confidence):
        return None if confidence is None or confidence != confidence else bisect_left(edges.get(engine, []), confidence)

    def run(batches):
        for batch in batches:
            ids, votes, readings = [], [], []
            for line, engines, values, confidences in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                seen: dict[str, int] = {}
                looks: dict[str, str] = {}
                here = []
                for engine, text, confidence in sorted(zip(engines or [], values or [], confidences or []), key=lambda x: x[:2]):
                    form = looks.get(text)
                    if form is None:
                        form = looks[text] = look(text)
                    if form:
                        vote = {"annotator": engine, "answer": seen.setdefault(form, len(seen))}
                        here.append(vote | {"part": part(engine, confidence)} if parts else vote)
                if here:
                    ids.append(line)
                    votes.append(here)
                    readings.append(list(seen))
            cols = [pa.array(ids, pa.string()), pa.array(votes, vote_type)] + ([pa.array(readings, pa.list_(pa.string()))] if texts else [])
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    full = F.map_filter("engine_outputs", lambda k, v: v.isNotNull() & (F.length(v) > 0))
    given = F.col("engine_confidences") if parts else F.lit(None).cast("map<string,double>")
    lines = consensus_lines.filter(F.col("line_id").isNotNull()).select("line_id", full.alias("m"), given.alias("given"))
    lines = lines.select("line_id", F.map_keys("m").alias("e"), F.map_values("m").alias("t"), F.transform(F.map_keys("m"), lambda k: F.col("given")[k]).alias("c"))
    read = lines.mapInArrow(run, schema)
    rest = [c for c in read.columns if c != "line_id"]
    return read.groupBy("line_id").agg(F.max(F.struct(*rest)).alias("x")).select("line_id", "x.*")


#: Name under which the pipeline's own label votes beside the reviewers; it is weighed like them and never reported.
PIPELINE = "~pipeline"


def label_items(line_reviews: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(line_id, votes): of every reviewer the latest non-null label of a line; answers are the labels.

    With lines (line_id, confidence_label), a reviewed line's own label is one more vote.
    """
    ok = line_reviews.filter(F.col("line_id").isNotNull() & F.col("reviewer_id").isNotNull() & (F.trim("confidence_label") != ""))
    one = ok.groupBy("line_id", "reviewer_id").agg(F.max_by(F.trim("confidence_label"), F.struct("reviewed_at", "ingested_at", "confidence_label")).alias("answer"))
    items = one.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct(F.col("reviewer_id").alias("annotator"), "answer"))).alias("votes"))
    if lines is None:
        return items
    own = lines.filter(F.trim("confidence_label") != "").groupBy("line_id").agg(F.max(F.trim("confidence_label")).alias("own"))
    more = F.array(F.struct(F.lit(PIPELINE).alias("annotator"), F.col("own").alias("answer")))
    return items.join(own, "line_id", "left").select("line_id", F.when(F.col("own").isNull(), F.col("votes")).otherwise(F.array_sort(F.concat("votes", more))).alias("votes"))


def decide(items: DataFrame, answers: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items (line_id, votes, ...) with `consensus`; the annotators' statistics as from `reliability`; the patterns."""
    patterns = count_patterns(items)
    stats, _, _ = reliability(patterns, answers)
    return items.join(consensus(patterns, stats), "votes"), stats, patterns


def dissent(decided: DataFrame, least: int) -> DataFrame:
    """(line_id, annotator) of every vote that is not the consensus, on lines with at least so many votes."""
    losers = F.filter("votes", lambda v: (v["answer"] != F.col("consensus")) & (v["annotator"] != PIPELINE))
    return decided.filter(F.size("votes") >= least).select("line_id", F.explode(losers).alias("v")).select("line_id", F.col("v.annotator").alias("annotator"))


def agreement() -> Column:
    """Share of a line's pairs of votes that agree, null for fewer than two votes."""
    m = F.size("votes")
    same = F.aggregate(
        F.transform(F.array_distinct(F.transform("votes", lambda v: v["answer"])), lambda a: F.size(F.filter("votes", lambda v: v["answer"] == a))),
        F.lit(0),
        lambda s, c: s + c * (c - 1),
    )
    return F.when(m > 1, same / (m * (m - 1)))
