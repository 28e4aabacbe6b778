"""Reports, review queue, budget and benchmark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions.metrics import cer, fixed, wer_legacy
from codexmill.functions.text import first_text

# Labels of agreement.
LABELS = ("auto_accept", "near_agreement", "disagreement")


def label_totals(lines: DataFrame, by: list[str] | None = None, label: str = "confidence_label") -> DataFrame:
    """(by..., lines, auto_accept, near_agreement, disagreement), zeros filled."""
    counts = [F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col(label) == x).alias(x) for x in LABELS]]
    return lines.groupBy(*by).agg(*counts) if by else lines.agg(*counts)


def priority() -> Column:
    """10 for each disagreement, 4 for each near agreement, a quarter for each line."""
    return F.round((F.col("disagreement") * 10 + F.col("near_agreement") * 4).cast("decimal(20,3)") + (F.col("lines") * F.lit(25)).cast("decimal(20,3)") / 100, 3).cast("double")


def review_queue(lines: DataFrame) -> DataFrame:
    """Pages by urgency: score descending, then book and page. Order holds when written or shown."""
    t = label_totals(lines, ["book_id", "page_id"])
    rows = t.select(
        "page_id", "book_id", priority().alias("priority_score"), F.col("disagreement").alias("disagreement_lines"), F.col("lines").alias("total_lines"),
        F.lit("unknown").alias("era"), F.lit("sorani-arabic").alias("script"), F.lit("unknown").alias("typography"), F.lit("").alias("assigned_to"), F.lit("todo").alias("status"),
    )
    return rows.orderBy(F.desc("priority_score"), "book_id", "page_id")


def disagreement_matrix(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs (engine_a, engine_b, text_a, text_b) as line_pairs, mean_edit_distance and exact_agreement_rate (4 places)."""
    d = F.levenshtein("text_a", "text_b")
    g = pairs.withColumn("_d", d).groupBy(*(by or []), "engine_a", "engine_b")
    return g.agg(
        F.count(F.lit(1)).alias("line_pairs"),
        fixed(F.sum("_d") / F.count(F.lit(1)), 4).alias("mean_edit_distance"),
        fixed(F.count_if(F.col("_d") == 0) / F.count(F.lit(1)), 4).alias("exact_agreement_rate"),
    )


def coverage_matrix(pages: DataFrame, *by: str) -> DataFrame:
    """Pages per book, and per era, script or typography where they are known."""
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"))


def benchmark(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Per engine: lines, mean CER, mean legacy WER, line accuracy (6 places). Lines without gold are left out."""
    p = predictions.select("engine", "line_id", F.coalesce(first_text(F.col("text_normalised"), F.col("text")), F.lit("")).alias("pred"))
    j = p.join(gold.select("line_id", F.col("text").alias("truth")), "line_id").filter(F.col("truth").isNotNull())
    exact = F.when(F.col("pred") == F.col("truth"), 1.0).otherwise(0.0)
    mean = lambda c: fixed(F.avg(c.cast("decimal(28,12)")), 6)
    return j.groupBy("engine").agg(
        F.count(F.lit(1)).alias("lines"),
        mean(cer(F.col("pred"), F.col("truth"))).alias("cer"),
        mean(wer_legacy(F.col("pred"), F.col("truth"))).alias("wer"),
        mean(exact).alias("line_accuracy"),
    )


def budget(events: DataFrame) -> DataFrame:
    """(book_id, total_usd): per book, and with a null book the total (6 places)."""
    return events.rollup("book_id").agg(fixed(F.sum(F.col("estimated_usd").cast("decimal(28,12)")), 6).alias("total_usd"))


def change_report(changes: DataFrame, *by: str) -> DataFrame:
    """Counts of changes, most frequent first."""
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("changes")).orderBy(F.desc("changes"), *by)


def paired_test(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, mean difference, standard deviation, t and Cohen's d of paired values; t is 0 where nothing differs."""
    d = F.col(a) - F.col(b)
    g = values.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    size = F.when(F.col("sd") > 0, F.col("mean_difference") / F.col("sd")).otherwise(0.0)
    return g.select("n", "mean_difference", "sd", (size * F.sqrt("n")).alias("t"), size.alias("cohen_d"))


def daily_summary(lines: DataFrame, day: str) -> DataFrame:
    """One row with the Markdown text of the day's summary."""
    t = lines.agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence_label") == x).alias(x) for x in LABELS])
    return t.select(
        F.format_string(
            f"# OCR summary {day}\n\n- Pages with consensus: %d\n- Lines: %d\n- Auto accept: %d\n- Near agreement: %d\n- Disagreement: %d\n", "pages", "n", *LABELS
        ).alias("value")
    )
