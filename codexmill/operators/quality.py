"""Detection quality, dataset gate, and validation of books' pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates of the detection quality.
CONFIDENT, GOOD, MEDIUM, LEAST_LINES, LEAST_COVERAGE = 0.40, 0.70, 0.50, 3, 5.0
# Shares of the dataset's decision.
PROCEED, PREPROCESS = 0.70, 0.50


def quality_flag(lines: Column, confidence: Column, coverage: Column) -> Column:
    return (
        F.when((confidence >= GOOD) & (lines >= LEAST_LINES) & (coverage >= LEAST_COVERAGE), "GOOD").when((confidence >= MEDIUM) & (lines >= 1), "MEDIUM").otherwise("POOR")
    )


def detection_metrics(items: DataFrame, image: str, confidence: str, area: str, size: str, label: str) -> DataFrame:
    """Per image: boxes, accepted lines, mean and largest confidence (4 places), coverage % (2), flag of the unrounded values.

    area is the covered area of the image's accepted boxes and size the image's area, the same on all its rows.
    """
    ok = F.col(confidence) >= CONFIDENT
    r = lambda v, k: F.round(v.cast("decimal(38,12)"), k).cast("double")
    g = items.groupBy(image).agg(
        F.count(F.lit(1)).alias("boxes"),
        F.count_if(ok).alias("lines"),
        F.coalesce(F.avg(F.when(ok, F.col(confidence).cast("decimal(28,12)"))).cast("double"), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.max(F.when(ok, F.col(confidence))), F.lit(0.0)).alias("_max"),
        F.coalesce(F.try_divide(F.max(area) * 100.0, F.max(size)), F.lit(0.0)).alias("_cov"),
        F.count_distinct(label).alias("labels"),
    )
    return g.select(
        image, "boxes", "lines", r(F.col("_avg"), 4).alias("avg_confidence"), r(F.col("_max"), 4).alias("max_confidence"), r(F.col("_cov"), 2).alias("coverage_pct"), "labels",
        quality_flag(F.col("lines"), F.col("_avg"), F.col("_cov")).alias("flag"),
    )


def dataset_gate(metrics: DataFrame) -> DataFrame:
    """One row: counts, rates, means of the rounded values, and PROCEED, PREPROCESS or SWITCH. No image gives SWITCH."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    r = lambda v, k: F.round(v.cast("decimal(38,12)"), k).cast("double")
    flag = lambda f: F.count_if(F.col("flag") == f)
    good, usable = flag("GOOD") / n, (flag("GOOD") + flag("MEDIUM")) / n
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("decimal(28,12)")).cast("double"), F.lit(0.0))
    return metrics.agg(
        F.count(F.lit(1)).alias("total"),
        flag("GOOD").alias("good"),
        flag("MEDIUM").alias("medium"),
        flag("POOR").alias("poor"),
        r(good, 4).alias("good_rate"),
        r(usable, 4).alias("usable_rate"),
        r(mean("avg_confidence"), 4).alias("avg_confidence"),
        r(mean("coverage_pct"), 2).alias("avg_coverage_pct"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"),
        F.when(good >= PROCEED, "PROCEED").when(usable >= PREPROCESS, "PREPROCESS").otherwise("SWITCH").alias("decision"),
    )


def missing_numbers(found: DataFrame, key: str, number: str, expected: DataFrame, last: str) -> DataFrame:
    """(key, number) that should be there from 1 to `last` (of expected (key, last)) and is not."""
    all_ = expected.filter(F.col(last) > 0).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(last).cast("long"))).alias(number))
    return all_.join(found.select(key, F.col(number).cast("long").alias(number)).distinct(), [key, number], "left_anti")


def dimension_mismatches(pages: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key..., width, height) whose size differs from the expected one; pages without expectation pass."""
    e = expected.select(*key, F.col("width").alias("want_width"), F.col("height").alias("want_height"))
    return pages.join(e, key).filter((F.col("width") != F.col("want_width")) | (F.col("height") != F.col("want_height")))


def validate_books(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Rollup of pages (book_id, page_no, width, height, bytes) against expected (book_id, expected_pages).

    Null sizes are corrupt pages. Status: failed without pages, partial with missing or corrupt
    pages, else complete.
    """
    mp = F.col("width") * F.col("height")
    text = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    g = pages.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("corrupt"),
        F.min_by(text, F.when(mp.isNotNull(), F.struct(mp, "width"))).alias("min_resolution"),
        F.max_by(text, F.when(mp.isNotNull(), F.struct(mp, "width"))).alias("max_resolution"),
        F.avg((mp / 1e6).cast("decimal(28,12)")).alias("_mp"),
    )
    gone = missing_numbers(pages, "book_id", "page_no", expected, "expected_pages").groupBy("book_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page_no")), lambda x: x.cast("string")), ";").alias("missing_pages")
    )
    j = expected.join(g, "book_id", "left").join(gone, "book_id", "left")
    found, corrupt = F.coalesce("found", F.lit(0)), F.coalesce("corrupt", F.lit(0))
    missing = F.coalesce("missing_pages", F.lit(""))
    status = F.when(found == 0, "failed").when((missing != "") | (corrupt > 0), "partial").otherwise("complete")
    return j.select(
        "book_id", "expected_pages", found.alias("found"), corrupt.alias("corrupt"), missing.alias("missing_pages"), "min_resolution", "max_resolution",
        F.round(F.coalesce("_mp", F.lit(0).cast("decimal(28,12)")), 2).cast("double").alias("avg_megapixels"), status.alias("status"),
    )


def layout_histogram(items: DataFrame, image: str, label: str) -> DataFrame:
    """(image, labels): a map from label to number of boxes for every image; counted before labels are gathered, of which an image has few."""
    n = items.groupBy(image, label).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col(label).isNotNull()).groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("labels"))


def size_total(files: DataFrame, size: str, by: list[str]) -> DataFrame:
    """(by..., files, bytes): number and total size; files of unknown size count as none."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
