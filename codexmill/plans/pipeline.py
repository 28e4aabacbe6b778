"""The whole chain as one lazily planned job: recorded outputs to consensus, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.operators import consensus, export, reports
from codexmill.sources import annotations
from codexmill.sources.files import Settings


def run_all(pages: DataFrame, outputs: DataFrame, settings: Settings, engines: DataFrame, with_benchmark: bool = False) -> dict[str, DataFrame]:
    """Named results: lines, pages, queue, disagreement, coverage, labels, line_dataset, xml and, if asked, benchmark.

    pages (page_id, book_id, image_path, width, height), outputs as engine pages, engines (engine,
    engine_rank, enabled). Nothing is computed until a result is written; a caller that writes
    several should write `lines` first and read it back.
    """
    lines = annotations.engine_lines(outputs).join(F.broadcast(engines.select("engine", "engine_rank")), "engine")
    lines = lines.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    aligned = consensus.align_lines(lines.select("page_id", "engine", "engine_rank", "line_ord", "line_id", "polygon", "baseline", "text", "confidence", "reading_order"), settings.iou_threshold)
    voted = consensus.consensus_of_clusters(aligned, settings.min_agreeing, settings.max_pairwise_edits, settings.near_edits, settings.strip_marks, settings.unicode_form)
    one = pages.select("page_id", "book_id").dropDuplicates(["page_id"])
    voted = voted.join(one, "page_id")
    texts = voted.select("line_id", F.explode("engine_outputs").alias("engine", "text"))
    files = pages.groupBy("page_id").agg(F.max("image_path").alias("image_path"), F.max("width").alias("width"), F.max("height").alias("height"))
    full = consensus.consensus_pages(voted.drop("book_id"), annotations.engine_failures(outputs)).join(files, "page_id", "left").withColumn("image_filename", F.element_at(F.split("image_path", "/"), -1))
    out = {
        "lines": voted,
        "pages": full,
        "queue": reports.review_queue(voted),
        "disagreement": reports.disagreement_matrix(consensus.pairs_of_engines(texts, ["line_id"])),
        "coverage": reports.coverage_matrix(one, "book_id"),
        "labels": reports.label_totals(voted),
        "line_dataset": export.line_dataset(voted, files),
        "xml": export.page_xml(full),
    }
    if with_benchmark:
        out["benchmark"] = reports.benchmark(annotations.engine_lines(outputs), voted.select("line_id", F.col("text_normalised").alias("text")))
    return out
