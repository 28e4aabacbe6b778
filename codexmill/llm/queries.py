"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _grouped(spark, d):
    from codexmill.llm.splits import grouped_pages

    return grouped_pages(
        table(spark, d, "page_refs", "book_id", "page_id", "ingested_at"),
        table(spark, d, "books", "book_id", "authors", "copy_of"),
        table(spark, d, "pipeline_configs", "test_book_ids", "val_book_ids"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The pages whose component the lists decide, out of the whole assignment."""
    from codexmill.llm.splits import assign
    from codexmill.session import materialise

    pages, forced = _grouped(spark, d)
    pages, forced = materialise(pages, "grouped"), materialise(forced, "forced")
    placed = assign(pages, forced, table(spark, d, "split_targets"))
    listed = pages.join(forced.select("root"), "root", "left_semi").select("page_id")
    return placed.join(listed, "page_id", "left_semi")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """page_id, split of every page."""
    from codexmill.llm.splits import assign

    pages, forced = _grouped(spark, d)
    return assign(pages, forced, table(spark, d, "split_targets"))


def _readings(spark, d, texts=False):
    from codexmill.llm.annotators import reading_items

    return reading_items(table(spark, d, "consensus_lines", "line_id", "engine_outputs", "engine_confidences"), texts)


def _labels(spark, d):
    from codexmill.llm.annotators import label_items

    reviews = table(spark, d, "line_reviews", "line_id", "reviewer_id", "confidence_label", "reviewed_at", "ingested_at")
    return label_items(reviews, table(spark, d, "consensus_lines", "line_id", "confidence_label"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.annotators import OPEN_ANSWERS, decide, dissent
    from codexmill.session import materialise

    readings, _, _ = decide(materialise(_readings(spark, d), "readings"), OPEN_ANSWERS)
    labels, _, _ = decide(materialise(_labels(spark, d), "labels"), 3)
    return dissent(readings, 2).unionByName(dissent(labels, 1))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    """line_id, reading, reading_agreement, label, label_agreement: agreement is the share of agreeing pairs of votes."""
    from codexmill.llm.annotators import OPEN_ANSWERS, agreement, decide
    from codexmill.session import materialise

    readings, _, _ = decide(materialise(_readings(spark, d, True), "readings"), OPEN_ANSWERS)
    labels, _, _ = decide(materialise(_labels(spark, d), "labels"), 3)
    r = readings.select("line_id", F.get("readings", F.col("consensus")).alias("reading"), agreement().alias("reading_agreement"))
    return r.join(labels.select("line_id", F.col("consensus").alias("label"), agreement().alias("label_agreement")), "line_id", "full")


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    """kind, annotator, n, accuracy, weight, alpha, rounds, converged: reliability of every engine and reviewer, and the kind's chance-corrected agreement and its rounds."""
    from functools import reduce

    from codexmill.llm.annotators import OPEN_ANSWERS, PIPELINE, alpha, count_patterns, read_texts, reliability
    from codexmill.session import materialise

    out = []
    readings = materialise(_readings(spark, d, True), "readings")
    for kind, items, texts, answers in (("engine", readings, read_texts(readings), OPEN_ANSWERS), ("reviewer", _labels(spark, d), None, 3)):
        patterns = count_patterns(items)
        stats, rounds, converged = reliability(patterns, answers)
        row = stats.filter(F.col("annotator") != PIPELINE).select(F.lit(kind).alias("kind"), "annotator", "n", "accuracy", "weight")
        a = alpha(patterns, texts).select("alpha")  # one row
        out.append(row.crossJoin(F.broadcast(a)).withColumns({"rounds": F.lit(rounds), "converged": F.lit(converged)}))
    return reduce(DataFrame.unionByName, out)


def _split_lines(spark, d):
    from codexmill.llm.overlap import split_lines
    from codexmill.session import materialise

    lines = table(spark, d, "consensus_lines", "line_id", "page_id", "book_id", "text_normalised")
    return materialise(split_lines(lines, table(spark, d, "page_refs", "page_id", "split", "ingested_at")), "lines")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.overlap import overlaps

    o = overlaps(_split_lines(spark, d))
    return o.select(F.least("eval_line", "train_line").alias("line_id_a"), F.greatest("eval_line", "train_line").alias("line_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.overlap import report

    return report(_split_lines(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """line_id, split, class_id, links: every line of a page with a split, its text's class and the number of texts across the splits it is linked to."""
    from codexmill.llm.overlap import linked_lines

    return linked_lines(_split_lines(spark, d))


def _scan(spark, d):
    from codexmill.llm.repair import scanned

    return scanned(table(spark, d, "consensus_lines", "line_id", "page_id", "book_id", "reading_order", "text_raw"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.repair import kinds, links
    from codexmill.session import materialise

    read = _scan(spark, d)
    return kinds(read, materialise(links(read), "links"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """page_id, engine, output_id, paragraph_no, text: of the consensus lines, where engine and output_id are null, and of every output of engine_pages."""
    from codexmill.llm.repair import OUTPUT_MARK, line_read, links, page_outputs, paragraphs, scanned

    read = _scan(spark, d)
    pages = scanned(page_outputs(table(spark, d, "engine_pages", "output_id", "page_id", "book_id", "engine", "lines")))
    both = paragraphs(read, links(read)).unionByName(paragraphs(pages, links(pages, line_read())))
    of = F.split("output", OUTPUT_MARK, 2)
    engine, output = F.get(of, F.lit(1)), F.when(F.col("output") != "", F.get(of, F.lit(0))).cast("long")
    return both.select("page_id", engine.alias("engine"), output.alias("output_id"), "paragraph_no", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.forms import same_look_other_characters

    return same_look_other_characters(table(spark, d, "engine_pages", "engine", "lines"), table(spark, d, "consensus_lines", "line_id", "text_normalised"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """line_id, engine, output_id, child_no, text_form: every text in one form, in the unicode form its book's configuration names.

    Texts are those of consensus_lines, where engine, output_id and child_no are null, and every engine's line of engine_pages.
    """
    from codexmill.llm.forms import consistent_forms, page_readings
    from codexmill.llm.keys import book_key_udf, book_or_page_udf

    lines = table(spark, d, "consensus_lines", "line_id", "page_id", "book_id", "text_normalised").select(
        "line_id", book_or_page_udf("book_id", "page_id").alias("book_key"), F.col("text_normalised").alias("text")
    )
    forms = (
        table(spark, d, "books", "book_id", "config_id")
        .join(table(spark, d, "pipeline_configs", "config_id", "unicode_form"), "config_id")
        .select(book_key_udf("book_id").alias("book_key"), "unicode_form")
    )
    readings = page_readings(table(spark, d, "engine_pages", "output_id", "page_id", "book_id", "engine", "lines")).withColumn("book_key", book_or_page_udf("book_id", "page_id"))
    read = consistent_forms(readings, forms, ("output_id", "child_no"), ("line_id", "engine"))
    return consistent_forms(lines, forms).unionByName(read, allowMissingColumns=True).select("line_id", "engine", "output_id", "child_no", "text_form")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.bpe import encode

    return encode(table(spark, d, "documents", "doc_id", "text"))


def _profiles(spark, d) -> dict:
    return {r["profile_id"]: r for r in table(spark, d, "pack_profiles").collect()}


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split."""
    from codexmill.llm.packing import pack

    p = _profiles(spark, d)[1]
    packed = pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", p["tokenizer"], p["capacity"])
    return packed.filter(~F.col("whole")).select("doc_id").distinct()


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, doc_id, piece_no, tokens, container of every profile."""
    from functools import reduce

    from codexmill.llm.packing import pack

    docs = table(spark, d, "documents", "doc_id", "text")
    each = [pack(docs, "doc_id", "text", p["tokenizer"], p["capacity"]).select(F.lit(k).alias("profile_id"), "doc_id", "piece_no", "tokens", "container") for k, p in sorted(_profiles(spark, d).items())]
    return reduce(DataFrame.unionByName, each)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.sentences import sentence_units

    return sentence_units(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    from codexmill.llm.sentences import sentence_units

    return sentence_units(table(spark, d, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
