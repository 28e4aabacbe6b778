"""Writers and the shapes they write: JSON, CSV, PAGE XML, COCO, recogniser lists."""

from __future__ import annotations

import os
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions.geometry import area, bbox, points_text
from codexmill.functions.text import ocr_lines
from codexmill.operators.runs import running_number
from codexmill.sources.annotations import CATEGORY_NAMES, category


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """CSV with a header; `single` is for reports of bounded size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_documents(df: DataFrame, name: str, text: str, folder: str, skip_existing: bool = True) -> None:
    """One file per row (name, text) under folder, each through a temporary name; done by the executors on a shared folder."""

    def run(rows):
        for r in rows:
            path = os.path.join(folder, r[name])
            if skip_existing and os.path.exists(path):
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            spare = f"{path}.{os.getpid()}.tmp"
            with open(spare, "w", encoding="utf-8") as f:
                f.write(r[text])
            os.replace(spare, path)

    df.select(name, text).foreachPartition(run)


def line_dataset(lines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """The nine columns of the line dataset, one row a consensus line; image is the page's file where known."""
    j = lines.join(images.select("page_id", F.col("image_path").alias("image")), "page_id", "left") if images is not None else lines.withColumn("image", F.lit(None).cast("string"))
    return j.select(F.col("line_id").alias("id"), "book_id", "page_id", "image", "polygon", "baseline", "text_raw", "text_normalised", "confidence_label")


def page_text_rows(pages: DataFrame, page: str, text: str) -> DataFrame:
    """(page, line, text): lines of a page's text from 1, tabs as spaces."""
    return pages.select(F.col(page).alias("page"), F.posexplode(ocr_lines(F.col(text))).alias("at", "t")).select("page", (F.col("at") + 1).alias("line"), F.translate("t", "\t", " ").alias("text"))


def pretty_json(value: Column) -> Column:
    """A struct as JSON text, indented, null fields kept."""
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


_PAGE_NS = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"


def _page_xml(page_id, image, width, height, lines, whole: bool) -> str:
    def points(poly):
        num = (lambda v: str(int(round(v)))) if whole else (lambda v: str(round(float(v), 2)))
        return " ".join(f"{num(p[0])},{num(p[1])}" for p in poly)

    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<PcGts xmlns="{_PAGE_NS}"><Metadata><Creator>codexmill</Creator>']
    if whole:
        out.append("<Created>1970-01-01T00:00:00</Created><LastChange>1970-01-01T00:00:00</LastChange>")
    out.append("</Metadata>")
    out.append(f'<Page imageFilename={quoteattr(image or "")} imageWidth="{width or 0}" imageHeight="{height or 0}" readingDirection="right-to-left">')
    out.append(f"<TextRegion id={quoteattr(f'{page_id}_r0001')}>")
    if width and height:
        out.append(f'<Coords points="0,0 {width},0 {width},{height} 0,{height}"/>')
    for x in lines:
        custom = f"confidence_label:{x['confidence_label']};engine_consensus_count:{x['engine_consensus_count']}"
        out.append(f"<TextLine id={quoteattr(x['line_id'])} custom={quoteattr(custom)}>")
        out.append(f"<Coords points={quoteattr(points(x['polygon']))}/>")
        if x["baseline"] is not None and len(x["baseline"]):
            out.append(f"<Baseline points={quoteattr(points(x['baseline']))}/>")
        for index, field in ((1, "text_raw"), (2, "text_normalised")):
            kind = "raw" if index == 1 else "normalised"
            out.append(f'<TextEquiv index="{index}" dataType="{kind}"><Unicode>{escape(x[field] or "")}</Unicode></TextEquiv>')
        out.append("</TextLine>")
    out.append("</TextRegion></Page></PcGts>")
    return "".join(out)


def page_xml(pages: DataFrame, strict: bool = False) -> DataFrame:
    """(page_id, xml) from pages (page_id, image_filename, width, height, lines); strict writes whole points and dates."""

    @F.pandas_udf(T.StringType())
    def build(p: pd.Series, i: pd.Series, w: pd.Series, h: pd.Series, lines: pd.Series) -> pd.Series:
        ok = lambda v: None if pd.isna(v) else int(v)
        return pd.Series([_page_xml(a, b, ok(c), ok(d), e, strict) for a, b, c, d, e in zip(p, i, w, h, lines)], dtype=object)

    keep = F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ("line_id", "polygon", "baseline", "text_raw", "text_normalised", "confidence_label", "engine_consensus_count")]))
    return pages.select("page_id", build("page_id", "image_filename", "width", "height", keep).alias("xml"))


def page_xml_checks(xml: DataFrame) -> DataFrame:
    """(page_id, lines, texts, ok): structure of PAGE XML; text that isn't well-formed is not ok."""
    plain = F.regexp_replace("xml", r' xmlns="[^"]*"', "")
    opened, closed = F.size(F.regexp_extract_all("xml", F.lit("<TextLine[ >]"), F.lit(0))), F.size(F.regexp_extract_all("xml", F.lit("</TextLine>"), F.lit(0)))
    whole = F.col("xml").rlike(r"^\s*<\?xml") & F.col("xml").rlike(r"</PcGts>\s*$") & (opened == closed)
    lines = F.when(whole, F.size(F.xpath(plain, F.lit("/PcGts/Page/TextRegion/TextLine/@id")))).otherwise(0)
    texts = F.when(whole, F.size(F.xpath(plain, F.lit("//TextLine/TextEquiv/Unicode")))).otherwise(0)
    return xml.select("page_id", lines.alias("lines"), texts.alias("texts"), (whole & (texts == 2 * lines)).alias("ok"))


def import_bundle(xml: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, pages): manifest of the pages that have both an image and XML."""
    j = images.join(xml.select("page_id").distinct(), "page_id", "left_semi")
    return j.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "image_path"))).alias("pages"))


def coco_images(pages: DataFrame, name: str = "file_name") -> DataFrame:
    """(image_id, file_name, width, height) numbered by name."""
    return running_number(pages.select(F.col(name).alias("file_name"), "width", "height"), ["file_name"], "image_id")


def coco_annotations(items: DataFrame, least: float = 0.4) -> DataFrame:
    """items (file_name, image_id, source_rank, no, x, y, w, h, score, label) as annotations, numbered in that order.

    Text lines (rank 0) under the threshold and boxes without area, after rounding, are left out.
    """
    r = lambda c: F.round(F.greatest(F.col(c), F.lit(0.0)), 1)
    kept = items.filter((F.col("source_rank") > 0) | (F.col("score") >= least)).withColumn("w1", r("w")).withColumn("h1", r("h")).filter((F.col("w1") > 0) & (F.col("h1") > 0))
    cat = F.when(F.col("source_rank") == 0, 1).otherwise(category(F.col("label")))
    numbered = running_number(kept.withColumn("category_id", cat), ["file_name", "source_rank", "no"], "id")
    return numbered.select("id", "image_id", "category_id", F.array(r("x"), r("y"), "w1", "h1").alias("bbox"), F.round(F.col("w1") * F.col("h1"), 1).alias("area"), F.lit(0).alias("iscrowd"), "score")


def coco_categories(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, "text" if i == 1 else "layout") for i, n in enumerate(CATEGORY_NAMES, 1)], "id int, name string, supercategory string")


def image_json(items: DataFrame, least: float = 0.4) -> DataFrame:
    """(file_name, text_lines, layout) per image, in order; the threshold holds for text lines alone."""
    entry = F.struct("no", F.array(*[F.round(c, 1) for c in ("x", "y", "w", "h")]).alias("bbox"), F.round("score", 4).alias("score"), "label")
    text = F.when((F.col("source_rank") == 0) & (F.col("score") >= least), entry)
    return items.groupBy("file_name").agg(F.array_sort(F.collect_list(text)).alias("text_lines"), F.array_sort(F.collect_list(F.when(F.col("source_rank") > 0, entry))).alias("layout"))


def recogniser_list(pairs: DataFrame, image: str, label: str) -> DataFrame:
    """(value): image and label by a tab, of rows with both."""
    ok = pairs.filter(F.col(image).isNotNull() & (F.length(F.trim(label)) > 0))
    return ok.select(F.concat_ws("\t", image, F.trim(label)).alias("value"))


def dictionary(texts: DataFrame, text: str) -> DataFrame:
    """(char) of all distinct characters but the blank."""
    return texts.select(F.explode(F.split(text, "")).alias("char")).filter(~F.col("char").isin("", " ")).distinct()


def polygon_columns(lines: DataFrame, polygon: str = "polygon") -> DataFrame:
    """lines with the polygon's area, box and points as text."""
    return lines.withColumn("area", area(F.col(polygon))).withColumn("bbox", bbox(F.col(polygon))).withColumn("points", points_text(F.col(polygon)))


def metric_rows(counts: DataFrame, key: str) -> DataFrame:
    """counts (key, c_* and w_* alignment counts by character and word) as text columns with four places."""
    from codexmill.functions.metrics import rates

    text = lambda c: F.when(F.isnan(c), "nan").otherwise(F.format_string("%.4f", c))
    cols = [key]
    for prefix, unit, error in (("c_", "chars", "cer"), ("w_", "words", "wer")):
        e, p, r, _ = rates(prefix)
        cols += [F.col(f"{prefix}ref").alias(f"{unit}_ref"), F.col(f"{prefix}hyp").alias(f"{unit}_hyp"), text(e).alias(f"{error}_pct"), text(r).alias(f"{unit}_recall_pct"), text(p).alias(f"{unit}_precision_pct")]
    return counts.select(*cols)


def network_log(entries: DataFrame) -> DataFrame:
    """One row per viewer: the summary lists of distinct URLs by signal and all entries as JSON; entries (viewer_url, url, method, status, matched_signals)."""
    pick = lambda s: F.array_sort(F.collect_set(F.when(F.array_contains("matched_signals", s), F.col("url")))).alias(s)
    row = F.struct("url", "method", "status", "matched_signals")
    g = entries.groupBy("viewer_url").agg(*[pick(s) for s in ("manifest", "info_json", "image_request")], F.collect_list(row).alias("network"))
    return g.select("viewer_url", F.to_json(F.struct(F.struct("manifest", "info_json", "image_request").alias("summary"), "network")).alias("json"))


def crop_report(lines: DataFrame, page: str) -> DataFrame:
    """(page, value): index, box, score with four places and text of every line in order; a page's error stands in its place."""
    entry = F.format_string("%d\t%s\t%.4f\t%s", F.col("no"), F.array_join(F.transform("box", lambda v: v.cast("string")), ","), F.col("score"), F.col("text"))
    shown = F.coalesce(F.concat(F.lit("error: "), "error"), entry)
    g = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("no", shown.alias("v")))).alias("v"))
    return g.select(page, F.array_join(F.transform("v", lambda x: x["v"]), "\n").alias("value"))


def missing_files(wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """(name, status): copied or missing for every name of a fixed list."""
    there = present.select(name).distinct().withColumn("_t", F.lit(True))
    return wanted.join(there, name, "left").select(name, F.when(F.col("_t"), "copied").otherwise("missing").alias("status"))


def book_metadata(values: DataFrame) -> DataFrame:
    """(book_id, fields): values (book_id, machine_name, ord, value) as a map, the last entry of a name winning."""
    last = values.filter("machine_name is not null").groupBy("book_id", "machine_name").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("machine_name", "value")))).alias("fields"))


def line_boxes(lines: DataFrame) -> DataFrame:
    """(line_id, value): box file of a line: each base character with its marks on one row over the line's box, and a closing row."""

    @F.pandas_udf(T.StringType())
    def rows(texts: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        import unicodedata

        out = []
        for t, a, b in zip(texts, w, h):
            units: list[str] = []
            for c in t or "":
                if units and unicodedata.combining(c):
                    units[-1] += c
                else:
                    units.append(c)
            out.append("".join(f"{u} 0 0 {int(a)} {int(b)} 0\n" for u in units) + f"\t 0 0 {int(a)} {int(b)} 0\n")
        return pd.Series(out, dtype=object)

    return lines.select("line_id", rows("text", "width", "height").alias("value"))
