"""Schemas and decoding of page annotations, engine outputs and detector predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions.geometry import default_baseline, rectangle
from codexmill.functions.ids import line_id
from codexmill.functions.text import first_text

_POINTS = "array<array<double>>"
_LINE = (
    f"struct<line_id:string,id:string,bbox:array<double>,polygon:{_POINTS},baseline:{_POINTS},text:string,text_raw:string,"
    "transcription:struct<raw:string,normalised:string>,confidence:double,score:double,reading_order:long>"
)
#: Page annotation of either form; unknown keys are dropped, missing ones are null.
ANNOTATION = (
    f"file string, width long, height long, bbox_format string, text_lines array<{_LINE}>, lines array<{_LINE}>, annotations struct<lines:array<{_LINE}>>, "
    "layout array<struct<bbox:array<double>,label:string,score:double>>, stable_ids struct<book_id:string,page_id:string>"
)
_FAILURE = "struct<engine:string,page_id:string,error_type:string,message:string,recoverable:boolean>"
#: One engine's output of one page.
ENGINE_PAGE = (
    "page_id string, book_id string, engine string, engine_version string, image_filename string, "
    f"lines array<{_LINE}>, failures array<{_FAILURE}>, metadata map<string,string>"
)
#: Detector output of one image: several names for the same thing.
_ITEM = "struct<bbox:array<double>,box:array<double>,rectangle:array<double>,confidence:double,score:double,label:string,name:string>"
DETECTIONS = f"image string, width long, height long, bboxes array<{_ITEM}>, text_lines array<{_ITEM}>, layout array<{_ITEM}>"


def line_items(source: str = "auto") -> Column:
    """The array of line items of an annotation: of one place, or the first non-empty of annotations.lines, lines and text_lines."""
    places = {"text_lines": F.col("text_lines"), "annotations": F.col("annotations.lines"), "annotations.lines": F.col("annotations.lines"), "lines": F.col("lines"), "legacy_lines": F.col("lines")}
    if source.lower() in places:
        return places[source.lower()]
    if source.lower() in ("auto", "kcac_json", "json"):
        full = lambda c: F.when(F.size(c) > 0, c)
        return F.coalesce(full(F.col("annotations.lines")), full(F.col("lines")), full(F.col("text_lines")))
    raise ValueError(f"unknown line source {source!r}")


def points_or_null(value: Column) -> Column:
    """A list of points, or null if it is empty or one isn't a pair."""
    return F.when((F.size(value) > 0) & F.forall(value, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()), value)


def decode_lines(documents: DataFrame, page: str = "page_id", source: str = "auto") -> DataFrame:
    """(page_id, line_id, polygon, baseline, text, confidence, reading_order, place) of annotation documents.

    Items without a polygon or a box of four numbers are dropped; the others keep the number they
    had. Order falls back to that number, also where it is 0.
    """
    rows = documents.select(F.col(page).alias("page_id"), F.posexplode(line_items(source)).alias("at", "i")).filter(F.col("i").isNotNull()).withColumn("no", (F.col("at") + 1).cast("long"))
    box = F.col("i.bbox")
    poly = F.coalesce(points_or_null(F.col("i.polygon")), F.when(F.size(box) == 4, rectangle(box[0], box[1], box[2], box[3])))
    rows = rows.withColumn("polygon", poly).filter(F.col("polygon").isNotNull())
    out = rows.select(
        "page_id",
        first_text(F.col("i.line_id"), F.col("i.id"), line_id(F.col("page_id"), F.col("no"))).alias("line_id"),
        "polygon",
        F.coalesce(points_or_null(F.col("i.baseline")), default_baseline(F.col("polygon"))).alias("baseline"),
        F.coalesce(first_text(F.col("i.text"), F.col("i.text_raw"), F.col("i.transcription.raw"), F.col("i.transcription.normalised")), F.lit("")).alias("text"),
        F.coalesce("i.confidence", "i.score").alias("confidence"),
        F.coalesce(F.nullif(F.col("i.reading_order"), F.lit(0).cast("long")), F.col("no")).alias("reading_order"),
        F.col("no").alias("place"),
    )
    return out


def engine_lines(pages: DataFrame) -> DataFrame:
    """(page_id, book_id, engine, line_ord, line_id, polygon, baseline, text, text_normalised, confidence, reading_order) of engine pages."""
    return pages.select("page_id", "book_id", "engine", F.posexplode("lines").alias("at", "l")).filter(F.col("l").isNotNull()).select(
        "page_id", "book_id", "engine", (F.col("at") + 1).alias("line_ord"), "l.*"
    )


def engine_failures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("failures").alias("f")).filter(F.col("f").isNotNull()).select(
        "page_id", "f.engine", "f.error_type", "f.message", "f.recoverable"
    )


def budget_events(pages: DataFrame, schema: str = "engine string, book_id string, page_id string, units long, estimated_usd double, description string") -> DataFrame:
    """The budget events written into the pages' metadata."""
    return pages.select(F.from_json(F.element_at("metadata", F.lit("budget_event")), schema).alias("e")).filter(F.col("e").isNotNull()).select("e.*")


def detection_items(predictions: DataFrame, kind: str = "bboxes") -> DataFrame:
    """(image, width, height, no, x1, y1, x2, y2, confidence, label): items under any of their names, defaults filled."""
    alias = F.coalesce(F.when(F.size(kind) > 0, F.col(kind)), F.when(F.size("text_lines") > 0, F.col("text_lines")), F.col("layout")) if kind == "bboxes" else F.col(kind)
    rows = predictions.select("image", "width", "height", F.posexplode(alias).alias("at", "i"))
    box = F.coalesce("i.bbox", "i.box", "i.rectangle", F.array(*[F.lit(0.0)] * 4))
    return rows.select(
        "image", "width", "height", (F.col("at") + 1).alias("no"), box[0].alias("x1"), box[1].alias("y1"), box[2].alias("x2"), box[3].alias("y2"),
        F.coalesce("i.confidence", "i.score", F.lit(0.0)).alias("confidence"), F.coalesce(F.nullif("i.label", F.lit("")), F.nullif("i.name", F.lit("")), F.lit("unknown")).alias("label"),
    )


# Layout labels and their category numbers.
CATEGORY = {
    "Text": 2, "Text-inline-math": 2, "Paragraph": 2, "Title": 3, "Section-header": 3, "SectionHeader": 3, "Heading": 3, "Table": 4,
    "Figure": 5, "Picture": 5, "Image": 5, "Caption": 6, "Footnote": 6, "List-item": 7, "ListItem": 7, "List": 7,
    "Page-header": 8, "PageHeader": 8, "Page-footer": 9, "PageFooter": 9,
}
CATEGORY_NAMES = ("text_line", "paragraph", "title", "table", "figure", "caption", "list_item", "page_header", "page_footer")


def category(label: Column, exact: bool = False) -> Column:
    """Category number of a layout label: by its name, else (unless exact) by its lower-case form with underscores, else 2."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    if exact:
        return F.coalesce(table[label], F.lit(2))
    norm = lambda s: F.regexp_replace(F.lower(s), "[- ]", "_")
    low = F.create_map(*[F.lit(x) for k, v in ({k.lower().replace("-", "_"): v for k, v in CATEGORY.items()} | {n: i for i, n in enumerate(CATEGORY_NAMES, 1)}).items() for x in (k, v)])
    return F.coalesce(table[label], low[norm(label)], F.lit(2))


def captured_network(log: DataFrame) -> DataFrame:
    """Entries of a captured network log (viewer_url, network array<struct>), one row each."""
    return log.select("viewer_url", F.explode("network").alias("n")).select("viewer_url", "n.*")


def manifest_canvases(manifests: DataFrame) -> DataFrame:
    """(id, no, canvas) of presentation manifests of either version: canvases of the first sequence, else items."""
    both = F.coalesce(F.col("sequences")[0]["canvases"], F.col("items"))
    return manifests.select("id", F.posexplode(both).alias("at", "canvas")).select("id", (F.col("at") + 1).alias("no"), "canvas")


def page_specs(books: DataFrame) -> DataFrame:
    """(book_id, page_no, width, height, levels, tile_width, tile_height, uri) of saved page lists; a missing field is an error."""
    rows = books.select("book_id", F.posexplode("pages").alias("at", "p"))
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"page without {c}"))).otherwise(F.col(c))
    return rows.select(
        "book_id", (F.col("at") + 1).alias("page_no"), need("p.attributes.width").alias("width"), need("p.attributes.height").alias("height"), need("p.attributes.levels").alias("levels"),
        need("p.attributes.tile.width").alias("tile_width"), need("p.attributes.tile.height").alias("tile_height"), need("p.tilemap.uri").alias("uri"),
    )


def training_boxes(documents: DataFrame, text_least: float = 0.4, layout_least: float = 0.4) -> DataFrame:
    """(file, no, category, x1, y1, x2, y2): accepted text lines as category 1 and layout items by label, as corners inside the image; boxes without area vanish."""
    from codexmill.functions.geometry import clamp_box

    text = documents.select("file", "width", "height", F.posexplode("text_lines").alias("no", "i")).filter(F.coalesce("i.confidence", "i.score") >= text_least)
    text = text.select("file", "width", "height", "no", F.lit(1).alias("category"), F.col("i.bbox").alias("b"))
    layout = documents.select("file", "width", "height", F.posexplode("layout").alias("no", "i")).filter(F.col("i.score") >= layout_least)
    layout = layout.select("file", "width", "height", "no", category(F.col("i.label")).alias("category"), F.col("i.bbox").alias("b"))
    both = text.unionByName(layout).filter(F.size("b") == 4)
    b = F.col("b")
    box = clamp_box(b[0], b[1], b[0] + b[2], b[1] + b[3], F.col("width").cast("double"), F.col("height").cast("double"))
    return both.withColumn("box", box).filter("box is not null").select("file", (F.col("no") + 1).alias("no"), "category", "box.*")


def zip_by_place(left: DataFrame, right: DataFrame, key: str, place: str, strict: bool = False) -> DataFrame:
    """Rows of equal place per key; the longer side is cut, or with strict a difference in length is an error."""
    how = "full" if strict else "inner"
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), [key, place], how)
    if strict:
        j = j.filter(F.when(F.col("_l") & F.col("_r"), True).otherwise(F.raise_error(F.lit("sides of different length"))))
    return j.drop("_l", "_r")


def image_of(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(file, path): for each annotation's file the image of that very name, else of its stem with the first known suffix that exists."""
    from codexmill.sources.files import IMAGE_SUFFIXES

    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    names = F.array(F.col("file"), *[F.concat(stem, F.lit(s)) for s in IMAGE_SUFFIXES[:6]])
    wanted = documents.select("file", F.posexplode(names).alias("rank", "name"))
    return wanted.join(files.select("name", "path"), "name").groupBy("file").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def first_value(values: Column) -> Column:
    """The first of a list, null for none."""
    return F.get(values, F.lit(0))


def flat_categories(values: Column) -> Column:
    """A list of lists, one level down, without nulls and repeats, in first order."""
    return F.array_distinct(F.filter(F.flatten(F.filter(values, lambda v: v.isNotNull())), lambda v: v.isNotNull()))


def text_and_score(texts: Column, scores: Column) -> Column:
    """struct<text, score>: a result's texts joined by a space and its mean score with four places, 0.0000 without scores."""
    ok = F.filter(scores, lambda v: v.isNotNull())
    mean = F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, v: s + v) / F.size(ok)).otherwise(0.0)
    return F.struct(F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " ").alias("text"), F.format_string("%.4f", mean).alias("score"))


def corners(polygon: Column) -> Column:
    """struct<x1, y1, x2, y2> around a polygon."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
