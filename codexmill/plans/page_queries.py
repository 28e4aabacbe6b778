"""Queries of consensus, reports, geometry, quality, runs, splits and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexmill.functions import geometry
from codexmill.functions.ids import book_of_page
from codexmill.operators import consensus, export, matching, quality, reports, runs, splits
from codexmill.plans.registry import query
from codexmill.sources import annotations
from codexmill.sources.tables import table

_LINES = "(SELECT DISTINCT line_id, page_id, confidence_label, text_normalised, text_raw, reading_order, polygon FROM consensus_lines)"


def _lines(spark, d, *more):
    return table(spark, d, "consensus_lines", "line_id", "page_id", *more).distinct()


def _ranked(spark, d):
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines", "run_at", "output_id").select("page_id", "book_id", "engine", "lines"))
    rank = table(spark, d, "engine_configs", "engine", "engine_rank")
    return e.join(F.broadcast(rank), "engine")  # one row an engine


@query(f"""
SELECT page_id, split_part(page_id, '_p', 1) AS book_id,
  CAST(10 * sum((confidence_label = 'disagreement')::INT) + 4 * sum((confidence_label = 'near_agreement')::INT) + count(*) / 4.0 AS DOUBLE) AS priority_score,
  CAST(count(*) FILTER (confidence_label = 'disagreement') AS BIGINT) AS disagreement_lines, count(*) AS total_lines, 'unknown' AS era, 'sorani-arabic' AS script, 'unknown' AS typography, '' AS assigned_to, 'todo' AS status
FROM (SELECT page_id, coalesce(confidence_label, '') AS confidence_label FROM {_LINES}) GROUP BY page_id""")
def review_queue(spark, d):
    """Pages by urgency of review."""
    return reports.review_queue(_lines(spark, d, "confidence_label").withColumn("book_id", book_of_page(F.col("page_id"))))


@query(f"""
SELECT split_part(page_id, '_p', 1) AS book_id, count(*) AS lines, count(*) FILTER (confidence_label = 'auto_accept') AS auto_accept,
  count(*) FILTER (confidence_label = 'near_agreement') AS near_agreement, count(*) FILTER (confidence_label = 'disagreement') AS disagreement FROM {_LINES} GROUP BY 1""")
def label_totals(spark, d):
    """A7, A25."""
    return reports.label_totals(_lines(spark, d, "confidence_label").withColumn("book_id", book_of_page(F.col("page_id"))), ["book_id"])


@query("""
SELECT split_part(page_id, '_p', 1) AS book_id, era_typography, count(*) AS pages FROM (SELECT DISTINCT page_id, era_typography FROM page_refs) GROUP BY 1, 2""")
def coverage_matrix(spark, d):
    """A6 with the real typography."""
    p = table(spark, d, "page_refs", "page_id", "era_typography").distinct()
    return reports.coverage_matrix(p.withColumn("book_id", book_of_page(F.col("page_id"))), "book_id", "era_typography")


@query("""
WITH v AS (SELECT DISTINCT l.line_id AS line_id, e.engine AS engine, l.text AS text FROM (SELECT engine, unnest(lines) AS l FROM engine_pages) e WHERE l IS NOT NULL AND length(l.text) > 0),
r AS (SELECT v.*, engine_rank FROM v JOIN engine_configs USING (engine)),
c AS (SELECT line_id, text, count(*) AS votes, min(engine_rank) AS first FROM r GROUP BY 1, 2)
SELECT line_id, text, votes FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY votes DESC, first, text) AS n FROM c) WHERE n = 1""")
def plurality_vote(spark, d):
    """A1 over the engines' readings."""
    v = _ranked(spark, d).filter(F.length("text") > 0).select("line_id", "engine", "engine_rank", "text").distinct()
    return consensus.plurality(v, ["line_id"], "text", "engine_rank")


@query()
def page_consensus(spark, d):
    """Engine lines aligned by overlap page by page, voted and labelled."""
    rows = _ranked(spark, d).dropDuplicates(["page_id", "engine", "line_id"])
    return consensus.consensus_of_clusters(consensus.align_lines(rows.select("page_id", "engine", "engine_rank", "line_ord", "line_id", "polygon", "baseline", "text", "confidence", "reading_order")))


@query()
def consensus_pages(spark, d):
    """Pages with their lines in order and the engines that failed."""
    lines = table(spark, d, "consensus_lines", "page_id", "line_id", "text_normalised", "confidence_label", "reading_order").distinct()
    fails = annotations.engine_failures(table(spark, d, "engine_pages", "page_id", "failures")).filter("engine is not null").distinct()
    return consensus.consensus_pages(lines, fails)


@query("""
WITH v AS (SELECT DISTINCT line_id, unnest(map_entries(engine_outputs)) AS e FROM consensus_lines),
t AS (SELECT line_id, e.key AS engine, e.value AS text FROM v)
SELECT a.engine AS engine_a, b.engine AS engine_b, count(*) AS line_pairs, CAST(round(CAST(count(*) FILTER (a.text = b.text) / count(*) AS DECIMAL(38,12)), 4) AS DOUBLE) AS exact_agreement_rate
FROM t a JOIN t b ON a.line_id = b.line_id AND a.engine < b.engine GROUP BY 1, 2""")
def engine_agreement(spark, d):
    """J3, A5 without the distance."""
    t = table(spark, d, "consensus_lines", "line_id", "engine_outputs").select("line_id", F.explode("engine_outputs").alias("engine", "text")).distinct()
    return reports.disagreement_matrix(consensus.pairs_of_engines(t, ["line_id"])).drop("mean_edit_distance")


@query()
def disagreement_matrix(spark, d):
    """Distances by code point, per book."""
    c = table(spark, d, "consensus_lines", "line_id", "page_id", "engine_outputs").select("line_id", book_of_page(F.col("page_id")).alias("book"), F.explode("engine_outputs").alias("engine", "text")).distinct()
    return reports.disagreement_matrix(consensus.pairs_of_engines(c, ["book", "line_id"]), ["book"])


@query()
def engine_benchmark(spark, d):
    """Every engine against the consensus."""
    p = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).select("engine", "line_id", "text", "text_normalised").distinct()
    return reports.benchmark(p, _lines(spark, d, "text_normalised").select("line_id", F.col("text_normalised").alias("text")))


@query("""
WITH e AS (SELECT DISTINCT metadata['budget_event'] AS j FROM engine_pages WHERE metadata['budget_event'] IS NOT NULL),
b AS (SELECT json_extract_string(j, '$.book_id') AS book_id, CAST(json_extract_string(j, '$.estimated_usd') AS DOUBLE) AS usd FROM e)
SELECT book_id, CAST(round(CAST(sum(CAST(usd AS DECIMAL(28,12))) AS DECIMAL(38,12)), 6) AS DOUBLE) AS total_usd FROM b GROUP BY ROLLUP (book_id)""")
def budget_totals(spark, d):
    """By book and, with a null book, in total."""
    return reports.budget(annotations.budget_events(table(spark, d, "engine_pages", "metadata")).distinct())


@query("""
SELECT reason, before, count(*) AS changes FROM (SELECT x.reason AS reason, x.before AS before FROM (
  SELECT unnest(normalisation_trace) AS x FROM (SELECT DISTINCT line_id, normalisation_trace FROM consensus_lines))) GROUP BY 1, 2""")
def change_report(spark, d):
    """A23."""
    t = table(spark, d, "consensus_lines", "line_id", "normalisation_trace").distinct().select(F.explode("normalisation_trace").alias("x")).select("x.*")
    return reports.change_report(t, "reason", "before")


@query("""
SELECT DISTINCT c.line_id AS id, c.page_id AS page_id, p.image AS image, c.text_raw AS text_raw, c.text_normalised AS text_normalised, c.confidence_label AS confidence_label
FROM consensus_lines c LEFT JOIN (SELECT page_id, max(image_path) AS image FROM page_refs GROUP BY 1) p USING (page_id)""")
def line_dataset(spark, d):
    """K3."""
    lines = table(spark, d, "consensus_lines", "line_id", "page_id", "book_id", "polygon", "baseline", "text_raw", "text_normalised", "confidence_label")
    images = table(spark, d, "page_refs", "page_id", "image_path").groupBy("page_id").agg(F.max("image_path").alias("image_path"))
    return export.line_dataset(lines, images).select("id", "page_id", "image", "text_raw", "text_normalised", "confidence_label").distinct()


_AREA = "abs(list_sum(list_transform(range(1, len(polygon) + 1), lambda i: polygon[i][1] * polygon[i % len(polygon) + 1][2] - polygon[i % len(polygon) + 1][1] * polygon[i][2]))) / 2"


@query(f"""
SELECT line_id, {_AREA} AS area, x, y, w, h, y + h * 0.78 AS baseline_y FROM (SELECT *, list_min(list_transform(polygon, lambda p: p[1])) AS x, list_min(list_transform(polygon, lambda p: p[2])) AS y,
  list_max(list_transform(polygon, lambda p: p[1])) - list_min(list_transform(polygon, lambda p: p[1])) AS w, list_max(list_transform(polygon, lambda p: p[2])) - list_min(list_transform(polygon, lambda p: p[2])) AS h
FROM (SELECT DISTINCT line_id, polygon FROM consensus_lines))""")
def polygon_measures(spark, d):
    """G1, G4, G6."""
    c = _lines(spark, d, "polygon")
    b = geometry.bbox(F.col("polygon"))
    return c.select("line_id", geometry.area(F.col("polygon")).alias("area"), b.alias("b"), geometry.default_baseline(F.col("polygon"))[0][1].alias("baseline_y")).select("line_id", "area", "b.*", "baseline_y")


_BOX = """(SELECT DISTINCT line_id, page_id, polygon[1][1] AS x1, polygon[1][2] AS y1, polygon[3][1] AS x2, polygon[3][2] AS y2, reading_order FROM consensus_lines)"""


def _boxes(spark, d):
    p = F.col("polygon")
    c = table(spark, d, "consensus_lines", "line_id", "page_id", "polygon", "reading_order")
    return c.select("line_id", "page_id", p[0][0].alias("x1"), p[0][1].alias("y1"), p[2][0].alias("x2"), p[2][1].alias("y2"), "reading_order").distinct()


@query(f"""
WITH b AS {_BOX}, n AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY page_id ORDER BY reading_order, line_id))
SELECT line_id, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou FROM (SELECT line_id, i, (x2 - x1) * (y2 - y1 + 40) + (a2 - a1) * (b2 - b1 + 40) - i AS u
  FROM (SELECT *, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2 + 40, b2 + 40) - greatest(y1, b1), 0) AS i FROM n WHERE a1 IS NOT NULL))""")
def neighbour_iou(spark, d):
    """Overlap of each line's padded box with the one before it."""
    w = Window.partitionBy("page_id").orderBy("reading_order", "line_id")
    b = _boxes(spark, d).withColumn("y2", F.col("y2") + 40)
    for c, n in (("x1", "a1"), ("y1", "b1"), ("x2", "a2"), ("y2", "b2")):
        b = b.withColumn(n, F.lag(c).over(w))
    b = b.filter("a1 is not null")
    return b.select("line_id", geometry.box_iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("a1", "b1", "a2", "b2")]).alias("iou"))


@query(f"""
WITH b AS (SELECT page_id, x1, y1, x2, y2 + 40 AS y2 FROM {_BOX}), e AS (SELECT DISTINCT page_id, unnest([x1, x2]) AS x FROM b),
s AS (SELECT page_id, x, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS nx FROM e),
i AS (SELECT s.page_id, s.x, s.nx, b.y1, b.y2 FROM s JOIN b ON s.page_id = b.page_id AND b.x1 <= s.x AND b.x2 >= s.nx),
r AS (SELECT *, max(y2) OVER (PARTITION BY page_id, x ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT page_id, sum((nx - x) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))) AS area FROM r GROUP BY 1""")
def covered_area(spark, d):
    """Area of a page's padded line boxes, overlaps once."""
    return matching.covered_area(_boxes(spark, d).withColumn("y2", F.col("y2") + 40), "page_id")


@query("""
SELECT page_id, CAST(ceil(width / 256.0) * ceil(height / 256.0) AS BIGINT) AS tiles, width * height / 1e6 AS megapixels FROM (SELECT DISTINCT page_id, width, height FROM page_refs) WHERE width IS NOT NULL AND height IS NOT NULL""")
def tile_grid(spark, d):
    """G15, G18."""
    p = table(spark, d, "page_refs", "page_id", "width", "height").filter("width is not null and height is not null").distinct()
    tiles = geometry.tiles(F.col("width"), F.col("height"), F.lit(256))
    return p.select("page_id", F.size(tiles).cast("long").alias("tiles"), geometry.megapixels(F.col("width"), F.col("height")).alias("megapixels"))


@query(f"""
SELECT line_id, greatest(0, CAST(round_even(x1, 0) AS INT) - 4) AS x1, greatest(0, CAST(round_even(y1, 0) AS INT) - 4) AS y1, least(1200, CAST(round_even(x2, 0) AS INT) + 4) AS x2, least(1700, CAST(round_even(y2, 0) AS INT) + 4) AS y2 FROM {_BOX}""")
def crop_boxes(spark, d):
    """G12."""
    b = geometry.crop_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 4, F.lit(1200), F.lit(1700))
    return _boxes(spark, d).select("line_id", b.alias("b")).select("line_id", "b.*")


@query(f"""
SELECT line_id, greatest(0, least(x1, 900)) AS x1, greatest(0, least(y1, 700)) AS y1, least(x2, 900) AS x2, least(y2, 700) AS y2 FROM {_BOX} WHERE least(x2, 900) > least(x1, 900) AND least(y2, 700) > least(y1, 700)""")
def clamped_boxes(spark, d):
    """Boxes cut to an image; those outside vanish."""
    b = geometry.clamp_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(900.0), F.lit(700.0))
    return _boxes(spark, d).select("line_id", b.alias("b")).filter("b is not null").select("line_id", "b.*")


@query()
def polygon_overlaps(spark, d):
    """Overlap of each engine's polygon with the consensus line's."""
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).select("engine", "line_id", F.col("polygon").alias("p")).distinct()
    return e.join(_lines(spark, d, "polygon"), "line_id").select("engine", "line_id", geometry.polygon_iou_udf("p", "polygon").alias("iou"))


@query()
def matched_boxes(spark, d):
    """Engine boxes against consensus boxes, one to one, by confidence."""
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).filter("polygon is not null")
    p = F.col("polygon")
    corners = lambda q: [q[0][0].alias("x1"), q[0][1].alias("y1"), q[2][0].alias("x2"), q[2][1].alias("y2")]
    pred = e.select("page_id", "engine", F.concat_ws("/", "engine", "line_id").alias("id"), *corners(p), F.coalesce("confidence", F.lit(0.0)).alias("score")).dropDuplicates(["id"])
    engines = pred.select("page_id", "engine").distinct()
    truth = _boxes(spark, d).select("page_id", F.col("line_id").alias("id"), "x1", "y1", "x2", "y2").join(engines, "page_id")
    truth = truth.toDF(*truth.columns)
    return matching.match_boxes(pred, truth, ["page_id", "engine"], 0.5)


@query()
def visual_order(spark, d):
    """Lines of a page in rows, right to left."""
    return matching.order_rows(_boxes(spark, d).withColumnRenamed("line_id", "id"), "page_id")


@query(f"""
SELECT line_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round_even(y1 / 20, 0), x1 DESC, line_id) AS BIGINT) AS place FROM {_BOX}""")
def row_buckets(spark, d):
    """W8."""
    w = Window.partitionBy("page_id").orderBy(F.rint(F.col("y1") / 20), F.desc("x1"), "line_id")
    return _boxes(spark, d).select("line_id", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH r AS (SELECT line_id, reviewer_id, max(confidence_label) AS label FROM line_reviews GROUP BY 1, 2), c AS (SELECT DISTINCT line_id, confidence_label FROM consensus_lines),
j AS (SELECT r.label AS p, c.confidence_label AS t FROM r JOIN c USING (line_id) WHERE r.label IS NOT NULL AND c.confidence_label IS NOT NULL),
k AS (SELECT p AS label, (p = t)::INT AS tp, (p <> t)::INT AS fp, 0 AS fn FROM j UNION ALL SELECT t, 0, 0, (p <> t)::INT FROM j),
s AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM k GROUP BY ROLLUP (label)),
q AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM s)
SELECT label, tp, fp, fn, CAST(round(CAST(p AS DECIMAL(38,12)), 4) AS DOUBLE) AS precision, CAST(round(CAST(r AS DECIMAL(38,12)), 4) AS DOUBLE) AS recall,
  CAST(round(CAST(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS DECIMAL(38,12)), 4) AS DOUBLE) AS f1 FROM q""")
def label_precision(spark, d):
    """reviewers' labels against the pipeline's, by class and overall."""
    r = table(spark, d, "line_reviews", "line_id", "reviewer_id", "confidence_label").groupBy("line_id", "reviewer_id").agg(F.max("confidence_label").alias("p"))
    j = r.join(_lines(spark, d, "confidence_label").select("line_id", F.col("confidence_label").alias("t")), "line_id").filter("p is not null and t is not null").select("p", "t")
    z = F.lit(0)
    k = j.select(F.col("p").alias("label"), (F.col("p") == F.col("t")).cast("int").alias("tp"), (F.col("p") != F.col("t")).cast("int").alias("fp"), z.alias("fn")).unionByName(
        j.select(F.col("t").alias("label"), z.alias("tp"), z.alias("fp"), (F.col("p") != F.col("t")).cast("int").alias("fn"))
    )
    return matching.precision_recall(k, "label")


_DETECT = f"""
WITH i AS (SELECT DISTINCT page_id, l.line_id AS line_id, engine, l.confidence AS confidence, (l.polygon[3][1] - l.polygon[1][1]) * (l.polygon[3][2] - l.polygon[1][2]) AS a FROM (SELECT page_id, engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL),
g AS (SELECT page_id, count(*) AS boxes, count(*) FILTER (confidence >= 0.4) AS lines, coalesce(CAST(avg(CAST(confidence AS DECIMAL(28,12))) FILTER (confidence >= 0.4) AS DOUBLE), 0) AS av,
  coalesce(max(confidence) FILTER (confidence >= 0.4), 0) AS mx, max(a) * 100.0 / 2000000.0 AS cov, count(DISTINCT engine) AS labels FROM i GROUP BY 1),
m AS (SELECT page_id, boxes, lines, CAST(round(CAST(av AS DECIMAL(38,12)), 4) AS DOUBLE) AS avg_confidence, CAST(round(CAST(mx AS DECIMAL(38,12)), 4) AS DOUBLE) AS max_confidence, CAST(round(CAST(cov AS DECIMAL(38,12)), 2) AS DOUBLE) AS coverage_pct,
  labels, CASE WHEN av >= 0.7 AND lines >= 3 AND cov >= 5 THEN 'GOOD' WHEN av >= 0.5 AND lines >= 1 THEN 'MEDIUM' ELSE 'POOR' END AS flag FROM g)"""


def _detect(spark, d):
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines"))
    p = F.col("polygon")
    items = e.select("page_id", "line_id", "engine", "confidence", ((p[2][0] - p[0][0]) * (p[2][1] - p[0][1])).alias("a")).distinct().withColumn("size", F.lit(2000000.0))
    return quality.detection_metrics(items, "page_id", "confidence", "a", "size", "engine")


@query(_DETECT + " SELECT * FROM m")
def detection_metrics(spark, d):
    """A14, A15."""
    return _detect(spark, d)


@query(_DETECT + """
SELECT count(*) AS total, count(*) FILTER (flag = 'GOOD') AS good, count(*) FILTER (flag = 'MEDIUM') AS medium, count(*) FILTER (flag = 'POOR') AS poor,
  CAST(round(CAST(count(*) FILTER (flag = 'GOOD') / greatest(count(*), 1) AS DECIMAL(38,12)), 4) AS DOUBLE) AS good_rate,
  CAST(round(CAST(count(*) FILTER (flag <> 'POOR') / greatest(count(*), 1) AS DECIMAL(38,12)), 4) AS DOUBLE) AS usable_rate,
  CAST(round(CAST(CAST(avg(CAST(avg_confidence AS DECIMAL(28,12))) AS DOUBLE) AS DECIMAL(38,12)), 4) AS DOUBLE) AS avg_confidence, CAST(round(CAST(CAST(avg(CAST(coverage_pct AS DECIMAL(28,12))) AS DOUBLE) AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_coverage_pct,
  CAST(sum(lines) AS BIGINT) AS total_lines, CASE WHEN count(*) FILTER (flag = 'GOOD') / greatest(count(*), 1) >= 0.7 THEN 'PROCEED' WHEN count(*) FILTER (flag <> 'POOR') / greatest(count(*), 1) >= 0.5 THEN 'PREPROCESS' ELSE 'SWITCH' END AS decision FROM m""")
def dataset_gate(spark, d):
    """A16."""
    return quality.dataset_gate(_detect(spark, d))


_PAGES = """(SELECT split_part(page_id, '_p', 1) AS book_id, CAST(regexp_extract(page_id, '([0-9]+)$', 1) AS BIGINT) AS page_no, max(width) AS width, max(height) AS height FROM page_refs GROUP BY page_id)"""


def _numbered(spark, d):
    p = table(spark, d, "page_refs", "page_id", "width", "height").groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return p.select(book_of_page(F.col("page_id")).alias("book_id"), F.regexp_extract("page_id", "([0-9]+)$", 1).cast("long").alias("page_no"), "width", "height")


@query(f"""
WITH p AS {_PAGES}, e AS (SELECT book_id, max(page_no) AS n FROM p GROUP BY 1)
SELECT book_id, x AS page_no FROM (SELECT book_id, unnest(range(1, n + 1)) AS x FROM e) EXCEPT SELECT book_id, page_no FROM p""")
def missing_pages(spark, d):
    """J7, T1."""
    p = _numbered(spark, d)
    return quality.missing_numbers(p, "book_id", "page_no", p.groupBy("book_id").agg(F.max("page_no").alias("n")), "n")


@query(f"""
WITH p AS {_PAGES}, e AS (SELECT book_id, max(page_no) AS expected_pages FROM p GROUP BY 1),
m AS (SELECT book_id, string_agg(CAST(x AS VARCHAR), ';' ORDER BY x) AS missing FROM (SELECT book_id, x FROM (SELECT book_id, unnest(range(1, expected_pages + 1)) AS x FROM e) EXCEPT SELECT book_id, page_no FROM p) GROUP BY 1),
g AS (SELECT book_id, count(*) AS found, count(*) FILTER (width IS NULL OR height IS NULL) AS corrupt,
  arg_min(CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR), width * height * 100000 + width) AS min_resolution, arg_max(CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR), width * height * 100000 + width) AS max_resolution,
  avg(CAST(width * height / 1e6 AS DECIMAL(28,12))) AS mp FROM p GROUP BY 1)
SELECT e.book_id, expected_pages, found, corrupt, coalesce(missing, '') AS missing_pages, min_resolution, max_resolution, CAST(round(coalesce(CAST(mp AS DECIMAL(38,12)), 0), 2) AS DOUBLE) AS avg_megapixels,
  CASE WHEN found = 0 THEN 'failed' WHEN missing IS NOT NULL OR corrupt > 0 THEN 'partial' ELSE 'complete' END AS status FROM e JOIN g USING (book_id) LEFT JOIN m USING (book_id)""")
def book_validation(spark, d):
    """A19-A22, O4, K17."""
    p = _numbered(spark, d)
    return quality.validate_books(p, p.groupBy("book_id").agg(F.max("page_no").alias("expected_pages")))


@query(f"""
WITH p AS {_PAGES}, e AS (SELECT book_id, max(width) AS w, max(height) AS h FROM p GROUP BY 1)
SELECT p.book_id, page_no, width, height, w AS want_width, h AS want_height FROM p JOIN e USING (book_id) WHERE width <> w OR height <> h""")
def dimension_mismatches(spark, d):
    """Pages smaller than their book's largest."""
    p = _numbered(spark, d)
    return quality.dimension_mismatches(p, p.groupBy("book_id").agg(F.max("width").alias("width"), F.max("height").alias("height")), ["book_id"])


_RUNS = """(SELECT output_id, engine, page_id, coalesce(len(failures), 0) > 0 AS failed, list_contains(list_transform(coalesce(failures, []), lambda f: f.recoverable), false) AS fatal, failures[1].message AS message
  FROM (SELECT output_id, any_value(engine) AS engine, any_value(page_id) AS page_id, any_value(failures) AS failures FROM engine_pages GROUP BY output_id))"""


def _runs(spark, d):
    e = table(spark, d, "engine_pages", "output_id", "engine", "page_id", "failures").dropDuplicates(["output_id"])
    f = F.coalesce("failures", F.array().cast(e.schema["failures"].dataType))
    return e.select("output_id", "engine", "page_id", (F.size(f) > 0).alias("failed"), F.coalesce(F.exists(f, lambda x: F.coalesce(~x["recoverable"], F.lit(False))), F.lit(False)).alias("fatal"), F.get(f, F.lit(0))["message"].alias("message"))


@query(f"""
WITH r AS {_RUNS}, b AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY engine ORDER BY page_id, output_id) AS blk FROM r),
s AS (SELECT *, CAST(sum(failed::INT) OVER (PARTITION BY engine, blk ORDER BY page_id, output_id) AS BIGINT) AS streak FROM b)
SELECT output_id, streak, coalesce(bool_or(streak >= 3) OVER (PARTITION BY engine ORDER BY page_id, output_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cut FROM s""")
def failure_guard(spark, d):
    """W2 over each engine's pages in order."""
    return runs.failure_guard(_runs(spark, d), ["engine"], ["page_id", "output_id"], "failed", 3).select("output_id", "streak", "cut")


@query(f"""
WITH r AS {_RUNS} SELECT output_id, coalesce(bool_or(fatal) OVER w, false) AS skipped, first_value(CASE WHEN fatal THEN message END IGNORE NULLS) OVER w AS cause FROM r
WINDOW w AS (PARTITION BY engine ORDER BY page_id, output_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def sticky_skip(spark, d):
    """W3."""
    return runs.sticky_skip(_runs(spark, d), ["engine"], ["page_id", "output_id"], "fatal", "message").select("output_id", "skipped", "cause")


@query("""
SELECT p.page_id AS page_id, e.engine AS engine FROM (SELECT DISTINCT page_id FROM page_refs) p, (SELECT engine FROM engine_configs WHERE enabled) e
WHERE (p.page_id, e.engine) NOT IN (SELECT page_id, engine FROM engine_pages WHERE page_id IS NOT NULL AND engine IS NOT NULL)""")
def resume(spark, d):
    """Pages and enabled engines still to run."""
    pages = table(spark, d, "page_refs", "page_id").distinct()
    engines = table(spark, d, "engine_configs", "engine", "enabled").filter("enabled").select("engine")
    return runs.to_do(pages.crossJoin(F.broadcast(engines)), table(spark, d, "engine_pages", "page_id", "engine"), ["page_id", "engine"])


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_progress(spark, d):
    """The latest event of each key."""
    return runs.latest(table(spark, d, "events", "user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
SELECT page_id, max(CAST(ingested_at AS VARCHAR)) AS ingested, arg_max(split, ingested_at) AS split FROM page_refs GROUP BY page_id""")
def last_wins(spark, d):
    """J4's rule: of repeated rows the latest."""
    p = consensus.latest_by(table(spark, d, "page_refs", "page_id", "split", "ingested_at"), ["page_id"], ["ingested_at"])
    return p.select("page_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"), "split")


@query(f"""
SELECT line_id, coalesce(nullif(reading_order, 0), row_number() OVER (PARTITION BY page_id ORDER BY line_id)) AS ord,
  row_number() OVER (PARTITION BY page_id ORDER BY coalesce(nullif(reading_order, 0), n), line_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_id) AS n FROM {_LINES})""")
def reading_order(spark, d):
    """W1, O3."""
    return consensus.reading_order(_lines(spark, d, "reading_order"), ["page_id"], "reading_order", ["line_id"]).select("line_id", "ord", "place")


@query(f"""
SELECT line_id, CAST((row_number() OVER (PARTITION BY page_id ORDER BY line_id) - 1) // 8 AS BIGINT) AS batch FROM {_LINES}""")
def batches(spark, d):
    """W9."""
    return runs.batches(_lines(spark, d), ["line_id"], 8, ["page_id"]).select("line_id", "batch")


@query("""
SELECT source_collection AS run, arg_max(book_id, struct_pack(a := length(coalesce(title_original, '')), b := book_id)) AS best FROM (SELECT DISTINCT book_id, source_collection, title_original FROM books) GROUP BY 1""")
def best_so_far(spark, d):
    """The best of each run, the later among equals."""
    b = table(spark, d, "books", "book_id", "source_collection", "title_original").distinct().withColumn("score", F.length(F.coalesce("title_original", F.lit(""))))
    return runs.best_so_far(b, ["source_collection"], "score", "book_id").select(F.col("source_collection").alias("run"), F.col("book_id").alias("best"))


@query("""
SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY split_part(page_id, '_p', 1) ORDER BY md5('7:' || page_id), page_id) AS n FROM (SELECT DISTINCT page_id FROM page_refs)) WHERE n <= 3""")
def spot_check(spark, d):
    """S-14: three pages of every book."""
    p = table(spark, d, "page_refs", "page_id").distinct().withColumn("book", book_of_page(F.col("page_id")))
    return splits.spot_check(p, "book", "page_id", 3, 7).select("page_id")


@query("""
SELECT line_id, CASE WHEN n <= greatest(1, least(t - 1, CAST(round_even(t * 0.15, 0) AS BIGINT))) THEN 'eval' ELSE 'train' END AS split
FROM (SELECT line_id, row_number() OVER (ORDER BY md5('13:' || line_id), line_id) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT line_id FROM consensus_lines))""")
def train_eval(spark, d):
    """S-11, S-12."""
    return splits.train_eval(table(spark, d, "consensus_lines", "line_id").distinct(), "line_id", 0.15, 13)


@query("""
SELECT DISTINCT book_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT book_id, CAST('0x' || substr(md5('3:' || book_id), 1, 8) AS BIGINT) / 4294967296.0 AS h FROM books)""")
def hash_split(spark, d):
    """S-12 by place in the hash's range."""
    b = table(spark, d, "books", "book_id").distinct()
    return splits.bucket_split(b, "book_id", {"train": 0.8, "val": 0.1, "test": 0.1}, 3)


@query("""
WITH t AS (SELECT DISTINCT unnest(test_book_ids) AS b FROM pipeline_configs), v AS (SELECT DISTINCT unnest(val_book_ids) AS b FROM pipeline_configs)
SELECT DISTINCT book_id, CASE WHEN book_id IN (SELECT b FROM t WHERE b IS NOT NULL) THEN 'test' WHEN book_id IN (SELECT b FROM v WHERE b IS NOT NULL) THEN 'val' ELSE 'train' END AS split FROM books""")
def listed_split(spark, d):
    """S-13: by the lists as they are written."""
    c = table(spark, d, "pipeline_configs", "test_book_ids", "val_book_ids")
    b = table(spark, d, "books", "book_id").distinct()
    return splits.listed_split(b, "book_id", c.select(F.explode("test_book_ids").alias("b")), c.select(F.explode("val_book_ids").alias("b")))


@query("""
SELECT x, min(config_id) AS first FROM (SELECT config_id, unnest(list_concat(coalesce(test_book_ids, []), coalesce(val_book_ids, []))) AS x FROM pipeline_configs) GROUP BY x""")
def listed_ids(spark, d):
    """Distinct ids of all lists with the first configuration that names them."""
    c = table(spark, d, "pipeline_configs", "config_id", "test_book_ids", "val_book_ids")
    both = c.select("config_id", F.explode("test_book_ids").alias("x")).unionByName(c.select("config_id", F.explode("val_book_ids").alias("x")))
    return both.groupBy("x").agg(F.min("config_id").alias("first"))


@query("""
WITH i AS (SELECT page_id, line_id, reading_order, polygon[1][1] AS x, polygon[1][2] AS y, polygon[3][1] - polygon[1][1] AS w, polygon[3][2] - polygon[1][2] AS h, engine_consensus_count / 5.0 AS score FROM
  (SELECT DISTINCT page_id, line_id, reading_order, polygon, engine_consensus_count FROM consensus_lines))
SELECT row_number() OVER (ORDER BY page_id, reading_order, line_id) AS id, 1 AS category_id, w * h AS area, score FROM i WHERE score >= 0.4 AND w > 0 AND h > 0""")
def coco_annotations(spark, d):
    """Lines as annotations with running numbers."""
    c = table(spark, d, "consensus_lines", "page_id", "line_id", "reading_order", "polygon", "engine_consensus_count").distinct()
    p = F.col("polygon")
    items = c.select(
        F.col("page_id").alias("file_name"), F.lit(0).alias("image_id"), F.lit(0).alias("source_rank"), F.struct("reading_order", "line_id").alias("no"),
        p[0][0].alias("x"), p[0][1].alias("y"), (p[2][0] - p[0][0]).alias("w"), (p[2][1] - p[0][1]).alias("h"), (F.col("engine_consensus_count") / 5).alias("score"), F.lit("").alias("label"),
    )
    return export.coco_annotations(items).select("id", "category_id", "area", "score")


@query()
def page_xml(spark, d):
    """PAGE XML of every page, and its structure checked."""
    lines = table(spark, d, "consensus_lines", "page_id", "line_id", "reading_order", "polygon", "baseline", "text_raw", "text_normalised", "confidence_label", "engine_consensus_count").dropDuplicates(["line_id"])
    size = table(spark, d, "page_refs", "page_id", "image_path", "width", "height").groupBy("page_id").agg(F.max("image_path").alias("image_filename"), F.max("width").alias("width"), F.max("height").alias("height"))
    return export.page_xml_checks(export.page_xml(consensus.consensus_pages(lines).join(size, "page_id", "left")))


@query("""
SELECT CAST(round(CAST(avg(height) / 11.69 AS DECIMAL(38,12)), 4) AS DOUBLE) AS dpi FROM (SELECT height FROM (SELECT page_id, max(height) AS height FROM page_refs GROUP BY 1) WHERE height IS NOT NULL ORDER BY page_id LIMIT 10)""")
def dpi_estimate(spark, d):
    """From the first ten pages that can be read."""
    p = table(spark, d, "page_refs", "page_id", "height").groupBy("page_id").agg(F.max("height").alias("height")).filter("height is not null")
    return p.orderBy("page_id").limit(10).agg(F.round((F.avg("height") / 11.69).cast("decimal(38,12)"), 4).cast("double").alias("dpi"))


@query("""
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    """Batch twin of the streaming count (not a feature of the reference)."""
    from codexmill.streaming.windows import daily_counts

    return daily_counts(table(spark, d, "events", "ts", "event_type", "value"))


@query(f"""
SELECT coalesce(nullif(a.page_id, ''), '') AS page_id, count(*) AS lines FROM {_LINES} a WHERE a.page_id IN (SELECT page_id FROM engine_pages WHERE len(lines) > 0) GROUP BY 1""")
def pages_with_output(spark, d):
    """Lines of the pages that an engine has read."""
    read = table(spark, d, "engine_pages", "page_id", "lines").filter(F.size("lines") > 0).select("page_id").distinct()
    return _lines(spark, d).join(read, "page_id", "left_semi").groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"))


@query("""
SELECT book_id, list_aggregate(list_sort(list_distinct(list(page_id))), 'count') AS pages FROM (SELECT split_part(page_id, '_p', 1) AS book_id, page_id FROM page_refs WHERE page_id IN (SELECT page_id FROM consensus_lines)) GROUP BY 1""")
def import_bundle(spark, d):
    """The manifest of pages with an image and an export."""
    images = table(spark, d, "page_refs", "page_id", "image_path").groupBy("page_id").agg(F.max("image_path").alias("image_path")).withColumn("book_id", book_of_page(F.col("page_id")))
    return export.import_bundle(table(spark, d, "consensus_lines", "page_id"), images).select("book_id", F.size("pages").cast("long").alias("pages"))
