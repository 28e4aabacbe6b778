"""Queries that put the library's operators on the tables as they are, each beside SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import geometry, ids, text
from codexmill.functions.ids import book_of_page
from codexmill.functions.metrics import fixed
from codexmill.operators import consensus, engines, export, matching, quality, reports, runs
from codexmill.plans.page_queries import _boxes, _lines, _ranked
from codexmill.plans.registry import query
from codexmill.sources import annotations
from codexmill.sources.tables import table

_ENGINE_LINES = """(SELECT DISTINCT page_id, engine, l.line_id AS line_id, l.polygon AS polygon, l.text AS text, l.confidence AS confidence, l.reading_order AS reading_order
  FROM (SELECT page_id, engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL)"""
_VOTE = """(SELECT page_id, line_id, text, votes FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY votes DESC, first, text) AS n
  FROM (SELECT page_id, line_id, text, count(*) AS votes, min(engine_rank) AS first FROM m WHERE length(text) > 0 GROUP BY ALL)) WHERE n = 1)"""


def _aligned(spark, d):
    # of an engine's readings of one line that with the smallest text
    rest = ["engine_rank", "line_ord", "polygon", "baseline", "text", "confidence", "reading_order"]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce("text", F.lit("")), "line_ord"))
    rows = _ranked(spark, d).groupBy("page_id", "engine", "line_id").agg(best.alias("b")).select("page_id", "engine", "line_id", "b.*")
    return consensus.align_lines(rows.select("page_id", "engine", "engine_rank", "line_ord", "line_id", "polygon", "baseline", "text", "confidence", "reading_order"))


@query(f"""
SELECT DISTINCT page_id, engine, line_id, line_id AS met FROM {_ENGINE_LINES} JOIN (SELECT engine FROM engine_configs) USING (engine)""")
def aligned_lines(spark, d):
    """The line each engine's line was aligned with, named by its cluster's first member; lines that meet share a line_id in these tables, which SQL relies on."""
    a = _aligned(spark, d)
    first = a.groupBy("page_id", "cluster").agg(F.min_by("line_id", F.struct("engine_rank", "engine", "line_ord")).alias("met"))
    return a.join(first, ["page_id", "cluster"]).select("page_id", "engine", "line_id", "met").distinct()


@query(f"""
WITH m AS (SELECT page_id, engine, engine_rank, line_id, min(coalesce(text, '')) AS text FROM {_ENGINE_LINES} e JOIN engine_configs USING (engine) GROUP BY ALL), v AS {_VOTE},
k AS (SELECT page_id, line_id, count(*) AS engines FROM m GROUP BY 1, 2)
SELECT k.page_id AS page_id, k.line_id AS line_id, coalesce(v.text, '') AS text_raw, engines FROM k LEFT JOIN v ON k.page_id = v.page_id AND k.line_id = v.line_id""")
def aligned_votes(spark, d):
    """The raw text that wins in each cluster and its engines."""
    c = consensus.consensus_of_clusters(_aligned(spark, d))
    return c.select("page_id", "line_id", "text_raw", F.size("engine_outputs").cast("long").alias("engines"))


@query("""
WITH l AS (SELECT DISTINCT page_id, line_id, reading_order FROM consensus_lines),
f AS (SELECT DISTINCT page_id, x.engine AS engine FROM (SELECT page_id, unnest(failures) AS x FROM engine_pages) WHERE x.engine IS NOT NULL),
n AS (SELECT page_id, CAST(count(*) AS BIGINT) AS failed FROM f GROUP BY 1)
SELECT l.page_id, l.line_id, row_number() OVER (PARTITION BY l.page_id ORDER BY reading_order, l.line_id) AS place, coalesce(failed, 0) AS failed FROM l LEFT JOIN n USING (page_id)""")
def page_lines_in_order(spark, d):
    """A page's lines in order and how many engines failed on it, out of the assembled pages."""
    lines = table(spark, d, "consensus_lines", "page_id", "line_id", "reading_order").distinct()
    fails = annotations.engine_failures(table(spark, d, "engine_pages", "page_id", "failures")).filter("engine is not null").distinct()
    p = consensus.consensus_pages(lines, fails).select("page_id", F.coalesce(F.size("failed_engines"), F.lit(0)).cast("long").alias("failed"), F.posexplode("lines").alias("at", "l"))
    return p.select("page_id", F.col("l.line_id").alias("line_id"), (F.col("at") + 1).cast("long").alias("place"), F.greatest("failed", F.lit(0).cast("long")).alias("failed"))


@query("""
WITH e AS (SELECT DISTINCT engine, l.line_id AS line_id, l.polygon AS p FROM (SELECT engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL),
c AS (SELECT DISTINCT line_id, polygon AS q FROM consensus_lines),
j AS (SELECT engine, line_id, p, q, greatest(least(p[3][1], q[3][1]) - greatest(p[1][1], q[1][1]), 0) * greatest(least(p[3][2], q[3][2]) - greatest(p[1][2], q[1][2]), 0) AS i,
  (p[3][1] - p[1][1]) * (p[3][2] - p[1][2]) AS a, (q[3][1] - q[1][1]) * (q[3][2] - q[1][2]) AS b FROM e JOIN c USING (line_id))
SELECT engine, line_id, round(CASE WHEN p IS NULL OR q IS NULL OR a <= 0 OR b <= 0 THEN 0 ELSE i / (a + b - i) END, 9) AS iou FROM j""")
def rectangle_overlaps(spark, d):
    """G2, G3, J2's measure: overlap of each engine's polygon with the consensus line's by clipping; the polygons of these tables are upright, which SQL relies on."""
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).select("engine", "line_id", F.col("polygon").alias("p")).distinct()
    return e.join(_lines(spark, d, "polygon"), "line_id").select("engine", "line_id", F.round(geometry.polygon_iou_udf("p", "polygon"), 9).alias("iou"))


@query("""
WITH RECURSIVE b AS (SELECT DISTINCT line_id, page_id, polygon[1][1] AS x1, polygon[1][2] AS y1, polygon[3][1] AS x2, polygon[3][2] AS y2 FROM consensus_lines),
h AS (SELECT page_id, 0.6 * median(y2 - y1) AS reach FROM b GROUP BY 1),
o AS (SELECT b.*, reach, (y1 + y2) / 2 AS c, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, line_id) AS n FROM b JOIN h USING (page_id)),
r AS (SELECT page_id, line_id, n, c AS centre, 1 AS k, 1 AS row_no, x2 FROM o WHERE n = 1
  UNION ALL SELECT o.page_id, o.line_id, o.n, CASE WHEN abs(o.c - r.centre) <= reach THEN r.centre + (o.c - r.centre) / (r.k + 1) ELSE o.c END,
    CASE WHEN abs(o.c - r.centre) <= reach THEN r.k + 1 ELSE 1 END, CASE WHEN abs(o.c - r.centre) <= reach THEN r.row_no ELSE r.row_no + 1 END, o.x2 FROM r JOIN o ON o.page_id = r.page_id AND o.n = r.n + 1)
SELECT page_id, line_id AS id, CAST(row_no AS INTEGER) AS row_no, CAST(row_number() OVER (PARTITION BY page_id, row_no ORDER BY x2 DESC, line_id) AS INTEGER) AS place_no FROM r""")
def visual_rows(spark, d):
    """Lines of a page in rows, right to left."""
    return matching.order_rows(_boxes(spark, d).withColumnRenamed("line_id", "id"), "page_id")


@query("""
WITH RECURSIVE e AS (SELECT page_id, engine, engine || '/' || line_id AS id, any_value(polygon) AS p, any_value(confidence) AS score FROM
  (SELECT page_id, engine, l.line_id AS line_id, l.polygon AS polygon, coalesce(l.confidence, 0) AS confidence FROM (SELECT page_id, engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL AND l.polygon IS NOT NULL) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, engine ORDER BY score DESC, id) AS n FROM e),
t AS (SELECT DISTINCT page_id, line_id, polygon AS q FROM consensus_lines),
i AS (SELECT o.page_id, o.engine, o.n, t.line_id, greatest(least(p[3][1], q[3][1]) - greatest(p[1][1], q[1][1]), 0) * greatest(least(p[3][2], q[3][2]) - greatest(p[1][2], q[1][2]), 0) AS i,
  (p[3][1] - p[1][1]) * (p[3][2] - p[1][2]) + (q[3][1] - q[1][1]) * (q[3][2] - q[1][2]) AS s FROM o JOIN t ON o.page_id = t.page_id),
v AS (SELECT page_id, engine, n, list(struct_pack(v := i / (s - i), id := line_id) ORDER BY i / (s - i) DESC, line_id) AS best FROM i WHERE i > 0 GROUP BY ALL),
g AS (SELECT o.page_id, o.engine, o.n, o.id, coalesce(best, []) AS best FROM o LEFT JOIN v ON o.page_id = v.page_id AND o.engine = v.engine AND o.n = v.n),
r AS (SELECT page_id, engine, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS truth, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT page_id, engine FROM o)
  UNION ALL SELECT page_id, engine, n, id, truth, CASE WHEN truth IS NULL THEN used ELSE list_append(used, truth) END FROM (SELECT g.page_id, g.engine, g.n, g.id, r.used,
    list_filter(list_filter(g.best, lambda x: NOT list_contains(r.used, x.id))[1:1], lambda x: x.v >= 0.5)[1].id AS truth FROM r JOIN g ON g.page_id = r.page_id AND g.engine = r.engine AND g.n = r.n + 1))
SELECT page_id, engine, id AS pred_id, truth AS truth_id FROM r WHERE n > 0""")
def one_to_one_boxes(spark, d):
    """Engine boxes against consensus boxes, one to one, by confidence."""
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).filter("polygon is not null")
    p = F.col("polygon")
    best = e.select("page_id", "engine", F.concat_ws("/", "engine", "line_id").alias("id"), p[0][0].alias("x1"), p[0][1].alias("y1"), p[2][0].alias("x2"), p[2][1].alias("y2"), F.coalesce("confidence", F.lit(0.0)).alias("score"))
    pred = best.dropDuplicates(["page_id", "engine", "id"])
    truth = _boxes(spark, d).select("page_id", F.col("line_id").alias("id"), "x1", "y1", "x2", "y2").join(pred.select("page_id", "engine").distinct(), "page_id")
    return matching.match_boxes(pred, truth.toDF(*truth.columns), ["page_id", "engine"], 0.5).drop("overlap")


@query("""
SELECT page_id, CAST(count(DISTINCT line_id) AS BIGINT) AS lines, true AS ok FROM consensus_lines GROUP BY 1""")
def page_xml_lines(spark, d):
    """Lines found in the PAGE XML of every page, and that it holds together."""
    lines = table(spark, d, "consensus_lines", "page_id", "line_id", "reading_order", "polygon", "baseline", "text_raw", "text_normalised", "confidence_label", "engine_consensus_count").dropDuplicates(["line_id"])
    size = table(spark, d, "page_refs", "page_id", "image_path", "width", "height").groupBy("page_id").agg(F.max("image_path").alias("image_filename"), F.max("width").alias("width"), F.max("height").alias("height"))
    return export.page_xml_checks(export.page_xml(consensus.consensus_pages(lines).join(size, "page_id", "left"))).select("page_id", F.col("lines").cast("long").alias("lines"), "ok")


@query("""
WITH w AS (SELECT page_id, line_id, polygon, unnest(string_split(text_normalised, ' ')) AS word, generate_subscripts(string_split(text_normalised, ' '), 1) AS n, engine_consensus_count AS k
  FROM (SELECT DISTINCT page_id, line_id, polygon, text_normalised, engine_consensus_count FROM consensus_lines)),
c AS (SELECT *, CASE WHEN (k + n) % 7 = 0 THEN -1 ELSE least(k * 20 + n, 100) END AS conf FROM w), g AS (SELECT * FROM c WHERE trim(word) <> '' AND conf >= 0)
SELECT page_id, line_id, string_agg(word, ' ' ORDER BY n) AS text, CAST(min(polygon[1][1] + 10 * n) AS DOUBLE) AS x1, CAST(max(polygon[1][1] + 10 * n + 8) AS DOUBLE) AS x2,
  CAST(round(CAST(avg(CAST(conf / 100.0 AS DECIMAL(28,12))) AS DECIMAL(38,12)), 4) AS DOUBLE) AS confidence FROM g GROUP BY 1, 2""")
def words_joined(spark, d):
    """The words of every consensus line, with boxes and confidences of their own, dropped without confidence and joined to lines again."""
    c = table(spark, d, "consensus_lines", "page_id", "line_id", "polygon", "text_normalised", "engine_consensus_count").distinct()
    w = c.select("page_id", F.col("line_id").alias("line"), "polygon", F.col("engine_consensus_count").alias("k"), F.posexplode(F.split("text_normalised", " ")).alias("at", "text")).withColumn("word", F.col("at") + 1)
    words = w.select(
        "page_id", F.lit(1).alias("block"), F.lit(1).alias("par"), "line", "word", "text", F.when((F.col("k") + F.col("word")) % 7 == 0, -1).otherwise(F.least(F.col("k") * 20 + F.col("word"), F.lit(100))).cast("string").alias("conf"),
        (F.col("polygon")[0][0] + 10 * F.col("word")).alias("left"), F.col("polygon")[0][1].alias("top"), F.lit(8).alias("width"), F.lit(20).alias("height"),
    )
    return engines.lines_of_words(words, ["page_id"]).select("page_id", F.col("line").alias("line_id"), "text", F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"), "confidence")


@query("""
WITH s AS (SELECT output_id, any_value(engine) AS engine, CASE WHEN coalesce(len(any_value(failures)), 0) > 0 THEN 'failed' WHEN coalesce(len(any_value(lines)), 0) = 0 THEN 'partial' ELSE 'complete' END AS status FROM engine_pages GROUP BY 1)
SELECT engine, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 ELSE 0 END AS exit_code FROM s GROUP BY 1""")
def status_totals(spark, d):
    """Outputs by status and the exit code, per engine."""
    e = table(spark, d, "engine_pages", "output_id", "engine", "lines", "failures").dropDuplicates(["output_id"])
    status = F.when(F.size(F.coalesce("failures", F.array().cast(e.schema["failures"].dataType))) > 0, "failed").when(F.size(F.coalesce("lines", F.array().cast(e.schema["lines"].dataType))) == 0, "partial").otherwise("complete")
    return runs.status_totals(e.select("engine", status.alias("status")), "status", ["engine"])


@query("""
SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1""")
def source_sizes(spark, d):
    """Number and total size of the documents of each source."""
    return quality.size_total(table(spark, d, "documents", "source", "text").withColumn("bytes", F.octet_length("text")), "bytes", ["source"])


@query("""
WITH p AS (SELECT split_part(page_id, '_p', 1) AS book_id, count(DISTINCT page_id) AS found FROM page_refs GROUP BY 1), b AS (SELECT DISTINCT book_id FROM books)
SELECT b.book_id, coalesce(found, 0) AS found, CASE WHEN coalesce(found, 0) = 0 THEN 'failed' WHEN found < 3 THEN 'partial' ELSE 'complete' END AS status FROM b LEFT JOIN p USING (book_id)""")
def book_status(spark, d):
    """Books of the catalogue by what was found of three expected pages."""
    p = table(spark, d, "page_refs", "page_id").distinct().groupBy(book_of_page(F.col("page_id")).alias("book_id")).agg(F.count(F.lit(1)).alias("found"))
    b = table(spark, d, "books", "book_id").distinct().join(p, "book_id", "left").withColumns({"found": F.coalesce("found", F.lit(0).cast("long")), "expected": F.lit(3), "reasons": F.array(F.lit(""))})
    return runs.run_status(b, "expected", "found", "reasons").select("book_id", "found", "status")


@query("""
WITH p AS (SELECT split_part(page_id, '_p', 1) AS book_id, CAST(regexp_extract(page_id, '([0-9]+)$', 1) AS BIGINT) AS page_no, max(width) AS width, max(height) AS height FROM page_refs GROUP BY page_id),
e AS (SELECT DISTINCT book_id, 5 AS expected_pages FROM books), g AS (SELECT book_id, count(*) AS found, count(*) FILTER (width IS NULL OR height IS NULL) AS corrupt FROM p GROUP BY 1),
m AS (SELECT book_id, string_agg(CAST(x AS VARCHAR), ';' ORDER BY x) AS missing FROM (SELECT book_id, unnest(range(1, 6)) AS x FROM e EXCEPT SELECT book_id, page_no FROM p) GROUP BY 1)
SELECT e.book_id, coalesce(found, 0) AS found, coalesce(corrupt, 0) AS corrupt, coalesce(missing, '') AS missing_pages,
  CASE WHEN coalesce(found, 0) = 0 THEN 'failed' WHEN missing IS NOT NULL OR corrupt > 0 THEN 'partial' ELSE 'complete' END AS status FROM e LEFT JOIN g USING (book_id) LEFT JOIN m USING (book_id)""")
def catalogue_validation(spark, d):
    """Every book of the catalogue against five expected pages, books without a page included."""
    p = table(spark, d, "page_refs", "page_id", "width", "height").groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    pages = p.select(book_of_page(F.col("page_id")).alias("book_id"), F.regexp_extract("page_id", "([0-9]+)$", 1).cast("long").alias("page_no"), "width", "height")
    return quality.validate_books(pages, table(spark, d, "books", "book_id").distinct().withColumn("expected_pages", F.lit(5))).select("book_id", F.col("found").cast("long"), F.col("corrupt").cast("long"), "missing_pages", "status")


_ACCEPTED = """b AS (SELECT page_id, line_id, engine, confidence, polygon[1][1] AS x1, polygon[1][2] AS y1, polygon[3][1] AS x2, polygon[3][2] AS y2 FROM
  (SELECT DISTINCT page_id, engine, l.line_id AS line_id, l.confidence AS confidence, l.polygon AS polygon FROM (SELECT page_id, engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL)),
a AS (SELECT page_id, x1, y1, x2, y2 FROM b WHERE confidence >= 0.4), e AS (SELECT DISTINCT page_id, unnest([x1, x2]) AS x FROM a WHERE x2 > x1 AND y2 > y1),
s AS (SELECT page_id, x, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS nx FROM e), i AS (SELECT s.page_id, s.x, s.nx, a.y1, a.y2 FROM s JOIN a ON s.page_id = a.page_id AND a.x1 <= s.x AND a.x2 >= s.nx),
r AS (SELECT *, max(y2) OVER (PARTITION BY page_id, x ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
c AS (SELECT page_id, sum((nx - x) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))) AS area FROM r GROUP BY 1),
z AS (SELECT page_id, max(width) * max(height) AS size FROM page_refs GROUP BY 1)"""


def _accepted(spark, d):
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines"))
    p = F.col("polygon")
    return e.select("page_id", "line_id", "engine", "confidence", p[0][0].alias("x1"), p[0][1].alias("y1"), p[2][0].alias("x2"), p[2][1].alias("y2")).distinct()


@query(f"""
WITH {_ACCEPTED}, g AS (SELECT page_id, count(*) AS boxes, count(*) FILTER (confidence >= 0.4) AS lines, coalesce(CAST(avg(CAST(confidence AS DECIMAL(28,12))) FILTER (confidence >= 0.4) AS DOUBLE), 0) AS av FROM b GROUP BY 1),
m AS (SELECT g.*, coalesce(area * 100.0 / CASE WHEN size > 0 THEN size END, 0) AS cov FROM g LEFT JOIN c USING (page_id) LEFT JOIN z USING (page_id))
SELECT page_id, boxes, lines, CAST(round(CAST(cov AS DECIMAL(38,12)), 2) AS DOUBLE) AS coverage_pct, CASE WHEN av >= 0.7 AND lines >= 3 AND cov >= 5 THEN 'GOOD' WHEN av >= 0.5 AND lines >= 1 THEN 'MEDIUM' ELSE 'POOR' END AS flag FROM m""")
def page_quality(spark, d):
    """Coverage by the accepted boxes, overlaps counted once, of the page's own size."""
    b = _accepted(spark, d)
    area = matching.covered_area(b.filter(F.col("confidence") >= quality.CONFIDENT), "page_id")
    size = table(spark, d, "page_refs", "page_id", "width", "height").groupBy("page_id").agg((F.max("width") * F.max("height")).alias("size"))
    items = b.join(area, "page_id", "left").join(size, "page_id", "left")
    return quality.detection_metrics(items, "page_id", "confidence", "area", "size", "engine").select("page_id", "boxes", "lines", "coverage_pct", "flag")


@query("""
SELECT page_id, engine AS label, count(*) AS n FROM (SELECT DISTINCT page_id, engine, l.line_id AS line_id FROM (SELECT page_id, engine, unnest(lines) AS l FROM engine_pages) WHERE l IS NOT NULL) GROUP BY 1, 2""")
def label_histogram(spark, d):
    """Boxes by label and page, out of the map that the image's metrics hold."""
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).select("page_id", "engine", "line_id").distinct()
    return quality.layout_histogram(e, "page_id", "engine").select("page_id", F.explode("labels").alias("label", "n"))


@query("""
WITH v AS (SELECT CAST(l_quantity AS DOUBLE) - l_linenumber * 5.0 AS d FROM lineitem)
SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd, round(avg(d) / stddev_samp(d) * sqrt(count(*)), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS cohen_d FROM v""")
def paired_statistics(spark, d):
    """All of the paired test."""
    v = table(spark, d, "lineitem", "l_quantity", "l_linenumber").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_linenumber") * 5.0).alias("b"))
    return reports.paired_test(v, "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("mean_difference", "sd", "t", "cohen_d")])


@query("""
SELECT page_id, engine, CASE WHEN l.line_id IS NOT NULL AND l.line_id <> '' THEN l.line_id ELSE page_id || '_l' || lpad(CAST(i AS VARCHAR), 4, '0') END AS line_id, coalesce(l.text, '') AS text, l.confidence AS confidence,
  CASE WHEN coalesce(l.reading_order, 0) = 0 THEN i ELSE l.reading_order END AS reading_order, i AS place FROM
  (SELECT page_id, engine, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM (SELECT output_id, any_value(page_id) AS page_id, any_value(engine) AS engine, any_value(lines) AS lines FROM engine_pages GROUP BY 1)) WHERE l IS NOT NULL AND len(l.polygon) > 0""")
def decoded_annotations(spark, d):
    """Engine pages written as annotation documents and decoded again, from whichever place holds lines."""
    e = table(spark, d, "engine_pages", "output_id", "page_id", "engine", "lines").dropDuplicates(["output_id"])
    doc = F.from_json(F.to_json(F.struct("lines")), annotations.ANNOTATION)
    docs = e.select(F.struct("page_id", "engine").alias("key"), doc.alias("d")).select("key", "d.*")
    out = annotations.decode_lines(docs.withColumn("page_id", F.col("key.page_id")), "key")
    return out.select(
        F.col("page_id.page_id").alias("page_id"), F.col("page_id.engine").alias("engine"), "line_id", "text", "confidence", "reading_order", "place"
    )


@query("""
SELECT engine, 'seed' AS option, CAST(engine_rank AS VARCHAR) AS value FROM engine_configs UNION ALL SELECT engine, 'num_ctx', '4096' FROM engine_configs""")
def request_options(spark, d):
    """P10: the options of a request that may be carried."""
    e = table(spark, d, "engine_configs", "engine", "engine_rank")
    m = F.create_map(F.lit("seed"), F.col("engine_rank").cast("string"), F.lit("psm"), F.lit("6"), F.lit("num_ctx"), F.lit("4096"), F.lit("secret"), F.lit("x"))
    return e.select("engine", F.explode(engines.generation_options(m)).alias("option", "value"))


@query("""
WITH b AS (SELECT DISTINCT line_id, polygon FROM consensus_lines)
SELECT line_id, round(greatest(polygon[1][1], 0), 1) AS x, round(greatest(polygon[1][2], 0), 1) AS y, round(greatest(polygon[3][1] - polygon[1][1], 0), 1) AS w, round(greatest(polygon[3][2] - polygon[1][2], 0), 1) AS h,
  list_min(list_transform(polygon, lambda p: p[1])) AS x1, list_max(list_transform(polygon, lambda p: p[2])) AS y2, polygon[2][1] AS corner_x, polygon[4][2] AS corner_y FROM b""")
def box_forms(spark, d):
    """A line's box as rectangle, in the detector's form and as corners."""
    b = _boxes(spark, d).drop("reading_order").distinct().join(_lines(spark, d, "polygon").select("line_id", "polygon"), "line_id")
    rect = geometry.rectangle(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    around = annotations.corners(F.col("polygon"))
    coco = geometry.corners_to_coco(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return b.select("line_id", coco.alias("c"), around.alias("a"), rect.alias("r")).select("line_id", "c.*", F.col("a.x1").alias("x1"), F.col("a.y2").alias("y2"), F.col("r")[1][0].alias("corner_x"), F.col("r")[3][1].alias("corner_y"))


@query("""
SELECT DISTINCT line_id, array_to_string(list_transform(polygon, lambda p: CAST(p[1] AS VARCHAR) || ',' || CAST(p[2] AS VARCHAR)), ' ') AS points FROM consensus_lines""")
def polygon_points(spark, d):
    """X14."""
    return export.polygon_columns(_lines(spark, d, "polygon")).select("line_id", "points").distinct()


@query("""
WITH b AS (SELECT DISTINCT book_id, title_original, authors, language FROM books)
SELECT book_id, 'title' AS name, title_original AS value FROM b WHERE title_original IS NOT NULL UNION ALL SELECT book_id, 'language', coalesce(language, authors) FROM b WHERE coalesce(language, authors) IS NOT NULL""")
def pivoted_metadata(spark, d):
    """Fields by machine name, the last entry of a name winning, nulls left out."""
    b = table(spark, d, "books", "book_id", "title_original", "authors", "language").distinct()
    rows = F.array(*[F.struct(F.lit(n).alias("machine_name"), F.lit(i).alias("ord"), F.col(c).alias("value")) for i, (n, c) in enumerate((("title", "title_original"), ("language", "authors"), ("language", "language")))])
    v = b.select("book_id", F.explode(rows).alias("r")).select("book_id", "r.*").filter("value is not null")
    return export.book_metadata(v).select("book_id", F.explode("fields").alias("name", "value"))


@query("""
SELECT DISTINCT config_id, b AS value FROM (SELECT config_id, unnest(list_concat(coalesce(test_book_ids, []), coalesce(val_book_ids, []))) AS b FROM pipeline_configs) WHERE b IS NOT NULL""")
def flat_lists(spark, d):
    """A configuration's lists of ids, one level down."""
    c = table(spark, d, "pipeline_configs", "config_id", "test_book_ids", "val_book_ids")
    return c.select("config_id", F.explode(annotations.flat_categories(F.array("test_book_ids", "val_book_ids"))).alias("value"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 7 ELSE 2 END AS category FROM nation""")
def label_categories(spark, d):
    """Category numbers of layout labels, by name, by lower-case name, else as text."""
    labels = F.array(*[F.lit(x) for x in ("Text", "section-header", "Table", "Page-header", "list item", "Stamp")])
    n = table(spark, d, "nation", "n_nationkey").withColumn("label", F.get(labels, (F.col("n_nationkey") % 6).cast("int")))
    return n.select("n_nationkey", annotations.category(F.col("label")).alias("category"))



@query("""
SELECT DISTINCT image_path, regexp_replace(image_path, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM page_refs WHERE image_path IS NOT NULL""")
def safe_names(spark, d):
    """X26."""
    p = table(spark, d, "page_refs", "image_path").filter("image_path is not null").distinct()
    return p.select("image_path", ids.safe_name(F.col("image_path")).alias("name"))


@query("""
SELECT line_id, round(CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) ELSE 1 END, 6) AS confidence FROM (SELECT line_id, list_filter(map_values(engine_confidences), lambda x: x IS NOT NULL) AS v FROM (SELECT DISTINCT line_id, engine_confidences FROM consensus_lines))""")
def mean_confidences(spark, d):
    """Mean confidence of a line's readings, 1 where there is none."""
    c = table(spark, d, "consensus_lines", "line_id", "engine_confidences").dropDuplicates(["line_id"])
    return c.select("line_id", F.round(engines.glyph_confidence(F.map_values("engine_confidences")), 6).alias("confidence"))


@query("""
WITH c AS (SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, line_id) AS place FROM (SELECT DISTINCT page_id, line_id, reading_order FROM consensus_lines)),
e AS (SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id ORDER BY line_id) AS place FROM (SELECT DISTINCT page_id, l.line_id AS line_id FROM (SELECT page_id, unnest(lines) AS l FROM engine_pages WHERE engine = 'kraken') WHERE l IS NOT NULL))
SELECT c.page_id AS page_id, c.place AS place, c.line_id AS left_id, e.line_id AS right_id FROM c JOIN e ON c.page_id = e.page_id AND c.place = e.place""")
def zipped_lines(spark, d):
    """Consensus lines and one engine's lines by their places on the page."""
    c = consensus.reading_order(_lines(spark, d, "reading_order"), ["page_id"], "reading_order", ["line_id"]).select("page_id", "place", F.col("line_id").alias("left_id"))
    e = annotations.engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines").filter("engine = 'kraken'")).select("page_id", "line_id").distinct().withColumn("reading_order", F.lit(0))
    e = consensus.reading_order(e, ["page_id"], "reading_order", ["line_id"]).select("page_id", "place", F.col("line_id").alias("right_id"))
    return annotations.zip_by_place(c, e, "page_id", "place")


@query("""
SELECT output_id, array_to_string(list_filter(list_transform(lines, lambda l: l.text), lambda t: t IS NOT NULL AND t <> ''), ' ') AS text, len(lines) > 0 AS some FROM
  (SELECT output_id, list_filter(any_value(lines), lambda l: l IS NOT NULL) AS lines FROM engine_pages WHERE lines IS NOT NULL GROUP BY 1)""")
def result_texts(spark, d):
    """An output's texts in one."""
    e = table(spark, d, "engine_pages", "output_id", "lines").filter("lines is not null").dropDuplicates(["output_id"]).withColumn("lines", F.filter("lines", lambda x: x.isNotNull()))
    both = annotations.text_and_score(F.transform("lines", lambda x: x["text"]), F.transform("lines", lambda x: x["confidence"]))
    return e.select("output_id", both["text"].alias("text"), (F.size("lines") > 0).alias("some"))


@query("""
SELECT output_id, string_agg(t, chr(10) ORDER BY i) AS text FROM (SELECT output_id, l.text AS t, i FROM (SELECT output_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM
  (SELECT output_id, any_value(lines) AS lines FROM engine_pages GROUP BY 1)) WHERE l IS NOT NULL AND trim(l.text) <> '') GROUP BY 1""")
def zone_texts(spark, d):
    """The texts of an output's zones, one a line."""
    e = table(spark, d, "engine_pages", "output_id", "lines").dropDuplicates(["output_id"])
    return e.select("output_id", text.join_zones(F.col("lines")).alias("text")).filter("text <> ''")


@query("""
SELECT image_path || chr(9) || trim(text, ' ') AS value FROM (SELECT p.image AS image_path, c.text_normalised AS text FROM (SELECT DISTINCT line_id, page_id, text_normalised FROM consensus_lines) c
  JOIN (SELECT page_id, max(image_path) AS image FROM page_refs GROUP BY 1) p USING (page_id)) WHERE image_path IS NOT NULL AND trim(text, ' ') <> ''""")
def recogniser_rows(spark, d):
    """Image and label of every line with both."""
    images = table(spark, d, "page_refs", "page_id", "image_path").groupBy("page_id").agg(F.max("image_path").alias("image_path"))
    return export.recogniser_list(_lines(spark, d, "text_normalised").join(images, "page_id"), "image_path", "text_normalised")


@query("""
SELECT '# OCR summary 2026-01-01' || chr(10) || chr(10) || '- Pages with consensus: ' || count(DISTINCT page_id) || chr(10) || '- Lines: ' || count(*) || chr(10) || '- Auto accept: ' || count(*) FILTER (l = 'auto_accept') || chr(10)
  || '- Near agreement: ' || count(*) FILTER (l = 'near_agreement') || chr(10) || '- Disagreement: ' || count(*) FILTER (l = 'disagreement') || chr(10) AS value FROM (SELECT DISTINCT line_id, page_id, confidence_label AS l FROM consensus_lines)""")
def summary_text(spark, d):
    """K7, A25."""
    return reports.daily_summary(_lines(spark, d, "confidence_label"), "2026-01-01")


@query("""
SELECT engine, engine IN ('kraken', 'claude') AS known FROM engine_configs""")
def model_names(spark, d):
    """Names that a list of models holds, with or without a tag."""
    models = F.array(F.lit("kraken:latest"), F.lit("claude:7b"), F.lit("other"))
    return table(spark, d, "engine_configs", "engine").select("engine", text.model_matches(models, F.col("engine")).alias("known"))


@query("""
SELECT attempt, least(30.0, 1.0 * power(2, attempt - 1)) AS delay FROM (SELECT unnest(range(1, 8)) AS attempt)""")
def retry_schedule(spark, d):
    """Pauses before each further attempt."""
    return spark.range(1, 8).select(F.col("id").alias("attempt"), runs.retry_delay(F.col("id"), 1.0, 2.0, 30.0).alias("delay"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'purchase' AS bad FROM events), g AS (SELECT *, min(CASE WHEN NOT bad THEN n END) OVER (PARTITION BY user_id) AS good FROM e)
SELECT user_id, CAST(least(coalesce(min(good), 4), 4, count(*)) AS BIGINT) AS attempts, CASE WHEN coalesce(min(good), 99) <= 4 THEN 'done' WHEN count(*) >= 4 THEN 'given up' ELSE 'waiting' END AS state FROM g GROUP BY 1""")
def retry_states(spark, d):
    """The state of each key after its attempts in order, of which four are made at most."""
    e = table(spark, d, "events", "user_id", "event_type", "ts", "event_id").withColumn("ok", F.col("event_type") == "purchase")
    return runs.retry_state(e, ["user_id"], ["ts", "event_id"], "ok", 4)


@query("""
SELECT DISTINCT page_id FROM page_refs WHERE CAST(regexp_extract(page_id, '([0-9]+)$', 1) AS BIGINT) BETWEEN 2 AND 4""")
def page_range(spark, d):
    """Pages from a first to a last one."""
    p = table(spark, d, "page_refs", "page_id").distinct().withColumn("no", F.regexp_extract("page_id", "([0-9]+)$", 1).cast("long"))
    return runs.page_range(p, "no", 2, 4).select("page_id")


_NAMES = "(SELECT p_partkey, p_size, p_name, p_type, p_brand FROM part)"


def _names(spark, d):
    return table(spark, d, "part", "p_partkey", "p_size", "p_name", "p_type", "p_brand")


@query(f"""
WITH x AS (SELECT p_partkey, p_size, levenshtein(p_name, p_type) AS a, levenshtein(p_name, p_brand) AS b, levenshtein(p_type, p_brand) AS c FROM {_NAMES}),
y AS (SELECT *, greatest(a, b, c) AS far, 1 + (a <= 14)::INT + (b <= 14)::INT AS near, p_size % 3 AS votes FROM x)
SELECT p_partkey, CAST(far AS INTEGER) AS far, CASE WHEN votes >= 2 AND far <= 18 THEN 'auto_accept' WHEN votes >= 2 OR near >= 2 THEN 'near_agreement' ELSE 'disagreement' END AS label FROM y""")
def agreement_labels(spark, d):
    """A2, A3: largest distance and label of three names each, on plain ASCII, whose distances SQL can count."""
    texts = F.array("p_name", "p_type", "p_brand")
    label = consensus.agreement_label(texts, F.col("p_size") % 3, F.lit(2), F.lit(18), F.lit(14))
    return _names(spark, d).select("p_partkey", consensus.max_pairwise(texts).alias("far"), label.alias("label"))


@query(f"""
WITH t AS (SELECT p_partkey, unnest([struct_pack(engine := 'a', text := p_name), struct_pack(engine := 'b', text := p_type), struct_pack(engine := 'c', text := p_brand)], recursive := true) FROM {_NAMES})
SELECT x.engine AS engine_a, y.engine AS engine_b, count(*) AS line_pairs, CAST(round(CAST(sum(levenshtein(x.text, y.text)) / count(*) AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean_edit_distance,
  CAST(round(CAST(count(*) FILTER (x.text = y.text) / count(*) AS DECIMAL(38,12)), 4) AS DOUBLE) AS exact_agreement_rate FROM t x JOIN t y ON x.p_partkey = y.p_partkey AND x.engine < y.engine GROUP BY 1, 2""")
def distance_matrix(spark, d):
    """With the mean distance, on plain ASCII."""
    named = F.array(*[F.struct(F.lit(e).alias("engine"), F.col(c).alias("text")) for e, c in (("a", "p_name"), ("b", "p_type"), ("c", "p_brand"))])
    t = _names(spark, d).select("p_partkey", F.explode(named).alias("x")).select("p_partkey", "x.*")
    return reports.disagreement_matrix(consensus.pairs_of_engines(t, ["p_partkey"]))


@query("""
WITH r AS (SELECT p_brand AS engine, levenshtein(p_name, p_type) / length(p_type) AS cer, levenshtein(array_to_string(string_split(p_name, ' '), chr(10)), array_to_string(string_split(p_type, ' '), chr(10))) / len(string_split(p_type, ' ')) AS wer,
  (p_name = p_type)::INT AS same FROM part)
SELECT engine, count(*) AS lines, CAST(round(CAST(avg(CAST(cer AS DECIMAL(28,12))) AS DECIMAL(38,12)), 6) AS DOUBLE) AS cer, CAST(round(CAST(avg(CAST(wer AS DECIMAL(28,12))) AS DECIMAL(38,12)), 6) AS DOUBLE) AS wer,
  CAST(round(CAST(avg(CAST(same AS DECIMAL(28,12))) AS DECIMAL(38,12)), 6) AS DOUBLE) AS line_accuracy FROM r GROUP BY 1""")
def name_benchmark(spark, d):
    """Macro means of the error rates by engine, on plain ASCII."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type")
    pred = p.select(F.col("p_brand").alias("engine"), F.col("p_partkey").alias("line_id"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("text_normalised"))
    return reports.benchmark(pred, p.select(F.col("p_partkey").alias("line_id"), F.col("p_type").alias("text")))
