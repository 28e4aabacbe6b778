"""Queries on nested records (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators import nested
from codexmill.sources.tables import table


def _occurrences(spark, d):
    return nested.shred(table(spark, d, "raw_records", "record_id", "payload"), "record_id", "payload")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.page_children(_occurrences(spark, d))


_PAGE = ("output_id", "page_id", "book_id", "engine", "engine_version", "image_filename", "lines", "failures", "metadata", "run_at", "ingested_at")


def _page_occurrences(spark, d):
    pages = table(spark, d, "engine_pages", *_PAGE)
    return pages, nested.shred_pages(pages)


def _all_occurrences(spark, d):
    """Of both sources; key is the record_id or output_id."""
    raw = _occurrences(spark, d).withColumnRenamed("record_id", "key").withColumn("source", F.lit("raw_records"))
    pages = _page_occurrences(spark, d)[1].withColumnRenamed("output_id", "key").withColumn("source", F.lit("engine_pages"))
    return raw.unionByName(pages)


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_all_occurrences(spark, d))


def p3_bridge(spark: SparkSession, d: str) -> DataFrame:
    """record_id for occurrences in raw_records, output_id for those in engine_pages; the other is null."""
    b = nested.bridge(_all_occurrences(spark, d))
    of = lambda source, name: F.when(F.col("source") == source, F.col("key")).alias(name)
    return b.select(of("raw_records", "record_id"), of("engine_pages", "output_id"), *[c for c in b.columns if c not in ("key", "source")])


def p3_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of engine_pages with all fields and its object."""
    pages, occurrences = _page_occurrences(spark, d)
    return nested.page_lines(occurrences, pages.schema["lines"].dataType.elementType)


def p3_page_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every failure of engine_pages with all fields and its object."""
    pages, occurrences = _page_occurrences(spark, d)
    return nested.page_failures(occurrences, pages.schema["failures"].dataType.elementType)


def p3_engine_lines(spark: SparkSession, d: str) -> DataFrame:
    return nested.output_lines(table(spark, d, "engine_pages", "output_id", "engine", "lines")).drop("object_id").distinct()


def p3_engine_failures(spark: SparkSession, d: str) -> DataFrame:
    return nested.output_failures(table(spark, d, "engine_pages", "output_id", "failures")).drop("object_id").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_objects, p3_bridge, p3_engine_lines, p3_engine_failures, p3_page_lines, p3_page_failures)}

# the records' shapes in SQL: a list of records, a wrapper, an object written as a string, members by key, one bare member
_SQL_INNER = """CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"""
_SQL_MEMBERS = """CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[])
    WHEN 'OBJECT' THEN CASE WHEN list_bool_and(list_transform(json_extract({0}, '$.*'), lambda x: json_type(x) IN ('OBJECT', 'NULL'))) AND len(json_keys({0})) > 0
        THEN json_extract({0}, '$.*') ELSE [{0}] END END"""

SQL = {
    "p3_found": f"""
        WITH read AS (SELECT record_id, CAST(ltrim(payload, '\ufeff') AS JSON) AS j FROM raw_records WHERE json_valid(ltrim(payload, '\ufeff'))),
        whole AS (SELECT record_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS j FROM read),
        record AS (SELECT record_id, CASE WHEN json_type({_SQL_INNER.format("(j -> '$.data')")}) IN ('OBJECT', 'ARRAY') THEN {_SQL_INNER.format("(j -> '$.data')")} ELSE j END AS j
            FROM whole WHERE json_type(j) = 'OBJECT'),
        part AS (SELECT record_id, {_SQL_INNER.format("(j -> '$.outputs')")} AS o, {_SQL_INNER.format("(j -> '$.consensus')")} AS c FROM record),
        outs AS (SELECT record_id, {_SQL_MEMBERS.format("o")} AS m FROM part),
        out AS (SELECT record_id, unnest(m) AS o, generate_subscripts(m, 1) AS parent_no FROM outs),
        line AS (SELECT record_id, {_SQL_INNER.format("(c -> '$.lines')")} AS l FROM part),
        linem AS (SELECT record_id, {_SQL_MEMBERS.format("l")} AS m FROM line),
        lines AS (SELECT record_id, unnest(m) AS l, generate_subscripts(m, 1) AS parent_no FROM linem),
        kid AS (SELECT record_id, 'line' AS child, parent_no, {_SQL_INNER.format("(o -> '$.lines')")} AS k FROM out
            UNION ALL SELECT record_id, 'failure', parent_no, {_SQL_INNER.format("(o -> '$.failures')")} FROM out
            UNION ALL SELECT record_id, 'change', parent_no, {_SQL_INNER.format("(l -> '$.normalisation_trace')")} FROM lines),
        kids AS (SELECT record_id, child, parent_no, {_SQL_MEMBERS.format("k")} AS m FROM kid),
        each AS (SELECT record_id, child, parent_no, unnest(m) AS k, generate_subscripts(m, 1) AS child_no FROM kids)
        SELECT DISTINCT record_id, child, CAST(parent_no AS INTEGER) AS parent_no, CAST(child_no AS INTEGER) AS child_no FROM each WHERE json_type(k) = 'OBJECT'""",
    "p3_engine_lines": """
        SELECT DISTINCT output_id, CAST(i AS INTEGER) AS child_no, l.line_id AS line_id, engine, l.text AS text, l.confidence AS confidence,
               l.reading_order AS reading_order
        FROM (SELECT output_id, engine, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM engine_pages) WHERE l IS NOT NULL""",
    "p3_engine_failures": """
        SELECT DISTINCT output_id, CAST(i AS INTEGER) AS child_no, f.engine AS engine, f.page_id AS page_id, f.error_type AS error_type,
               f.message AS message, f.recoverable AS recoverable
        FROM (SELECT output_id, unnest(failures) AS f, generate_subscripts(failures, 1) AS i FROM engine_pages) WHERE f IS NOT NULL""",
}
