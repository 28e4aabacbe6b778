"""Queries of text, key and metric functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import ids, metrics, text
from codexmill.operators import export
from codexmill.plans.registry import query
from codexmill.sources.tables import table

_WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"


@query(rf"""
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{{200c}}\x{{200d}}]', '', 'g'), '{_WS}+', ' ', 'g')) AS t FROM documents)""")
def metric_text(spark, d):
    """The form in which errors are counted."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", text.metric_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(rf"""
SELECT DISTINCT line_id, md5(translate(regexp_replace(text_raw, '{_MARKS}', '', 'g'), 'يىك', 'ییک')) AS digest FROM consensus_lines""")
def sorani_letters(spark, d):
    """X1, X2 without the Unicode form."""
    c = table(spark, d, "consensus_lines", "line_id", "text_raw")
    return c.select("line_id", F.md5(text.map_letters(text.strip_marks(F.col("text_raw")))).alias("digest")).distinct()


@query("""
SELECT DISTINCT line_id, md5(nfc_normalize(translate(regexp_replace(text_raw, '[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]', '', 'g'), 'يىك', 'ییک'))) AS digest
FROM consensus_lines""")
def sorani_text(spark, d):
    """X1 with NFC."""
    c = table(spark, d, "consensus_lines", "line_id", "text_raw")
    return c.select("line_id", F.md5(text.normalise_sorani(F.col("text_raw"))).alias("digest")).distinct()


@query(rf"""
SELECT line_id, CAST(i - 1 AS BIGINT) AS index, c AS before,
  CASE WHEN c IN ('ي','ى') THEN 'ی' WHEN c = 'ك' THEN 'ک' ELSE '' END AS after,
  CASE c WHEN 'ي' THEN 'arabic_yeh_to_kurdish_yeh' WHEN 'ى' THEN 'alef_maksura_to_kurdish_yeh' WHEN 'ك' THEN 'arabic_kaf_to_kurdish_kaf' ELSE 'strip_tashkeel' END AS reason
FROM (SELECT line_id, unnest(string_split(text_raw, '')) AS c, generate_subscripts(string_split(text_raw, ''), 1) AS i FROM (SELECT DISTINCT line_id, text_raw FROM consensus_lines))
WHERE c IN ('ي','ى','ك') OR regexp_full_match(c, '{_MARKS}')""")
def normalise_trace(spark, d):
    """X1's trace, one row a change."""
    c = table(spark, d, "consensus_lines", "line_id", "text_raw").distinct()
    return c.select("line_id", F.explode(text.normalise_trace(F.col("text_raw"))).alias("x")).select("line_id", "x.*")


@query(r"""
SELECT doc_id AS page, CAST(i AS INTEGER) AS line, translate(x, chr(9), ' ') AS text FROM (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f\x0b]+', ' ', 'g'))), lambda x: x <> '') AS l
    FROM documents WHERE text IS NOT NULL))""")
def page_text_tsv(spark, d):
    """Lines of a text, numbered."""
    return export.page_text_rows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders""")
def publication_dates(spark, d):
    """Eight digits as an ISO date, other texts as they are."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise("")))
    return o.select("o_orderkey", text.publication_date(raw).alias("published"))


@query("""
SELECT DISTINCT page_id,
  CASE WHEN width IS NULL THEN 'manifest' WHEN width % 2 = 0 THEN 'image_request' ELSE 'info_json' END AS signal,
  CASE WHEN width IS NULL THEN NULL ELSE 'https://iiif.example.org/image/' || page_id END AS service
FROM page_refs""")
def url_signals(spark, d):
    """X22, X23 on the URLs of the pages' images."""
    p = table(spark, d, "page_refs", "page_id", "width").distinct()
    base = F.concat(F.lit("https://iiif.example.org/image/"), "page_id")
    url = F.when(F.col("width").isNull(), F.lit("https://iiif.example.org/manifest.json?x=1")).when(F.col("width") % 2 == 0, F.concat(base, F.lit("/full/max/0/default.jpg"))).otherwise(F.concat(base, F.lit("/info.json")))
    return p.withColumn("url", url).select("page_id", F.explode(text.url_signals(F.col("url"))).alias("signal"), text.service_url(F.col("url")).alias("service")).distinct()


@query("""
SELECT DISTINCT image_path,
  regexp_replace(regexp_replace(string_split(image_path, '/')[-2], '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS book_key,
  CAST(regexp_extract(image_path, '([0-9]+)[^0-9/]*$', 1) AS BIGINT) AS sequence,
  regexp_replace(regexp_replace(string_split(image_path, '/')[-2], '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') || '_p' || lpad(regexp_replace(regexp_extract(image_path, '([0-9]+)[^0-9/]*$', 1), '^0+', ''), CAST(greatest(4, length(regexp_replace(regexp_extract(image_path, '([0-9]+)[^0-9/]*$', 1), '^0+', ''))) AS INTEGER), '0') AS page_key
FROM page_refs""")
def page_keys(spark, d):
    """Keys from the folders and names of images."""
    p = table(spark, d, "page_refs", "image_path").distinct()
    parts = F.split("image_path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    rows = p.select("image_path", ids.book_id(F.element_at(parts, -2)).alias("book_key"), ids.page_sequence(stem, F.lit(0)).alias("sequence"))
    return rows.withColumn("page_key", ids.page_id(F.col("book_key"), F.col("sequence")))


@query("""
SELECT c_custkey, 'kcac_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS book_key FROM customer""")
def padded_book_keys(spark, d):
    """P1 on digits."""
    return table(spark, d, "customer", "c_custkey").select("c_custkey", ids.book_id(F.col("c_custkey").cast("string")).alias("book_key"))


@query("""
SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS edits, levenshtein(p_name, p_type) / length(p_type) AS cer,
  levenshtein(array_to_string(string_split(p_name, ' '), chr(10)), array_to_string(string_split(p_type, ' '), chr(10))) / len(string_split(p_type, ' ')) AS wer
FROM part""")
def edit_rates(spark, d):
    """X8-X10 on plain ASCII names."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    a, b = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", F.levenshtein(a, b).cast("long").alias("edits"), metrics.cer(a, b).alias("cer"), metrics.wer_legacy(a, b).alias("wer"))


@query("""
SELECT p_brand, CAST(sum(length(p_type)) AS BIGINT) AS ref, CAST(sum(length(p_name)) AS BIGINT) AS hyp, CAST(sum(levenshtein(p_name, p_type)) AS BIGINT) AS edits FROM part GROUP BY p_brand""")
def edit_totals(spark, d):
    """Field-wise sums of alignment counts; substitutions, deletions and insertions sum to the distance."""
    p = table(spark, d, "part", "p_brand", "p_name", "p_type").withColumn("c", metrics.char_counts("p_type", "p_name"))
    s = [F.sum(f"c.{x}").alias(x) for x in ("ref", "hyp", "sub", "del", "ins")]
    return p.groupBy("p_brand").agg(*s).select("p_brand", "ref", "hyp", (F.col("sub") + F.col("del") + F.col("ins")).alias("edits"))


@query()
def word_rates(spark, d):
    """Micro-averaged word rates of every engine against the consensus text."""
    from codexmill.sources.annotations import engine_lines

    lines = engine_lines(table(spark, d, "engine_pages", "page_id", "book_id", "engine", "lines")).select("engine", "line_id", "text").distinct()
    gold = table(spark, d, "consensus_lines", "line_id", "text_normalised").distinct()
    c = lines.join(gold, "line_id").withColumn("c", metrics.word_counts("text_normalised", "text"))
    s = c.groupBy("engine").agg(*[F.sum(f"c.{x}").alias(x) for x in ("ref", "hyp", "hits", "sub", "del", "ins")])
    return s.select("engine", "ref", "hyp", "hits", "sub", "del", "ins", *metrics.rates())


@query("""
SELECT DISTINCT c AS char FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c NOT IN ('', ' ')""")
def char_dictionary(spark, d):
    """All distinct characters."""
    return export.dictionary(table(spark, d, "documents", "text"), "text")


@query()
def training_documents(spark, d):
    """X5 on every document: its training text, with the characters that the consensus lines hold and plain letters allowed, and its changes; null text gives nulls."""
    docs = table(spark, d, "documents", "doc_id", "text")
    chars = table(spark, d, "consensus_lines", "text_normalised").select(F.explode(F.split("text_normalised", "")).alias("c")).distinct()
    plain = F.array(*[F.lit(chr(c)) for c in [*range(65, 91), *range(97, 123)]])
    chars = chars.agg(F.array_union(F.collect_set("c"), plain).alias("allowed"))
    t = docs.crossJoin(F.broadcast(chars)).select("doc_id", text.training_text(F.col("text"), F.col("allowed")).alias("t"))
    return t.select("doc_id", "t.text", "t.dropped", "t.replaced")


@query()
def training_lines(spark, d):
    """Training text of every line with its changes."""
    c = table(spark, d, "consensus_lines", "line_id", "text_raw").distinct()
    chars = table(spark, d, "consensus_lines", "text_normalised").select(F.explode(F.split("text_normalised", "")).alias("c")).distinct().agg(F.collect_set("c").alias("allowed"))
    return c.crossJoin(F.broadcast(chars)).select("line_id", text.training_text(F.col("text_raw"), F.col("allowed")).alias("t")).select("line_id", "t.text", F.size("t.dropped").alias("dropped"), "t.replaced")


@query()
def html_text(spark, d):
    """X16 on documents set as HTML."""
    docs = table(spark, d, "documents", "doc_id", "text")
    html = F.concat(F.lit("<html><head><style>p{}</style></head><body><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>")), F.lit("</p></body></html>"))
    return docs.select("doc_id", text.html_text(html).alias("text"))


@query("""
SELECT page_id, coalesce(max(CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR)), '') AS resolution FROM page_refs GROUP BY page_id""")
def resolutions(spark, d):
    """X28."""
    p = table(spark, d, "page_refs", "page_id", "width", "height")
    return p.groupBy("page_id").agg(F.max(text.resolution(F.col("width"), F.col("height"))).alias("resolution"))


@query("""
SELECT DISTINCT output_id, strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS run_at FROM engine_pages""")
def run_times(spark, d):
    """X21."""
    return table(spark, d, "engine_pages", "output_id", "run_at").select("output_id", text.utc_text(F.col("run_at")).alias("run_at")).distinct()


@query(rf"""
SELECT CAST(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS BIGINT) AS words, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def word_counts(spark, d):
    """Splitting at any white space."""
    docs = table(spark, d, "documents", "text").filter("text is not null")
    return docs.groupBy(F.size(text.words(F.col("text"))).cast("long").alias("words")).agg(F.count(F.lit(1)).alias("documents"))
