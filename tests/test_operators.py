import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.operators import consensus, export, matching, nested, quality, reports, runs, splits
from codexmill.streaming.guard import guarded
from codexmill.streaming.windows import daily_counts


def rect(x, y, w, h):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


def test_golden_consensus(spark):
    rows = [("p1", f"e{i}", i, 1, f"l{i}", rect(0, 0, 50, 10), None, "كي" if i == 1 else "کی", 0.9, 1) for i in range(1, 6)]
    schema = "page_id string, engine string, engine_rank long, line_ord int, line_id string, polygon array<array<double>>, baseline array<array<double>>, text string, confidence double, reading_order long"
    got = consensus.consensus_of_clusters(consensus.align_lines(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["text_normalised"], r["confidence_label"], r["engine_consensus_count"], r["max_pairwise_distance"], r["line_id"]) == ("کی", "auto_accept", 5, 0, "l1")
    assert r["text_raw"] == "کی" and len(r["engine_outputs"]) == 5


def plain_clusters(lines, threshold, iou):
    """Written from the rule alone: engine order, best member overlap, earliest cluster wins, same engine overwrites."""
    clusters, out = [], []
    for at, (engine, poly) in enumerate(lines):
        best, arg = 0.0, None
        for i, c in enumerate(clusters):
            score = max(iou(lines[j][1], poly) for j in c.values())
            if score > best:
                best, arg = score, i
        if arg is None or best < threshold:
            arg = len(clusters)
            clusters.append({})
        clusters[arg][engine] = at
        out.append(arg)
    return out, [c[e] for c in clusters for e in c]


def test_alignment_against_plain_loop():
    from codexmill.functions.geometry import polygon_iou

    rng = random.Random(5)
    for trial in range(60):
        lines = []
        for e in "abc":
            for _ in range(rng.randint(0, 5)):
                p = [tuple(q) for q in rect(rng.randint(0, 6), rng.randint(0, 3) * 4, rng.randint(3, 9), 4)]
                if rng.random() < 0.2:
                    p = p[:3]
                lines.append((e, p))
        got = consensus.cluster_lines(lines, 0.3)
        want, alive = plain_clusters(lines, 0.3, polygon_iou)
        assert [c for c, _ in got] == want
        assert sorted(i for i, (_, o) in enumerate(got) if not o) == sorted(alive)


def test_plurality_ties(spark):
    v = spark.createDataFrame(
        [("a", "x", 2), ("a", "y", 1), ("b", "", 1), ("b", None, 2), ("c", "q", None), ("c", "p", None), ("d", "m", 3), ("d", "m", 4), ("d", "n", 1)], "item string, text string, rank long"
    )
    got = {r["item"]: (r["text"], r["votes"]) for r in consensus.plurality(v, ["item"]).collect()}
    assert got == {"a": ("y", 1), "c": ("p", 1), "d": ("m", 2)}
    assert consensus.plurality(v.limit(0), ["item"]).count() == 0


def test_labels(spark):
    def label(texts, votes):
        df = spark.createDataFrame([(texts, votes)], "t array<string>, v int")
        return df.select(consensus.agreement_label(F.col("t"), F.col("v"), F.lit(3), F.lit(0), F.lit(1)).alias("x")).first()["x"]

    assert label(["ab", "ab", "ab"], 3) == "auto_accept"
    assert label(["ab", "ab", "ab", ""], 3) == "near_agreement"
    assert label(["ab", "ac", "ad"], 1) == "near_agreement"
    assert label(["ab", "xy", "zw"], 1) == "disagreement"


def test_priority_score(spark):
    rows = [("b", "p", "disagreement")] * 2 + [("b", "p", "near_agreement")] + [("b", "p", "auto_accept")] * 7
    q = reports.review_queue(spark.createDataFrame(rows, "book_id string, page_id string, confidence_label string")).first()
    assert q["priority_score"] == 26.5 and q["disagreement_lines"] == 2 and q["total_lines"] == 10


def test_budget(spark):
    e = spark.createDataFrame([("b1", 0.25), ("b1", 0.25)], "book_id string, estimated_usd double")
    assert {(r["book_id"], r["total_usd"]) for r in reports.budget(e).collect()} == {("b1", 0.5), (None, 0.5)}


def test_guard_and_skip(spark):
    flags = [True, True, False, True, True, True, True]
    rows = [("e", i, f, i == 4, f"m{i}") for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "engine string, seq long, failed boolean, fatal boolean, message string")
    g = runs.failure_guard(df, ["engine"], ["seq"], "failed", 3).orderBy("seq").collect()
    assert [r["streak"] for r in g] == [1, 2, 0, 1, 2, 3, 4]
    assert [r["cut"] for r in g] == [False] * 6 + [True]
    s = runs.sticky_skip(df, ["engine"], ["seq"], "fatal", "message").orderBy("seq").collect()
    assert [r["skipped"] for r in s] == [False] * 5 + [True] * 2 and s[-1]["cause"] == "m4"


def test_streaming_guard_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(e, i, rng.random() < 0.6, rng.random() < 0.05, f"{e}{i}") for e in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "engine string, seq long, failed boolean, fatal boolean, message string")
    for part in range(2):
        df.filter((F.col("seq") >= part * 20) & (F.col("seq") < (part + 1) * 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guarded(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["engine"], r["seq"]): tuple(r[c] for c in ("streak", "cut", "skipped", "cause")) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    b = runs.sticky_skip(runs.failure_guard(df, ["engine"], ["seq"], "failed", 3), ["engine"], ["seq"], "fatal", "message")
    assert got == {(r["engine"], r["seq"]): tuple(r[c] for c in ("streak", "cut", "skipped", "cause")) for r in b.collect()}


def test_streaming_counts_equal_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = daily_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "400 days")
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_counts(e).collect()))


def test_latest_and_progress(spark):
    e = spark.createDataFrame([("b", 1, 1, "failed"), ("b", 1, 2, "completed"), ("b", 2, 1, "suspect")], "book string, page long, seq long, status string")
    p = runs.progress(runs.latest(e, ["book", "page"], ["seq"]), "book", "page", "status").first()
    assert (p["completed"], p["failed"], p["suspect"]) == ([1], [], [2])


def test_greedy_match():
    assert matching.greedy_match([(0, 0, 2, 2), (0, 0, 2, 2)], [(0, 0, 2, 2)], 0.5) == [(0, 1.0), (-1, 0.0)]
    assert matching.greedy_match([], [], 0.5) == []


def test_visual_rows():
    boxes = [(0, 0, 10, 10), (20, 1, 30, 11), (0, 30, 10, 40)]
    assert matching.visual_rows(boxes) == [(1, 2), (1, 1), (2, 1)]
    assert matching.visual_rows([]) == []


def test_covered_area_against_mask(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(25):
        cells = set()
        for _ in range(rng.randint(1, 6)):
            x, y, w, h = rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 6), rng.randint(0, 6)
            rows.append((g, float(x), float(y), float(x + w), float(y + h)))
            cells |= {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        want[g] = float(len(cells))
    got = {r["g"]: r["area"] for r in matching.covered_area(spark.createDataFrame(rows, "g int, x1 double, y1 double, x2 double, y2 double"), "g").collect()}
    assert got == want


def test_gate_of_nothing(spark):
    m = spark.createDataFrame([], "flag string, lines long, avg_confidence double, coverage_pct double")
    r = quality.dataset_gate(m).first()
    assert r["total"] == 0 and r["decision"] == "SWITCH"


def test_missing_numbers(spark):
    found = spark.createDataFrame([("b", 1), ("b", 3), ("b", 3)], "k string, no long")
    exp = spark.createDataFrame([("b", 4), ("c", 0)], "k string, n long")
    assert sorted(r["no"] for r in quality.missing_numbers(found, "k", "no", exp, "n").collect()) == [2, 4]


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(101).select(F.concat(F.lit("s"), "id").alias("k"))
    a, b = (sorted(map(tuple, splits.train_eval(df.repartition(n), "k", 0.15, 3).collect())) for n in (1, 7))
    assert a == b and sum(s == "eval" for _, s in a) == 15
    assert splits.train_eval(df.limit(1), "k", 0.5, 1).first()["split"] == "train"


def test_page_xml(spark):
    lines = [("l1", rect(0, 0, 5, 5), [[0.0, 4.0], [5.0, 4.0]], "a<b", "ab", "auto_accept", 3)]
    df = spark.createDataFrame(
        [("p", "p.jpg", 10, 20, lines), ("q", None, None, None, [])],
        "page_id string, image_filename string, width long, height long, lines array<struct<line_id:string,polygon:array<array<double>>,baseline:array<array<double>>,text_raw:string,text_normalised:string,confidence_label:string,engine_consensus_count:long>>",
    )
    xml = export.page_xml(df)
    text = {r["page_id"]: r["xml"] for r in xml.collect()}
    assert 'TextEquiv index="1" dataType="raw"><Unicode>a&lt;b' in text["p"] and 'index="2"' in text["p"] and 'imageWidth="0"' in text["q"]
    checked = {r["page_id"]: (r["lines"], r["texts"], r["ok"]) for r in export.page_xml_checks(xml).collect()}
    assert checked == {"p": (1, 2, True), "q": (0, 0, True)}


def test_documents_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a/x.txt", "1"), ("b.txt", "2")], "n string, t string")
    export.write_documents(df, "n", "t", str(tmp_path))
    export.write_documents(df.withColumn("t", F.lit("new")), "n", "t", str(tmp_path))
    assert (tmp_path / "a" / "x.txt").read_text() == "1" and (tmp_path / "b.txt").read_text() == "2"


RECORD = {
    "outputs": [{"engine": "e", "lines": [{"text": "a"}, None, {"text": "a"}], "failures": {"message": "m"}}, {"engine": "f", "lines": {"l1": {"text": "b"}}}],
    "consensus": json.dumps({"lines": [{"line_id": "x", "normalisation_trace": [{"index": 0}, {"index": 1}]}]}),
}


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: [r], lambda r: {"data": r, "schema_version": 1}, lambda r: {"data": json.dumps(r)}])
def test_nested_children(spark, wrap):
    df = spark.createDataFrame([(1, json.dumps(wrap(RECORD)), "x"), (1, json.dumps(wrap(RECORD)), "x"), (2, "{bad", "x"), (3, None, "x"), (4, "", "x"), (5, "null", "x"), (6, "[]", "x")], "record_id long, payload string, body string")
    occ = nested.shred(df, "record_id", "payload")
    got = sorted((r["child"], r["parent_no"], r["child_no"]) for r in nested.page_children(occ).collect())
    assert got == [("change", 1, 1), ("change", 1, 2), ("failure", 1, 1), ("line", 1, 1), ("line", 1, 3), ("line", 2, 1)]
    same = nested.bridge(occ).filter("field = 'lines' and parent_no = 1 and parent_field = 'outputs'").select("object_id").distinct().count()
    assert same == 1
    # every child's parent is there, and bodies come back
    b = nested.bridge(occ)
    assert b.filter("parent_occurrence > 0").join(b.select("record_id", F.col("occurrence").alias("parent_occurrence")), ["record_id", "parent_occurrence"]).count() == b.filter("parent_occurrence > 0").count()
    assert nested.objects(occ).filter("body like '%\"a\"%'").count() == 1


def test_nested_empty(spark):
    assert nested.shred(spark.createDataFrame([], "record_id long, payload string"), "record_id", "payload").count() == 0


def test_merkle_identity():
    a = nested.shred_record({"x": 1, "kids": [{"y": 2}, {"z": 3}]})
    b = nested.shred_record({"kids": [{"y": 2}, {"z": 3}], "x": 1})
    c = nested.shred_record({"kids": [{"z": 3}, {"y": 2}], "x": 1})
    assert a[0][7] == b[0][7] != c[0][7]


SCALARS = st.none() | st.booleans() | st.integers(-2, 2) | st.sampled_from(["", "a", "@", '{"a":1}'])
NAMES = st.sampled_from(["a", "b", "@", "lines", "outputs"])
JSON = st.recursive(SCALARS, lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, max_size=3), max_leaves=8)
RECORDS = st.dictionaries(NAMES, JSON, max_size=3)


@settings(max_examples=400, deadline=None)
@given(RECORDS, RECORDS)
def test_distinct_in_distinct_out(a, b):
    one, two = (nested.shred_record(x, embedded=False)[0][7] for x in (a, b))
    assert (one == two) == (json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True))


@settings(max_examples=400, deadline=None)
@given(RECORDS)
def test_rebuild_gives_the_record(a):
    rows = nested.shred_record(a, wrappers=(), embedded=False)
    assert json.dumps(nested.rebuild(rows), sort_keys=True) == json.dumps([a], sort_keys=True)
    # one identity, one body
    assert len({r[7] for r in rows}) == len({(r[7], r[8]) for r in rows})


@pytest.mark.parametrize("pair", [({"x": ["a", {"k": 1}]}, {"x": ["b", {"k": 1}]}), ({"lines": {"p": {"a": 1}, "q": {"b": 1}}}, {"lines": [{"a": 1}, {"b": 1}]}), ({"x": {"k": 1}}, {"x": [{"k": 1}]}), ({"x": [{"k": 1}, None]}, {"x": [{"k": 1}]}), ({"x": [[{"k": 1}], [{"k": 2}]]}, {"x": [[{"k": 1}, {"k": 2}]]})])
def test_contents_that_differ_in_form(pair):
    a, b = (nested.shred_record(x) for x in pair)
    assert a[0][7] != b[0][7]


def test_depth(spark):
    depth = 10_000
    for deep in ('{"x":' * depth + "1" + "}" * depth, '{"x":[1,' * depth + '{"k":"v"}' + "]}" * depth, '{"x":' + "[" * depth + '{"y":1},2' + "]" * depth + "}"):
        rows = nested.shred_record(nested.read_payload(deep))
        assert rows and nested.canonical(nested.rebuild(rows)[0]["x"] if deep.count("[") == depth and deep.count("{") == 2 else [], None)
        df = spark.createDataFrame([(1, deep), (2, deep + "}"), (3, deep[:-1])], "record_id long, payload string")
        got = nested.shred(df, "record_id", "payload").groupBy("record_id").count().collect()
        assert [(r["record_id"], r["count"]) for r in got] == [(1, len(rows))]
    assert len(nested.shred_record(nested.read_payload('{"x":' * depth + "1" + "}" * depth))) == depth


@settings(max_examples=300, deadline=None)
@given(JSON, st.integers(0, 3))
def test_deep_reader_agrees(value, cut):
    text = json.dumps(value, indent=cut or None)
    assert nested.read_deep(text) == value
    for bad in (text + "]", text[:-1] + ",", "[" + text, text.replace(":", ",", 1), "{" + text + "}"):
        try:
            want = json.loads(bad)
        except ValueError:
            want = None
        assert nested.read_deep(bad) == want


def test_order_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.7, rng.random() < 0.8, rng.random() < 0.01, f"m{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, seq long, bad boolean, counts boolean, fatal boolean, message string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["seq"]: (r["streak"], r["cut"]) for r in runs.failure_guard(df, ["k"], ["seq"], "bad", 4, "counts").collect()}
        skip = {r["seq"]: (r["skipped"], r["cause"]) for r in runs.sticky_skip(df, ["k"], ["seq"], "fatal", "message").collect()}
        number = runs.running_number(df.select("seq", "k"), ["seq"], "no").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["no"] == r["seq"] + 1 for r in number) and len(number) == 600
    for key in ("a", "b", None):
        streak, cut, cause, fatal = 0, False, None, False
        for k, seq, bad, counts, dead, message in rows:
            if k != key:
                continue
            if counts:
                streak = streak + 1 if bad else 0
            assert got[seq] == (streak, cut) and skip[seq] == (fatal, cause)
            cut = cut or streak >= 4
            if dead and not fatal:
                fatal, cause = True, message


def test_alignment_streams_over_pages(spark):
    rng = random.Random(8)
    rows = [(f"p{p}", e, "abc".index(e) + 1, o, rect(rng.randint(0, 5), rng.randint(0, 2) * 4, 6, 4)) for p in range(40) for e in "abc" for o in range(rng.randint(0, 4))]
    df = spark.createDataFrame(rows, "page_id string, engine string, engine_rank int, line_ord int, polygon array<array<double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["page_id"], r["engine"], r["line_ord"]): (r["cluster"] - 1, r["overwritten"]) for r in consensus.align_lines(df, 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        want = consensus.cluster_lines([(r[1], [tuple(q) for q in r[4]]) for r in own], 0.3)
        assert [got[(r[0], r[1], r[3])] for r in own] == want
    assert consensus.align_lines(df.limit(0)).count() == 0


def plain_children(payload):
    """Written from the record's description alone."""
    try:
        v = json.loads(payload)
    except (TypeError, ValueError):
        return set()
    if isinstance(v, list):
        v = v[0] if v else None
    if isinstance(v, dict) and isinstance(v.get("data"), dict):
        v = v["data"]
    if not isinstance(v, dict):
        return set()
    many = lambda x: list(x.values()) if isinstance(x, dict) else x or []
    out = set()
    for i, o in enumerate(many(v.get("outputs")), 1):
        out |= {("line", i, j) for j, x in enumerate(many(o.get("lines")), 1) if x is not None}
        f = o.get("failures")
        out |= {("failure", i, j) for j, x in enumerate([f] if isinstance(f, dict) else f or [], 1) if x is not None}
    c = v.get("consensus")
    c = json.loads(c) if isinstance(c, str) else c
    for i, x in enumerate((c or {}).get("lines") or [], 1):
        out |= {("change", i, j) for j, y in enumerate(x.get("normalisation_trace") or [], 1) if y is not None}
    return out


def test_nested_children_of_the_test_data(spark):
    from codexmill.plans.nested import p3_found

    folder = "/root/testdata/sf0.01"
    got = {(r["record_id"], r["child"], r["parent_no"], r["child_no"]) for r in p3_found(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/raw_records.parquet").select("record_id", "payload").collect()
    assert got == {(r["record_id"], *c) for r in rows for c in plain_children(r["payload"])}


def test_matching_streams_over_groups(spark):
    rng = random.Random(9)
    box = lambda: [float(v) for v in (lambda x, y: (x, y, x + rng.randint(2, 6), y + rng.randint(2, 6)))(rng.randint(0, 6), rng.randint(0, 6))]
    pred = [(g, f"p{g}{i:02d}", *box(), rng.random()) for g in range(30) for i in range(rng.randint(0, 6))]
    truth = [(g, f"t{g}{i:02d}", *box()) for g in range(30) for i in range(rng.randint(0, 6))]
    p = spark.createDataFrame(pred, "g int, id string, x1 double, y1 double, x2 double, y2 double, score double")
    t = spark.createDataFrame(truth, "g int, id string, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r["pred_id"]: r["truth_id"] for r in matching.match_boxes(p, t, ["g"], 0.3).collect()}
        rows = {r["id"]: (r["row_no"], r["place_no"]) for r in matching.order_rows(p, "g").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) == len(pred)
    for g in range(30):
        a = sorted((r for r in pred if r[0] == g), key=lambda r: (-r[6], r[1]))
        b = sorted((r for r in truth if r[0] == g), key=lambda r: r[1])
        done = matching.greedy_match([r[2:6] for r in a], [r[2:6] for r in b], 0.3)
        assert [got[r[1]] for r in a] == [b[i][1] if i >= 0 else None for i, _ in done]
        a.sort(key=lambda r: r[1])
        assert [rows[r[1]] for r in a] == matching.visual_rows([r[2:6] for r in a])
    assert matching.match_boxes(p.limit(0), t, ["g"]).count() == 0


def test_engine_pages_as_objects(spark, small):
    from codexmill.plans.nested import p3_bridge, p3_objects, p3_page_failures, p3_page_lines

    pages = {r["output_id"]: r for r in spark.read.parquet(f"{small}/engine_pages.parquet").collect()}
    want = {(k, i, *map(str, x)) for k, r in pages.items() for i, x in enumerate(r["lines"] or [], 1) if x is not None}
    lines = p3_page_lines(spark, small).collect()
    assert {(r["output_id"], r["child_no"], *map(str, r[3:])) for r in lines} == want and len(lines) == len(want) and any(r["polygon"] for r in lines)
    failures = p3_page_failures(spark, small).collect()
    assert {(r["output_id"], r["child_no"], *map(str, r[3:])) for r in failures} == {(k, i, *map(str, x)) for k, r in pages.items() for i, x in enumerate(r["failures"] or [], 1) if x is not None}
    bridge = p3_bridge(spark, small).filter("output_id is not null").collect()
    for field, rows in (("lines", lines), ("failures", failures)):
        assert {(r["output_id"], r["child_no"], r["object_id"]) for r in bridge if r["field"] == field} == {(r["output_id"], r["child_no"], r["object_id"]) for r in rows}
    ids = [r["object_id"] for r in p3_objects(spark, small).collect()]
    assert len(ids) == len(set(ids)) and {r["object_id"] for r in bridge} <= set(ids)
    # one content, one identity
    assert len({r["object_id"] for r in lines}) == len({tuple(map(str, r[3:])) for r in lines})
