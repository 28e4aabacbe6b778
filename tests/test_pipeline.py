import pytest
from pyspark.sql import functions as F

from codexmill.operators import engines, export
from codexmill.plans.pipeline import run_all
from codexmill.sources.files import Settings
from codexmill.sources.tables import table


def test_run_all(spark, small):
    outputs = table(spark, small, "engine_pages", "page_id", "book_id", "engine", "lines", "failures")
    pages = table(spark, small, "page_refs", "page_id", "book_id", "image_path", "width", "height")
    ranks = table(spark, small, "engine_configs", "engine", "engine_rank", "enabled")
    out = run_all(pages, outputs, Settings(), ranks, True)
    lines = out["lines"].cache()
    n = lines.count()
    assert n and lines.select("line_id").distinct().count() == n
    assert out["line_dataset"].count() == n and out["labels"].first()["lines"] == n
    assert out["xml"].count() == out["pages"].count() == lines.select("page_id").distinct().count()
    assert export.page_xml_checks(out["xml"]).filter("not ok").count() == 0
    assert out["benchmark"].count() == 5 and out["disagreement"].count() == 10
    top = out["queue"].collect()
    assert [r["priority_score"] for r in top] == sorted((r["priority_score"] for r in top), reverse=True)
    # the recorded consensus was made by the same rules on the same lines
    old = table(spark, small, "consensus_lines", "line_id", "engine_outputs").dropDuplicates(["line_id"])
    both = lines.select("line_id", F.size("engine_outputs").alias("a")).join(old.select("line_id", F.size("engine_outputs").alias("b")), "line_id")
    assert both.count() > 0.95 * n


def test_recorded_engines_resume(spark, small):
    outputs = table(spark, small, "engine_pages", "output_id", "page_id", "engine", "failures")
    pages = table(spark, small, "page_refs", "page_id").distinct()
    got = engines.run_engines(pages, [engines.Recorded("kraken", outputs), engines.Recorded("claude", outputs)])
    assert {r["engine"] for r in got.select("engine").distinct().collect()} == {"kraken", "claude"}
    assert engines.run_engines(pages, [engines.Recorded("kraken", outputs)], done=outputs).count() == 0
    g = engines.guarded_outputs(got, 2)
    assert g.count() == got.count() and {"streak", "cut", "skipped", "cause"} <= set(g.columns)


def test_sticky_failures_do_not_count(spark):
    f = lambda r: [(r,)]
    rows = [("e", "p1", 1, [("m", False)]), ("e", "p2", 2, [("x", False)]), ("e", "p3", 3, None)]
    df = spark.createDataFrame(rows, "engine string, page_id string, output_id long, failures array<struct<message:string,recoverable:boolean>>")
    got = engines.guarded_outputs(df, 1).orderBy("output_id").collect()
    assert [(r["streak"], r["skipped"], r["cause"]) for r in got] == [(0, False, None), (0, True, "m"), (0, True, "m")]


def test_words_and_options(spark):
    w = spark.createDataFrame(
        [("p", 1, 1, 1, 2, "b", "90", 10, 0, 5, 5), ("p", 1, 1, 1, 1, "a", "80", 0, 1, 5, 5), ("p", 1, 1, 1, 3, " ", "99", 0, 0, 1, 1), ("p", 1, 1, 1, 4, "z", "-1", 0, 0, 1, 1), ("p", 1, 1, 1, 5, "y", "x", 0, 0, 1, 1)],
        "page string, block int, par int, line int, word int, text string, conf string, left int, top int, width int, height int",
    )
    r = engines.lines_of_words(w, ["page"]).first()
    assert (r["text"], r["x1"], r["y1"], r["x2"], r["y2"], r["confidence"]) == ("a b", 0, 0, 15, 6, 0.85)
    m = spark.createDataFrame([({"seed": "1", "url": "x"},)], "o map<string,string>").select(engines.generation_options(F.col("o")).alias("o")).first()["o"]
    assert m == {"seed": "1"}
    c = engines.checks(spark, ["a", "b"], {"a": True, "s": True}, ["s"])
    assert [tuple(x) for x in c.collect()] == [("s", True, "found"), ("a", True, "found"), ("b", False, "missing")] and not engines.all_ok(c).first()["ok"]
    g = spark.createDataFrame([([0.5, None, 1.0],), ([],)], "c array<double>").select(engines.glyph_confidence(F.col("c")).alias("v")).collect()
    assert [x["v"] for x in g] == [0.75, 1.0]


def test_small_exports(spark):
    v = spark.createDataFrame([("b", "title", 1, "x"), ("b", "title", 2, "y"), ("b", None, 3, "z")], "book_id string, machine_name string, ord int, value string")
    assert export.book_metadata(v).first()["fields"] == {"title": "y"}
    box = spark.createDataFrame([("l", "ab́", 9, 5)], "line_id string, text string, width int, height int")
    assert export.line_boxes(box).first()["value"] == "a 0 0 9 5 0\nb́ 0 0 9 5 0\n\t 0 0 9 5 0\n"
    n = spark.createDataFrame([("v", "u1", "GET", 200, ["manifest"]), ("v", "u1", "GET", 200, ["manifest", "info_json"])], "viewer_url string, url string, method string, status int, matched_signals array<string>")
    assert '"manifest":["u1"]' in export.network_log(n).first()["json"]
    c = spark.createDataFrame([("f", 4, 4, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0)], "file string, c_ref long, c_hyp long, c_hits long, c_sub long, c_del long, c_ins long, w_ref long, w_hyp long, w_hits long, w_sub long, w_del long, w_ins long")
    assert tuple(export.metric_rows(c, "file").first())[3:6] == ("25.0000", "75.0000", "75.0000")
    r = spark.createDataFrame([("p", 2, [1.0], 0.5, "t", None), ("p", 1, None, None, None, "bad")], "page string, no int, box array<double>, score double, text string, error string")
    assert export.crop_report(r, "page").first()["value"] == "error: bad\n2\t1.0\t0.5000\tt"
    w = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {tuple(x) for x in export.missing_files(w, w.filter("name = 'a'")).collect()} == {("a", "copied"), ("b", "missing")}


def test_command_line(spark, small, tmp_path, capsys):
    from codexmill.__main__ import main

    engines_ = [r["engine"] for r in spark.read.parquet(f"{small}/engine_configs.parquet").orderBy("engine_rank").collect()]
    config = tmp_path / "c.yaml"
    config.write_text(f"paths: {{images_root: {small}, output_root: out}}\nengines: {{{', '.join(e + ': true' for e in engines_)}}}\n")
    run = lambda *a: main(["--config", str(config), *a], spark)
    assert run("doctor") == 0
    assert main(["--config", str(config), "--images-root", str(tmp_path), "doctor"], spark) == 1
    capsys.readouterr()
    assert run("run-all", "--limit", "3") == 0
    names = [p.rsplit("/", 1)[1] for p in capsys.readouterr().out.split()]
    assert names == ["outputs", "lines", "pages", "xml", "bundle", "queue", "disagreement", "coverage", "labels", "line_dataset"]
    lines = spark.read.parquet(str(tmp_path / "out" / "lines"))
    pages = lines.select("page_id").distinct().count()
    assert 0 < pages <= 3 and spark.read.parquet(str(tmp_path / "out" / "queue")).count() == pages
    # what is there stays, unless forced
    assert run("consensus", "--limit", "1") == 0 and spark.read.parquet(str(tmp_path / "out" / "lines")).select("page_id").distinct().count() == pages
    assert run("consensus", "--limit", "1", "--force") == 0 and spark.read.parquet(str(tmp_path / "out" / "lines")).select("page_id").distinct().count() == 1
    with pytest.raises(SystemExit):
        run("no such stage")


def test_registered_engine(spark, small, tmp_path):
    from codexmill.__main__ import outputs_of
    from codexmill.sources.files import EngineSettings

    class Blank:
        name = "blank"

        def __init__(self, engine_version="0"):
            self.given = engine_version

        def version(self):
            return self.given

        def run(self, pages):
            return pages.select("page_id", F.lit("blank").alias("engine"), F.lit(self.given).alias("engine_version"))

    engines.register("blank", Blank)
    try:
        got = outputs_of(spark, Settings(engines={"blank": EngineSettings(True, {"engine_version": "7"}), "off": EngineSettings(False)}), spark.range(3).selectExpr("cast(id as string) page_id"), None)
        assert sorted(map(tuple, got.collect())) == [(str(i), "blank", "7") for i in range(3)]
    finally:
        engines.REGISTRY.pop("blank")


def test_shared_folder_is_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from codexmill.session import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: d)
    away = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf), conf=conf)
    with pytest.raises(ValueError):
        shared_folder(away)


def test_retries_and_totals(spark):
    from codexmill.operators import quality, runs

    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("c", 1, False), ("c", 2, False), ("c", 3, False), ("c", 4, True), (None, 1, True)]
    df = spark.createDataFrame(rows, "k string, n int, ok boolean")
    got = {r["k"]: (r["attempts"], r["state"]) for r in runs.retry_state(df, ["k"], ["n"], "ok", 3).collect()}
    assert got == {"a": (2, "done"), "b": (1, "waiting"), "c": (3, "given up"), None: (1, "done")}
    assert [r[0] for r in spark.range(1, 6).select(runs.retry_delay(F.col("id"), 1, 2, 5)).collect()] == [1, 2, 4, 5, 5]
    s = spark.createDataFrame([("x", "complete"), ("x", "failed"), ("y", None)], "k string, s string")
    assert {tuple(r) for r in runs.status_totals(s, "s", ["k"]).collect()} == {("x", 1, 0, 1, 1), ("y", 0, 0, 0, 0)}
    assert runs.page_range(df, "n", 2, 3).count() == 4 and runs.page_range(df, "n").count() == 9
    h = {r["k"]: r["labels"] for r in quality.layout_histogram(df.withColumn("l", F.when(F.col("ok"), "t").otherwise("f")), "k", "l").collect()}
    assert h["a"] == {"f": 2, "t": 1}
    assert quality.size_total(df.limit(0), "n", ["k"]).count() == 0


def test_groups_over_batches():
    import random

    import pyarrow as pa

    from codexmill.operators.grouped import whole_groups

    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.choice("abcd") for _ in range(rng.randint(0, 25)))
        rows = list(zip(keys, range(len(keys))))
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(0, 6)
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.int64())], names=["k", "v"]))
            at += n
        got = []
        for table, spans in whole_groups(iter(batches), ["k"]):
            assert spans[0][0] == 0 and spans[-1][1] == table.num_rows and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
            got += [list(zip(table.column("k").to_pylist()[a:b], table.column("v").to_pylist()[a:b])) for a, b in spans]
        assert got == [[r for r in rows if r[0] == k] for k in sorted(set(keys))]
