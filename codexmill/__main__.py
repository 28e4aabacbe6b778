"""Command line: the stages over tables in Parquet, configured by a YAML file.

    python -m codexmill --config config.yaml run-all --limit 20

The folder `images_root` holds the tables page_refs and engine_pages; results go to folders below
`output_root`, one for each result, as Parquet. A result that is there is kept unless --force is
given. Options win over the file, the file over defaults.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators import engines
from codexmill.plans.pipeline import run_all
from codexmill.sources.files import Settings, engine_table, load_settings

#: Stage, and the results of the chain that it writes.
STAGES = {
    "bootstrap": ("outputs",),
    "consensus": ("lines", "pages"),
    "pagexml": ("xml",),
    "escriptorium": ("bundle",),
    "queue": ("queue",),
    "reports": ("disagreement", "coverage", "labels"),
    "benchmark": ("benchmark",),
    "hf-export": ("line_dataset",),
}
STAGES["run-all"] = tuple(r for s in ("bootstrap", "consensus", "pagexml", "escriptorium", "queue", "reports", "hf-export") for r in STAGES[s])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m codexmill", description="Stages of the consensus chain")
    p.add_argument("--config", required=True, help="YAML configuration")
    p.add_argument("--images-root", default=None, help="folder of the tables, before the file's")
    p.add_argument("--output-root", default=None, help="folder of the results, before the file's")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="check tables, engines and folders")
    for name in STAGES:
        s = sub.add_parser(name)
        s.add_argument("--limit", type=int, default=None, help="first pages by page_id")
        s.add_argument("--first", type=int, default=None, help="least page number")
        s.add_argument("--last", type=int, default=None, help="largest page number")
        s.add_argument("--force", action="store_true", help="write results anew")
    return p


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def doctor(spark: SparkSession, settings: Settings) -> DataFrame:
    """(name, ok, message) of what the stages need: the tables, the folder of results, and a factory or recorded outputs of every enabled engine."""
    root = settings.images_root
    found = {f"{root}/{t}.parquet": _exists(spark, f"{root}/{t}.parquet") for t in ("page_refs", "engine_pages")}
    enabled = [k for k, v in settings.engines.items() if v.enabled]
    recorded = set()
    if found[f"{root}/engine_pages.parquet"] and enabled:
        recorded = {r[0] for r in spark.read.parquet(f"{root}/engine_pages.parquet").filter(F.col("engine").isin(enabled)).select("engine").distinct().collect()}
    found |= {e: e in engines.REGISTRY or e in recorded for e in enabled}
    return engines.checks(spark, enabled, found, list(found)[:2])


def outputs_of(spark: SparkSession, settings: Settings, pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Outputs of the enabled engines for pages: by the registered factory, called with its configured options, else as recorded."""
    made = []
    for name, e in settings.engines.items():
        if e.enabled:
            make = engines.REGISTRY.get(name)
            made.append(make(**e.options) if make else engines.Recorded(name, recorded))
    return engines.run_engines(pages, made)


def results(spark: SparkSession, settings: Settings, limit=None, first=None, last=None, with_benchmark: bool = False) -> dict[str, DataFrame]:
    from codexmill.operators.export import import_bundle
    from codexmill.operators.runs import page_range

    pages = spark.read.parquet(f"{settings.images_root}/page_refs.parquet").filter("page_id is not null")
    number = F.regexp_extract("page_id", "([0-9]+)$", 1).try_cast("long")
    pages = page_range(pages.withColumn("_no", number), "_no", first, last).drop("_no")
    if limit is not None:
        pages = pages.join(F.broadcast(pages.select("page_id").distinct().orderBy("page_id").limit(limit)), "page_id", "left_semi")
    outputs = outputs_of(spark, settings, pages, spark.read.parquet(f"{settings.images_root}/engine_pages.parquet"))
    out = run_all(pages, outputs, settings, engine_table(spark, settings), with_benchmark)
    images = pages.groupBy("page_id").agg(F.max("image_path").alias("image_path"), F.max("book_id").alias("book_id"))
    return out | {"outputs": outputs, "bundle": import_bundle(out["lines"].select("page_id"), images)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = load_settings(args.config, {"images_root": args.images_root, "output_root": args.output_root})
    spark = spark or SparkSession.builder.appName("codexmill").getOrCreate()
    if args.command == "doctor":
        rows = doctor(spark, settings).collect()
        for r in rows:
            print(f"{'ok' if r['ok'] else 'FAIL'}\t{r['name']}\t{r['message']}")
        return 0 if reduce(lambda a, r: a and r["ok"], rows, True) else 1
    out = results(spark, settings, args.limit, args.first, args.last, args.command == "benchmark")
    for name in STAGES[args.command]:
        path = f"{settings.output_root}/{name}"
        if args.force or not _exists(spark, f"{path}/_SUCCESS"):
            out[name].write.mode("overwrite").parquet(path)
        print(path)
        if name == "lines":  # what follows reads the lines that were written
            written = spark.read.parquet(path)
            images = spark.read.parquet(f"{settings.images_root}/page_refs.parquet").groupBy("page_id").agg(F.max("image_path").alias("image_path"))
            from codexmill.operators import export, reports

            out |= {"queue": reports.review_queue(written), "labels": reports.label_totals(written), "line_dataset": export.line_dataset(written, images)}
    return 0


if __name__ == "__main__":
    sys.exit(main())
