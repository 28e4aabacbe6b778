"""Engines as DataFrame transformations, requests to remote ones, and environment checks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators.runs import failure_guard, sticky_skip, to_do

# Generation options that a model request may carry.
GENERATION_OPTIONS = ("temperature", "top_p", "top_k", "num_predict", "num_ctx", "seed", "stop", "repeat_penalty")


class Engine(Protocol):
    """An engine turns pages into engine pages; it decides itself how its work is distributed."""

    name: str

    def version(self) -> str: ...

    def run(self, pages: DataFrame) -> DataFrame: ...


class Recorded:
    """The default engine: outputs that were recorded before, read from a table of engine pages."""

    def __init__(self, name: str, outputs: DataFrame):
        self.name = name
        self.outputs = outputs

    def version(self) -> str:
        return "recorded"

    def run(self, pages: DataFrame) -> DataFrame:
        return self.outputs.filter(F.col("engine") == self.name).join(pages.select("page_id").distinct(), "page_id", "left_semi")


REGISTRY: dict[str, Callable[..., Engine]] = {}


def register(name: str, make: Callable[..., Engine]) -> None:
    REGISTRY[name] = make


def run_engines(pages: DataFrame, engines: list[Engine], done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Outputs of every engine over the pages it has not done; engines are few, their outputs are united."""
    out = None
    for e in engines:
        left = pages if done is None else to_do(pages.withColumn("engine", F.lit(e.name)), done, ["page_id", "engine"], force).drop("engine")
        got = e.run(left)
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no engine")
    return out


def guarded_outputs(outputs: DataFrame, limit: int = 5) -> DataFrame:
    """outputs (engine, page_id, output_id, failures) with streak, cut, skipped and cause: pages after a fatal failure are skipped and don't count."""
    f = F.coalesce("failures", F.array().cast(outputs.schema["failures"].dataType))
    bad = F.exists(f, lambda x: ~F.coalesce(x["recoverable"], F.lit(True)))
    r = outputs.withColumn("_failed", F.size(f) > 0).withColumn("_fatal", bad).withColumn("_message", F.get(F.filter(f, lambda x: ~F.coalesce(x["recoverable"], F.lit(True))), F.lit(0))["message"])
    r = sticky_skip(r, ["engine"], ["page_id", "output_id"], "_fatal", "_message").withColumn("_counts", ~F.col("_fatal") & ~F.col("skipped"))
    return failure_guard(r, ["engine"], ["page_id", "output_id"], "_failed", limit, "_counts").drop("_failed", "_fatal", "_message", "_counts")


def generation_options(options: Column) -> Column:
    """The entries of an options map that a request may carry."""
    return F.map_filter(options, lambda k, v: k.isin(*GENERATION_OPTIONS))


def request_body(model: Column, prompt: Column, image: Column, options: Column) -> Column:
    """JSON body of a vision request: the image's bytes in base 64, without the stream."""
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), F.array(F.base64(image)).alias("images"), F.lit(False).alias("stream"), generation_options(options).alias("options")))


def word_rows(words: DataFrame, text: str = "text", confidence: str = "conf") -> DataFrame:
    """Words with text and a confidence that is a number not below 0."""
    return words.filter((F.trim(text) != "") & (F.coalesce(F.col(confidence).try_cast("double"), F.lit(-1.0)) >= 0))


def lines_of_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Words (page..., block, par, line, word, text, conf, left, top, width, height) joined to lines: text in order, box around, mean confidence (4 places)."""
    key = [*page, "block", "par", "line"]
    g = word_rows(words).groupBy(*key).agg(
        F.min("left").alias("x1"), F.min("top").alias("y1"), F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"),
        F.round(F.avg(F.col("conf").try_cast("decimal(28,12)") / 100), 4).cast("double").alias("confidence"), F.array_sort(F.collect_list(F.struct("word", "text"))).alias("_w"),
    )
    return g.withColumn("text", F.array_join(F.transform("_w", lambda w: w["text"]), " ")).drop("_w")


def glyph_confidence(cuts: Column) -> Column:
    """Mean of an array of glyph confidences, 1 where there is none."""
    ok = F.filter(cuts, lambda v: v.isNotNull())
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, v: s + v) / F.size(ok)).otherwise(1.0)


def checks(spark: SparkSession, enabled: list[str], found: dict[str, bool], always: list[str]) -> DataFrame:
    """(name, ok, message): what always has to be there, and what the enabled engines need."""
    names = [*always, *[e for e in enabled if e not in always]]
    rows = [(n, bool(found.get(n)), "found" if found.get(n) else "missing") for n in names]
    return spark.createDataFrame(rows, "name string, ok boolean, message string")


def all_ok(results: DataFrame) -> DataFrame:
    """One row: whether every check passed; none is a pass."""
    return results.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
