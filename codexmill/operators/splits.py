"""Seeded splits and samples by hash order: the same on any engine and any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def train_eval(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """df (distinct keys) with `split`: round(n·ratio) rows (at least 1, at most n-1) by hash order are eval, the others train.

    Rows are counted by the hash's first four digits, at most 65,536 counts; only rows of the one
    value where the cut falls are put in order.
    """
    head = F.substring(shuffle_key(key, seed), 1, 4)
    counts = sorted((r["h"], r["n"]) for r in df.groupBy(head.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    left = max(1, min(n - 1, round(n * ratio))) if n > 1 else 0
    cut = "0000"
    for cut, c in counts:
        if c > left:
            break
        left -= c
    edge = df.select(key, shuffle_key(key, seed).alias("_h")).filter(head == cut).orderBy("_h", key).limit(left).select(key, F.lit(True).alias("_e"))
    split = F.when((head < cut) | F.col("_e"), "eval").otherwise("train")
    return df.join(edge, key, "left").withColumn("split", split).drop("_e")


def bucket_split(df: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """df with `split` by the hash's place in the unit interval: no counting, no shuffle."""
    place = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, edge, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / total
        out = F.when(place < edge, name) if out is None else out.when(place < edge, name)
    return df.withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1]))


def listed_split(df: DataFrame, book: str, test: DataFrame, val: DataFrame) -> DataFrame:
    """df with `split` by lists of books: test, then val, else train."""
    t = test.select(F.col(test.columns[0]).alias(book)).distinct().withColumn("_t", F.lit(True))
    v = val.select(F.col(val.columns[0]).alias(book)).distinct().withColumn("_v", F.lit(True))
    s = F.when(F.col("_t"), "test").when(F.col("_v"), "val").otherwise("train")
    return df.join(t, book, "left").join(v, book, "left").withColumn("split", s).drop("_t", "_v")


def spot_check(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of every group in hash order; a group's rows are ranked, not gathered."""
    w = Window.partitionBy(by).orderBy(shuffle_key(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
