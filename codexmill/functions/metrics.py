"""Edit distance and error rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions.text import words

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("ref", "hyp", "hits", "sub", "del", "ins")])


def cer(prediction: Column, truth: Column) -> Column:
    """Edits by character over the truth's length; an empty truth counts 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(prediction) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(prediction, truth) / F.length(truth))


def wer_legacy(prediction: Column, truth: Column) -> Column:
    """Edits by character between the words joined by newlines, over the truth's words: may exceed a word error rate by far."""
    p, t = words(prediction), words(truth)
    return F.when(F.size(t) == 0, F.when(F.size(p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(F.array_join(p, "\n"), F.array_join(t, "\n")) / F.size(t))


def align(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a cheapest alignment.

    Among cheapest ones the path back prefers a diagonal step, then a deletion, then an insertion.
    """
    n, m = len(ref), len(hyp)
    if not n or not m:
        return 0, 0, n, m
    code: dict = {}
    a = np.array([code.setdefault(x, len(code)) for x in ref])
    b = np.array([code.setdefault(x, len(code)) for x in hyp])
    cost = np.zeros((n + 1, m + 1), dtype=np.int32)
    cost[0] = np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        base = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        row = np.concatenate(([i], base)) - step
        cost[i] = np.minimum.accumulate(row) + step
    hits = sub = dele = ins = 0
    i, j = n, m
    while i or j:
        here = cost[i, j]
        if i and j and here == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] == b[j - 1]:
                hits += 1
            else:
                sub += 1
            i, j = i - 1, j - 1
        elif i and here == cost[i - 1, j] + 1:
            dele, i = dele + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return hits, sub, dele, ins


def _count(ref: list, hyp: list) -> dict:
    h, s, d, i = align(ref, hyp)
    return {"ref": len(ref), "hyp": len(hyp), "hits": h, "sub": s, "del": d, "ins": i}


@F.pandas_udf(COUNTS)
def char_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Counts by character; null counts as empty."""
    return pd.DataFrame([_count(list(r or ""), list(h or "")) for r, h in zip(ref, hyp)], columns=COUNTS.fieldNames())


@F.pandas_udf(COUNTS)
def word_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Counts by word; null counts as empty."""
    return pd.DataFrame([_count((r or "").split(), (h or "").split()) for r, h in zip(ref, hyp)], columns=COUNTS.fieldNames())


def percent(part: Column, whole: Column) -> Column:
    """100 part/whole; 0/0 is 0, x/0 is 100."""
    return F.when(whole == 0, F.when(part == 0, 0.0).otherwise(100.0)).otherwise(100.0 * part / whole)


def rates(counts: str = "") -> list[Column]:
    """error_rate, precision, recall and f1 in per cent, from columns ref, hyp, hits, sub, del, ins (behind a prefix)."""
    c = lambda n: F.col(f"{counts}{n}")
    p, r = percent(c("hits"), c("hyp")), percent(c("hits"), c("ref"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [percent(c("sub") + c("del") + c("ins"), c("ref")).alias("error_rate"), p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def fixed(value: Column, places: int = 6) -> Column:
    """Rounded through a decimal, so that every engine rounds alike."""
    return F.round(value.cast("decimal(38,12)"), places).cast("double")
