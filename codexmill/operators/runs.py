"""Order-dependent run logic: resume, failure guard, sticky skips, progress, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import materialise


def to_do(wanted: DataFrame, done: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Rows still to be made: all with force, else those whose key is not done."""
    return wanted if force else wanted.join(done.select(*key).distinct(), key, "left_anti")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of an order, with the range's number `_p`, written so that the ranges stay as they are.

    Rows of equal keys lie in one range. What needs the order of all rows is then done range by
    range, with one summary row a range carrying over.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")


def running_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name` from 1 in an order over all rows, without bringing them into one task. Order the rows fully: ties are numbered anyhow."""
    r = ranged(df, order)
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return r.withColumn(name, place).join(before, "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")


def failure_guard(runs: DataFrame, by: list[str], order: list[str], failed: str, limit: int = 5, counts: str | None = None) -> DataFrame:
    """runs with `streak` (consecutive failures up to this row) and `cut` (after the row where the limit was reached).

    A success resets the streak. Rows for which `counts` is false (existing outputs, skips) neither
    add nor reset; their streak is the one before them. An engine may hold a large share of all
    rows: its order is cut into ranges, and what a range hands on is one row.
    """
    real = F.col(counts) if counts else F.lit(True)
    r = ranged(runs, [*by, *order])
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_block", F.sum(F.when(real & ~F.col(failed), 1).otherwise(0)).over(inside))
    part = Window.partitionBy("_p", *by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_own", F.sum(F.when(real & F.col(failed), 1).otherwise(0)).over(part))
    # a range hands on its trailing streak, added to the one before unless it has a success
    last = F.max_by("_own", F.struct("_block", "_own"))
    g = r.groupBy(*by, "_p").agg(F.max("_block").alias("_resets"), last.alias("_tail"), F.max(F.when(F.col("_block") > 0, F.col("_own"))).alias("_later"), F.max(F.when(F.col("_block") == 0, F.col("_own"))).alias("_lead"))
    up = Window.partitionBy(*by).orderBy("_p")
    g = g.withColumn("_g", F.sum((F.col("_resets") > 0).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = g.withColumn("_sum", F.sum("_tail").over(Window.partitionBy(*by, "_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = g.withColumn("_carry", F.coalesce(F.lag("_sum").over(up), F.lit(0)))
    high = F.greatest(F.coalesce("_later", F.lit(0)), F.coalesce(F.col("_lead") + F.col("_carry"), F.lit(0)))
    g = g.withColumn("_hit", F.coalesce(F.max(high >= limit).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).select(*by, "_p", "_carry", "_hit")
    out = _with(r, g, by).withColumn("streak", (F.col("_own") + F.when(F.col("_block") == 0, F.col("_carry")).otherwise(0)).cast("long"))
    before = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("cut", F.col("_hit") | F.coalesce(F.max(F.col("streak") >= limit).over(before), F.lit(False))).drop("_p", "_block", "_own", "_carry", "_hit")


def _with(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Join a range's summary to its rows; a null in `by` is a value like others."""
    s = summary.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_p").alias("_k_p"), *[c for c in summary.columns if c not in (*by, "_p")])
    on = rows["_p"] == s["_k_p"]
    for c in by:
        on = on & rows[c].eqNullSafe(s[f"_k_{c}"])
    return rows.join(s, on).drop("_k_p", *[f"_k_{c}" for c in by])


def sticky_skip(runs: DataFrame, by: list[str], order: list[str], fatal: str, message: str) -> DataFrame:
    """runs with `skipped` and `cause`: every row after a fatal one is skipped, for the first fatal message."""
    r = ranged(runs, [*by, *order])
    before = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col(fatal), F.struct(F.col(message).alias("m")))
    g = r.groupBy(*by, "_p").agg(F.min_by(hit, F.when(F.col(fatal), F.struct(*order))).alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_first", F.first("_first", ignorenulls=True).over(earlier))
    out = _with(r.withColumn("_here", F.first(hit, ignorenulls=True).over(before)), g, by)
    cause = F.coalesce("_first", "_here")
    return out.withColumn("skipped", cause.isNotNull()).withColumn("cause", cause["m"]).drop("_p", "_here", "_first")


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest event of each key: the current state of an append-only log."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def progress(state: DataFrame, book: str, page: str, status: str) -> DataFrame:
    """(book, completed, failed, suspect): ordered pages of each status, from the latest state of every page."""
    pick = lambda s: F.array_sort(F.collect_set(F.when(F.col(status) == s, F.col(page)))).alias(s)
    return state.groupBy(book).agg(pick("completed"), pick("failed"), pick("suspect"))


def run_status(books: DataFrame, expected: str, found: str, reasons: str) -> DataFrame:
    """books with `status` complete, partial or failed, and `reason` joined from an array of reasons."""
    joined = F.concat_ws("; ", F.filter(reasons, lambda r: F.length(r) > 0))
    status = F.when(F.col(found) == 0, "failed").when((F.col(found) < F.col(expected)) | (joined != ""), "partial").otherwise("complete")
    return books.withColumn("status", status).withColumn("reason", joined)


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """df with `batch` from 0: runs of `size` rows in an order, per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def best_so_far(epochs: DataFrame, by: list[str], score: str, epoch: str) -> DataFrame:
    """The best epoch of each run; the later wins ties."""
    return epochs.groupBy(*by).agg(F.max_by(epoch, F.struct(score, epoch)).alias(epoch), F.max(score).alias(score))


def status_totals(rows: DataFrame, status: str, by: list[str]) -> DataFrame:
    """(by..., complete, partial, failed, exit_code): rows of each status; the exit code is 1 where anything failed."""
    n = lambda s: F.count_if(F.col(status) == s)
    return rows.groupBy(*by).agg(n("complete").alias("complete"), n("partial").alias("partial"), n("failed").alias("failed"), F.when(n("failed") > 0, 1).otherwise(0).alias("exit_code"))


def page_range(pages: DataFrame, number: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages numbered from first to last, both included; an end that is null is open."""
    if first is not None:
        pages = pages.filter(F.col(number) >= first)
    return pages if last is None else pages.filter(F.col(number) <= last)


def retry_delay(attempt: Column, base: float, factor: float, most: float) -> Column:
    """Seconds to wait after this attempt (from 1): base, times factor for each further one, up to most."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt - 1))


def retry_state(attempts: DataFrame, key: list[str], order: list[str], ok: str, most: int) -> DataFrame:
    """(key..., attempts, state): done at the first success among the first `most` attempts in order, given up after so many, else waiting.

    Of a key's attempts only the first `most` are kept, so that a key of many rows is no large group.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    first = attempts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    g = first.groupBy(*key).agg(F.min(F.when(F.col(ok), F.col("_n"))).alias("_good"), F.max("_n").alias("_made"))
    state = F.when(F.col("_good").isNotNull(), "done").when(F.col("_made") >= most, "given up").otherwise("waiting")
    return g.select(*key, F.coalesce("_good", "_made").cast("long").alias("attempts"), state.alias("state"))
