"""The failure guard and the sticky skip as stateful stream operators, keyed by engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT = "engine string, seq long, failed boolean, streak long, cut boolean, skipped boolean, cause string"
STATE = "streak long, cut boolean, fatal boolean, cause string"


def guarded(runs: DataFrame, limit: int = 5) -> DataFrame:
    """runs (engine, seq, failed, fatal, message) with streak, cut, skipped and cause, as the batch operators give.

    State is one row an engine. Rows are taken by seq within a batch; a source that orders its files
    by time keeps that order across batches.
    """

    def step(key, frames, state):
        streak, cut, fatal, cause = state.get if state.exists else (0, False, False, None)
        rows = []
        pdf = pd.concat(list(frames)).sort_values("seq")
        for r in pdf.itertuples(index=False):
            before = (cut, fatal, cause)
            streak = streak + 1 if r.failed else 0
            rows.append((key[0], int(r.seq), bool(r.failed), streak, *before))
            cut = cut or streak >= limit
            if r.fatal and not fatal:
                fatal, cause = True, r.message
        state.update((streak, cut, fatal, cause))
        yield pd.DataFrame(rows, columns=["engine", "seq", "failed", "streak", "cut", "skipped", "cause"])

    return runs.groupBy("engine").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
