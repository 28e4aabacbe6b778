"""Grouped maps that stream: one shuffle, sorted partitions, and one group in memory at a time.

Spark's own grouped map hands every group over as a frame of its own, which costs milliseconds a
group; pages and images are small and many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that end with a group, and the places (from, to) of their groups; a group may go on over batches, each of which is looked at once."""
    rest: list[pa.Table] = []
    held, open_key = 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        spans, names = _spans(table, keys)
        same = held and names[0] == open_key
        if len(spans) > 1 or (held and not same):
            # the group that was open ends here, or with this batch's first one
            cut = spans[-1][0]
            ended = spans[:-1]
            moved = [(a + held, b + held) for a, b in ended]
            if same and moved:
                moved[0] = (0, moved[0][1])
            elif held:
                moved.insert(0, (0, held))
            yield pa.concat_tables([*rest, table.slice(0, cut)]), moved
            rest, held = [], 0
            table = table.slice(cut)
        rest.append(table)
        held += table.num_rows
        open_key = names[-1]
    if held:
        yield pa.concat_tables(rest), [(0, held)]


def _spans(table: pa.Table, keys: list[str]) -> tuple[list[tuple[int, int]], list[tuple]]:
    rows = list(zip(*[table.column(k).to_pylist() for k in keys]))
    out, names, at = [], [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            out.append((at, i))
            names.append(rows[at])
            at = i
    return out, names


def stream_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema) -> DataFrame:
    """df by groups of `keys`, each in `order`: run gets a table of whole groups with their places and gives the result's table.

    Rows with a null among the keys belong to no group and are left out: together they could be a
    group of any size.
    """

    def work(batches):
        for table, spans in whole_groups(batches, keys):
            yield from run(table, spans).combine_chunks().to_batches()

    return df.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
