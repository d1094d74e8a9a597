"""Folds in order: what depends on all rows of a group that came before, with a state of fixed size.

Rows of a group go to one task in their order, sorted by Spark (which spills), and pass
batch by batch; what the task holds is the state of one group, not the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def folded(rows: DataFrame, group: str, order: list[str | Column], start: Callable[[], Any], take: Callable[[Any, dict[str, list]], dict[str, list] | None], end: Callable[[Any], dict[str, list]] | None, schema: str, columns: list[str]) -> DataFrame:
    """Columns of ``schema`` behind ``group``, from the rows of each group in order.

    ``take(state, rows)`` gets stretches of a group's rows (a list for each of ``columns``) and gives
    rows to put out, or none; ``end(state)`` gives those of a group that is over.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    sorted_rows = rows.repartition(group).sortWithinPartitions(group, *order).select(group, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        state: Any = None
        begun, kind = False, []

        def out(found: dict[str, list] | None) -> Iterator[pa.RecordBatch]:
            if found and len(found[names[0]]):
                n = len(found[names[0]])
                yield pa.RecordBatch.from_pydict({group: pa.array([key] * n, kind[0]), **{c: found[c] for c in names}})

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            kind[:] = [batch.schema.field(0).type]
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if not begun or keys[at] != key:
                    if begun and end is not None:
                        yield from out(end(state))
                    key, state, begun = keys[at], start(), True
                part = batch.slice(at, to - at)
                yield from out(take(state, {c: part.column(k + 1).to_pylist() for k, c in enumerate(columns)}))
                at = to
        if begun and end is not None:
            yield from out(end(state))

    return sorted_rows.mapInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, {schema}")
