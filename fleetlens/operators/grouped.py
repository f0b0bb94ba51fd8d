"""Run a small numpy helper over key groups without one Python call chain per group.

``groupBy().applyInPandas`` builds a pandas frame for every group, which costs milliseconds
however small the group. Here rows are hash-partitioned by the keys, sorted, and streamed
through ``mapInPandas``; groups are cut out of the Arrow batches as array slices. A group that
crosses a batch border is carried over, so memory is bounded by a batch plus one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Group = dict[str, np.ndarray]


def sorted_groups(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[Group]:
    """Cut batches that are sorted by ``keys`` into groups."""
    keys = list(keys)
    pending: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if pending and (batch[keys].iloc[-1] == pending[0][keys].iloc[0]).all():
            pending.append(batch)  # sorted, so the whole batch continues the open group
            continue
        if pending:
            batch = pd.concat([*pending, batch], ignore_index=True)
        columns = {name: batch[name].to_numpy() for name in batch.columns}
        changed = np.zeros(len(batch) - 1, dtype=bool)
        for key in keys:
            changed |= columns[key][1:] != columns[key][:-1]
        starts = np.concatenate(([0], np.flatnonzero(changed) + 1))
        for begin, end in zip(starts[:-1], starts[1:]):
            yield {name: values[begin:end] for name, values in columns.items()}
        pending = [batch.iloc[starts[-1]:]]
    if pending:
        rest = pd.concat(pending, ignore_index=True)
        yield {name: rest[name].to_numpy() for name in rest.columns}


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[Group], Group | None], schema: str,
    chunk: int = 5_000,
) -> DataFrame:
    """Apply ``fn`` to every group of ``keys``, rows sorted by ``order``; columns must be non-null."""
    keys = list(keys)
    names = [field.split()[0] for field in _fields(schema)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[Group] = []
        for group in sorted_groups(batches, keys):
            result = fn(group)
            if result is not None:
                waiting.append(result)
            if len(waiting) >= chunk:
                yield _frame(waiting, names)
                waiting = []
        if waiting:
            yield _frame(waiting, names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    return [part.strip() for part in schema.split(",")]


def _frame(groups: list[Group], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({
        name: [v for g in groups for v in g[name]] if groups[0][name].dtype == object
        else np.concatenate([g[name] for g in groups])
        for name in names
    })


def repeat(value: object, n: int) -> np.ndarray:
    out = np.empty(n, dtype=object)
    out[:] = value
    return out
