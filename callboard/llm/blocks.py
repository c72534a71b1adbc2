"""Helpers of operators whose tasks read sorted rows in runs: complete runs, and column names not taken."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores added where a column has the name in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the first row of every run of equal keys; null equals null."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table[key]
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of equal keys, with the places where runs start, from sorted batches.

    The last run of a batch waits for the next batch; so memory holds a batch and one run.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and len(starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys)) > 1:
            done, held = pa.concat_tables(held).combine_chunks(), []
            yield done, starts(done, keys)
        at = starts(table, keys)
        if len(at) > 1:
            done = pa.concat_tables([*held, table.slice(0, at[-1])]).combine_chunks()
            yield done, starts(done, keys)
            held = []
        held.append(table.slice(at[-1]))
    if held:
        done = pa.concat_tables(held).combine_chunks()
        yield done, starts(done, keys)
