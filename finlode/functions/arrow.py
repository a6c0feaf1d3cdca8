"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def new_runs(rows: pa.Table, *names: str) -> np.ndarray:
    """Flags of the rows that differ from the row before in one of the columns."""
    flag = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        flag[1:] = False
        for name in names:
            column = rows.column(name).combine_chunks()
            flag[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return flag


def whole_runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that end where a run ends, with the runs' first rows; only the last run is held back.

    Key columns have no nulls.
    """
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        if held:
            # joined only once the run that is held back has ended, so that a long run is not copied again and again
            edge = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows.slice(rows.num_rows - 1)])
            if not new_runs(edge.combine_chunks(), *names)[1]:
                held.append(rows)
                continue
            rows = pa.concat_tables([*held, rows])
        rows = rows.combine_chunks()
        starts = np.flatnonzero(new_runs(rows, *names))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1]
        held = [rows.slice(int(starts[-1]))]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, np.flatnonzero(new_runs(rows, *names))
