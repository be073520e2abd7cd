"""Whole groups of sorted rows as Arrow tables inside a task, and vectorised helpers on their columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column) -> np.ndarray:
    """Numbers that are equal where the values of a column are (null equals null)."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(c.type) and c.null_count == 0:
        return c.to_numpy()
    return pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before (the first row does)."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def group_starts(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return starts(*(codes(t.column(n)) for n in names)) if names else np.arange(t.num_rows) == 0


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end with a whole group; the rows come sorted by ``names``."""
    held, have, most = [], 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += b.num_rows
        if have < most:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(group_starts(t, names))[-1])
        if not cut:  # one group so far: look again when there is twice as much
            most = 2 * have
            continue
        yield t.slice(0, cut)
        held, have, most = t.slice(cut).to_batches(), t.num_rows - cut, rows
    if held:
        yield pa.Table.from_batches(held)


def with_columns(t: pa.Table, names: Sequence[str], rows: np.ndarray, **new) -> Iterator[pa.RecordBatch]:
    """``names`` of the given rows beside new columns."""
    own = t.select(list(names)).take(pa.array(rows)) if names else None
    arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (own.columns if own is not None else [])]
    arrays = [a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks) for a in arrays]
    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c) for c in new.values())], names=[*names, *new])


def ragged(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of n[i] positions from first[i] on, for each i in turn."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes: minima along edges with pointer jumping."""
    label = np.arange(n)
    while len(src):
        a, b = label[src], label[dst]
        new, least = label.copy(), np.minimum(a, b)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = jumped(new)
        if (new == label).all():
            break
        label = new
    return label


def jumped(parent: np.ndarray) -> np.ndarray:
    """Root of each node of a forest of parents."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up
