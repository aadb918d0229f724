"""Helpers for tasks that walk sorted groups in Arrow batches with bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text, and rows, that a worker holds as Python objects at once; one longer text is held
#: by itself.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices that are bounded by the bytes of their text column and by their rows."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(before, before[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of ``df`` that clash with none of its own."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, from batches sorted by ``keys``.

    The rows of the last group of each table are held back until the group's end is seen,
    so memory is bounded by ``least_rows``, a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = group_starts(table, keys)[-1]
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each group of neighbouring rows with equal ``keys``."""
    n = table.num_rows
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        v = table.column(key).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Component label (smallest index) of each of ``n`` local nodes joined by edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def chain(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between neighbouring members of each component: no node gets more than two."""
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return order[:-1][same], order[1:][same]
