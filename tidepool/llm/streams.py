"""Small helpers for Arrow streams inside tasks: sorted runs in, record batches out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

BATCH_ROWS = 2_000


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal ``keys``; the stream is sorted by them, runs may cross batches."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != current:
                yield rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield rows


def to_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``BATCH_ROWS`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
