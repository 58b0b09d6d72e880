"""State that outlives a task: Python workers are reused, and what one has loaded or remembered serves its next tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The worker's object of this key, made on first use. A worker keeps one object, the last one used, so that what one stage
    remembered takes no memory in the next.

    The object must bound its own size.
    """
    store = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if store.get("last", (None,))[0] != key:
        store["last"] = None, None
        store["last"] = key, make()
    return store["last"][1]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
