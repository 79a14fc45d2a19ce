"""Arrow batches cut to a bounded amount of text, for the operators that run Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at once; a longer text is handled alone.
CHARS = 2_000_000
#: The same where the work takes many times the size of its texts.
FEWER_CHARS = 500_000


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts, as Arrow holds them; null counts as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            # Texts without characters before the first one with some come with it.
            stop = max(int(np.searchsorted(ends, before + chars, side="right")), int(np.searchsorted(ends, before, side="right")) + 1)
            stop = min(stop, len(texts))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def text_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts in a list; null counts as empty."""
    for batch, texts in text_slices(batches, column, chars):
        yield batch, texts.to_pylist()
