"""Cutting rows into runs of about equal bytes inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once in a Python worker.
RUN_BYTES = 1 << 20


def cuts(sizes: np.ndarray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows that hold about ``run_bytes``, or one row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + run_bytes, side="right")))
        yield start, end
        start = end


def by_bytes(texts: list[str], run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """``cuts`` of a list of texts, by their characters."""
    return cuts(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), run_bytes)


def text_runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, texts) of runs of a text column (null as empty).  Only one
    run at a time becomes Python strings, and memory that Arrow no longer needs
    goes back before the next batch."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, end in cuts(sizes, run_bytes):
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
    pa.default_memory_pool().release_unused()


def runs(batch: pa.RecordBatch, column: str, run_bytes: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch balanced by the bytes of a text column, with its texts."""
    for start, end, texts in text_runs(batch.column(column), run_bytes):
        yield batch.slice(start, end - start), texts


def coded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings of a list column as an array, the place of each
    string among them, and where each row's strings end."""
    codes = lists.flatten().dictionary_encode()
    return codes.dictionary, np.asarray(codes.indices), np.asarray(lists.value_lengths()).cumsum()


def distinct(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``coded`` with the distinct strings as a list."""
    strings, places, ends = coded(lists)
    return strings.to_numpy(zero_copy_only=False).tolist(), places, ends


def gathered(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the parts at the places after each other, and where each
    part ends (0 first).  A part is ``sizes`` numbers from ``starts`` on."""
    times = sizes[places]
    after = np.zeros(len(times) + 1, dtype=np.int64)
    np.cumsum(times, out=after[1:])
    return numbers[np.repeat(starts[places] - after[:-1], times) + np.arange(after[-1])], after


def put_together(parts: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each row the parts (32-bit numbers) at its places after each other."""
    numbers = np.frombuffer(b"".join(parts), dtype="<u4")
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    return rows_of(*gathered(numbers, np.cumsum(sizes) - sizes, sizes, places), ends)


def rows_of(numbers: np.ndarray, after: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each row of gathered parts."""
    data, cuts = numbers.tobytes(), (4 * after[ends]).tolist()
    return [data[s:e] for s, e in zip([0, *cuts[:-1]], cuts)]
