"""Vectors in a written table that tasks read: rows meet the vectors of their items
where they are grouped, and no vector moves once for each row that names it.

``stored`` writes ``[item_id, features]`` as ids and bytes to the shared folder.  A
task's ``VectorTable`` holds the table whole where it is small; of a larger one it
reads through for each run of rows and keeps the vectors that the run names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written_copy

RUN_ROWS = 1 << 20        # rows of a run, about: so many vectors are held at most
HELD_BYTES = 256 << 20    # of a table that is held whole
SUM_ROWS = 1 << 14        # rows whose vectors are widened at once


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as rows of a matrix."""
    flat, n = column.flatten(), len(column)
    if flat.null_count or column.null_count or (n and len(flat) % n) or len(np.unique(np.diff(column.offsets))) > 1:
        raise ValueError("vectors must be present, whole and of one length")
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def byte_rows(vectors: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow column of bytes."""
    flat = np.ascontiguousarray(vectors)
    size = flat.shape[1] * flat.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _as_bytes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("features")).astype(kind, copy=False)
                yield pa.record_batch([batch.column("item_id"), byte_rows(vectors)], names=["item_id", "vector"])

    return run


def stored(items: DataFrame) -> VectorTable:
    """Write ``items[item_id, features]`` for the tasks of this application; rows
    without an id or a vector can be met by no row and are left out."""
    ship_package(items.sparkSession)
    kind = "<f8" if "double" in items.schema["features"].dataType.simpleString() else "<f4"
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "features").dropna()
    return VectorTable(written_copy(rows.mapInArrow(_as_bytes(kind), "item_id long, vector binary"), "vectors"), kind)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class VectorTable:
    """A written table of vectors, as a task sees it."""

    def __init__(self, path: str, kind: str = "<f4"):
        self.path, self.kind, self.whole = path, kind, None

    def __getstate__(self):
        return {**self.__dict__, "whole": None}

    def _files(self) -> list:
        files, at = opened(self.path)
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
        return [pq.ParquetFile(f, filesystem=files) for f in found]

    def pieces(self, *more: str) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids, vectors and more columns) of some rows at a time, in order."""
        for file in self._files():
            for batch in file.iter_batches(32768, columns=["item_id", "vector", *more], use_threads=False):
                column = batch.column("vector")
                ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
                flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].view(self.kind)
                if len(column):
                    yield (batch.column("item_id").to_numpy(), flat.reshape(len(column), -1),
                           *(batch.column(c).to_numpy() for c in more))

    def _read(self, wanted: np.ndarray | None) -> Found:
        ids, vectors = [], []
        for i, v in self.pieces():
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, i), len(wanted) - 1)
                keep = wanted[at] == i
                i, v = i[keep], v[keep]
            ids.append(i)
            vectors.append(v)
        return Found(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64),
                     np.concatenate([v for v in vectors if len(v)]) if any(len(v) for v in vectors) else np.zeros((0, 0), dtype=self.kind))

    def found(self, items: np.ndarray) -> Found:
        """The vectors of these items, among others."""
        if self.whole is None:
            files = self._files()
            size = sum(f.metadata.row_group(g).total_byte_size for f in files for g in range(f.metadata.num_row_groups))
            self.whole = self._read(None) if size <= HELD_BYTES else False
        return self.whole or self._read(np.unique(items))

    def gram(self) -> np.ndarray:
        """YᵀY of the whole table."""
        total = None
        pieces = [(None, self.whole.vectors[:-1])] if self.whole else self.pieces()
        for _, vectors in pieces:
            for at in range(0, len(vectors), SUM_ROWS):
                y = vectors[at:at + SUM_ROWS].astype(np.float64)
                total = y.T @ y if total is None else total + y.T @ y
        return total


class Found:
    """Vectors by item id; after them a row of zeros, for no item."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable") if (ids[1:] < ids[:-1]).any() else slice(None)
        self.ids, self.d = ids[order], vectors.shape[1]
        self.vectors = np.concatenate([vectors[order], np.zeros((1, self.d), dtype=vectors.dtype)])
        self.once = not (self.ids[1:] == self.ids[:-1]).any()
        self.first = int(self.ids[0]) if len(ids) else 0
        span = int(self.ids[-1]) - self.first + 1 if len(ids) else 0
        self.place = None
        if self.once and span <= 4 * len(ids) + 1024:      # dense ids are looked up, not searched
            self.place = np.full(span, -1, dtype=np.int32)
            self.place[self.ids - self.first] = np.arange(len(ids), dtype=np.int32)

    def rows(self, items: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """(owner, row): the rows of the vectors of each item, -1 where there is none;
        the owner is None where each item has one place."""
        if self.place is not None:
            at = items - self.first
            inside = (at >= 0) & (at < len(self.place))
            out = np.full(len(items), -1, dtype=np.int32)
            out[inside] = self.place[at[inside]]
            return None, out
        lo, hi = (np.searchsorted(self.ids, items, side=s) for s in ("left", "right"))
        if self.once:
            return None, np.where(hi > lo, lo, -1)
        n = np.maximum(hi - lo, 1)
        owner = np.repeat(np.arange(len(n)), n)
        row = np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + lo[owner]
        return owner, np.where((hi > lo)[owner], row, -1)


def runs(batches: Iterator[pa.RecordBatch], most: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches put together to runs of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def group_starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """First rows of the groups of equal values that follow each other."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for name in names:
        code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]
