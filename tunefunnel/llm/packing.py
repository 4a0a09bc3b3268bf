"""Packing of documents into token sequences along a space-filling curve.

Each document's token ids are hashed to buckets; the sum of a fixed random
direction for each bucket projects that count vector to ``DIMS`` dimensions, and
the cell of the projection has a Hilbert key.  Documents are range-sorted by
that key, so neighbours on the curve hold similar words, and are laid end to end
in this order and cut every ``length`` tokens.  Every sequence is full but the
last, which is padded to the next power of two.

The token table is written once.  The sort moves only (key, row, token count);
running totals within a range partition and one total per partition give each
document its place, and the places are joined back to the ids by row number, a
key without hot values.

Defined cases: null text is empty and gives the end token alone; rows are packed
one by one, repeated ones too, in the order key, doc_id (null first), row; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, hilbert, word_pieces
from .common import python_ready, text_or_empty, written

#: Tokens of a sequence, and the id put after each document.
LENGTH = 2048
END_ID = 1
#: Hash buckets of the count vectors, dimensions of the projection, bits each.
BUCKETS = 1 << 12
DIMS, BITS = 5, 8
#: Projections about this large fall in the middle half of the grid.
SPREAD = 0.1
#: Rows that a task can number: row = task << ROW_BITS | row in the task.
ROW_BITS = 36


def directions() -> np.ndarray:
    """A fixed random direction for each hash bucket (of single precision)."""
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32).astype(np.float64)


def curve_keys(ids: list[np.ndarray], direction: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents' token ids; the empty document is at the centre."""
    vectors = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        if len(x):
            hashed = (x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
            counts = np.bincount(hashed, minlength=BUCKETS)
            held = np.flatnonzero(counts != 0)
            vectors[i] = counts[held].astype(np.float64) @ direction[held] / len(x)
    share = 0.5 + np.arctan(vectors / SPREAD) / np.pi
    return hilbert.keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """The written token table: row, id, key, n (with the end token) and ids as
    little-endian unsigned numbers of ``width`` bytes."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, direction = word_pieces.opened(tokenizer), directions()
        row, end = TaskContext.get().partitionId() << ROW_BITS, np.uint32(END_ID).astype("<u4").tobytes()
        for part in parts:
            for run, texts in batches.runs(part, "text"):
                ids = [np.frombuffer(x + end, dtype="<u4") for x in encoder.encode(texts)]
                width = 2 if max(map(np.max, ids)) < 1 << 16 else 4
                yield pa.record_batch(
                    [pa.array(range(row, row + len(texts)), pa.int64()), run.column("id"),
                     pa.array(curve_keys([x[:-1] for x in ids], direction), pa.int64()),
                     pa.array(list(map(len, ids)), pa.int64()), pa.array([width] * len(ids), pa.int32()),
                     pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())],
                    names=["row", "id", "key", "n", "width", "ids"])
                row += len(texts)

    return written(rows.mapInArrow(
        encode, f"row long, id {id_type}, key long, n long, width int, ids binary"), "pack-tokens")


def places(tokens: DataFrame) -> DataFrame:
    """(row, place): the tokens before each document in curve order."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in rows:
            n = batch.column("n").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.record_batch(
                [batch.column("row"), pa.array(before, pa.int64()), batch.column("n"),
                 pa.array([part] * len(n), pa.int32())], names=["row", "before", "n", "part"])

    # Ties on the key are many where documents are copies; id and row split them.
    order = ["key", "id", "row"]
    ranged = written(tokens.select("key", "id", "row", "n").repartitionByRange(parts, *order)
                     .sortWithinPartitions(*order)
                     .mapInArrow(run, "row long, before long, n long, part int"), "pack-order")
    # One row per range partition.
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    start = spark.createDataFrame(starts, "part int, start long")
    return ranged.join(F.broadcast(start), "part").select(
        "row", (F.col("before") + F.col("start")).alias("place"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """The pieces of the packed sequences: id, start (the document's tokens
    before the piece), length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit numbers).  A document longer than what is left
    of a sequence goes on in the next one, so no token is lost or repeated."""
    tokens = tokenised(docs, tokenizer, id_col, text_col)
    id_type = tokens.schema["id"].dataType.simpleString()
    placed = tokens.select("row", "id", "n", "width", "ids").join(places(tokens), "row").select(
        "id", "n", "width", "ids", "place")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, n, place = part.column("ids"), part.column("n").to_pylist(), part.column("place").to_pylist()
            width = part.column("width").to_pylist()
            for first in range(0, len(n), 256):
                out: list[tuple] = []
                for i in range(first, min(first + 256, len(n))):
                    data = np.frombuffer(ids[i].as_py(), dtype=f"<u{width[i]}").astype("<u4").tobytes()
                    start = 0
                    while start < n[i]:
                        sequence, offset = divmod(place[i] + start, length)
                        size = min(length - offset, n[i] - start)
                        out.append((i, start, size, n[i], sequence, offset, data[4 * start:4 * (start + size)]))
                        start += size
                at, *rest = zip(*out)
                kinds = (*[pa.int64()] * 5, pa.binary())
                yield pa.record_batch(
                    [part.column("id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(
        cut, f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    ).withColumnRenamed("id", id_col)
