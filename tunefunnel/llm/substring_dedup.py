"""Substring deduplication by minimiser filtering and window-hash counts.

Words are the runs between ASCII white space, unchanged.  A window is ``WINDOW``
consecutive words of one document, and every word covered by a window whose word
sequence also starts anywhere else, in the same document too, is removed.

Index: the text is its own reference.  It is cut into blocks by content: of the
``GRAM``-word sequences of each window, the one with the least hash is the
window's block, so equal windows have equal blocks, wherever they stand.  All
blocks of all documents are counted; those that occur more than once form the
index, a Bloom filter of at most ``repeats.MAX_FILTER_BITS``.

Filter and count: no relative parse is done, no match is extended and no
reference position is held.  A window whose block is not in the index cannot
repeat and is dropped; every other window is a candidate, and counts as repeated
when its hash occurs twice among all candidates.  A task first adds up its own
windows and hands on one place for each distinct one, so a passage that a third
of all documents share leaves each task as a few rows; these are sorted by hash
and neighbours compared in a stream.  The window hash has 64 bits; among ``n``
candidate windows an unrepeated one is taken for a repeat with a chance of about
``n / 2**64``.

Places are 64-bit numbers (document segment, word in the segment), so the two
shuffles move 16 bytes a window, and texts shuffle only where words go.

Defined cases: null text has no words; documents shorter than a window stay;
rows are told apart by doc_id and text, so rows that repeat both are judged as
two documents with the same words removed; null doc_ids are ordinary values;
other columns, whatever their names, are carried; an empty table gives an empty
result; a text of which nothing is removed is unchanged, one of which all is
removed is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, repeats
from .common import python_ready, written

#: Words of a window and of a block's gram.
WINDOW, GRAM = 35, 16
#: Bits of a place that number the words of a document segment, and of the
#: segment number that number the segments of a task.
WORD_BITS, SEGMENT_BITS = 20, 24
#: Filter bits for each repeated block.
BITS_PER_BLOCK = 32
#: Candidate windows that a task adds up before it hands them on, and rows of a
#: batch in which it does so: Spark holds a batch whole, outside its heap.
COMBINE_ROWS, BATCH_ROWS = 1 << 20, 1 << 16

_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` words, by doubling."""
    out, done, have, width = None, 0, words, 1
    while True:
        if size & width:
            n = len(words) - (done + width) + 1
            out = have[:n] if out is None else out[:n] + _power(done) * have[done:done + n]
            done += width
        if done == size:
            return _mixed(out)
        n = len(have) - width
        have = have[:n] + _power(width) * have[width:]
        width *= 2


def _leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the leftmost least value of each run of ``size`` values."""
    least, at = values, np.arange(len(values))
    out_least, out_at, done, width = None, None, 0, 1
    while True:
        if size & width:
            n = len(values) - (done + width) + 1
            if out_least is None:
                out_least, out_at = least[:n], at[:n]
            else:
                right = least[done:done + n] < out_least[:n]
                out_at = np.where(right, at[done:done + n], out_at[:n])
                out_least = np.where(right, least[done:done + n], out_least[:n])
            done += width
        if done == size:
            return out_at
        n = len(least) - width
        right = least[width:] < least[:n]
        least, at = np.where(right, least[width:], least[:n]), np.where(right, at[width:], at[:n])
        width *= 2


class Parsed:
    """The windows of a run of texts: their start among all words of the run,
    the place and hash of their block's gram, and their own hash."""

    def __init__(self, texts: list[str], window: int, gram: int, with_hash: bool):
        split = [t.encode("utf-8").split() for t in texts]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.first = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        self.start = self.block_at = np.zeros(0, dtype=np.int64)
        self.block = self.hash = np.zeros(0, dtype=np.uint64)
        if n < window:
            return
        words = np.fromiter((h for s in split for h in map(xxhash.xxh64_intdigest, s)), dtype=np.uint64, count=n)
        owner = np.repeat(np.arange(len(split)), lengths)
        inside = owner[:n - window + 1] == owner[window - 1:]
        self.start = np.flatnonzero(inside)
        self.owner = owner[self.start]
        grams = _grams(words, gram)
        self.block_at = _leftmost_least(grams, window - gram + 1)[self.start]
        self.block = grams[self.block_at]
        if with_hash:
            self.hash = _grams(words, window)[self.start]


def _blocks(window: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in batches.runs(part, "text"):
                p = Parsed(texts, window, gram, with_hash=False)
                if len(p.start):
                    new = np.concatenate([[True], p.block_at[1:] != p.block_at[:-1]])
                    block, n = np.unique(p.block[new], return_counts=True)
                    yield pa.record_batch([pa.array(block.view(np.int64)), pa.array(n.astype(np.int64))],
                                          names=["block", "n"])

    return run


def _filter_places(block: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit places of a block hash (unsigned)."""
    mask = np.uint64(n_bits - 1)
    return block & mask, (block >> np.uint64(32)) & mask


def block_index(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[bytes, int]:
    """The Bloom filter of all blocks that occur more than once in a column
    ``text``: its bits as bytes and their number, ``repeats.MAX_FILTER_BITS`` at
    most."""
    repeated = written(texts.select("text").mapInArrow(_blocks(window, gram), "block long, n long")
                       .groupBy("block").agg(F.sum("n").alias("n")).filter("n > 1").select("block"),
                       "repeated-blocks")
    n_bits = repeats.filter_bits(repeated.count(), BITS_PER_BLOCK)
    places = F.array(F.col("block").bitwiseAND(F.lit(n_bits - 1)),
                     F.shiftrightunsigned("block", 32).bitwiseAND(F.lit(n_bits - 1)))
    rows = repeats.bitmap(repeated.select(F.explode(places).alias("p")).distinct())
    out = bytearray(n_bits // 8)
    for bucket, bits in rows.toLocalIterator():
        out[bucket * 4096:bucket * 4096 + len(bits)] = bits
    return bytes(out), n_bits


def _parse(index, n_bits: int, window: int, gram: int, combine_rows: int):
    """The candidate windows of the documents.  Rows of three kinds: ``hash`` and ``place`` of one
    window of each distinct hash of the task, ``known`` where the task itself
    has seen it twice; ``place`` alone of the windows known to repeat; and the
    (segment, id, tag, base) of the documents that have candidates."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(index.value, dtype=np.uint8)
        segment = TaskContext.get().partitionId() << SEGMENT_BITS
        hashes, places, held = [], [], 0

        def batch(kind, known=None, hash=None, place=None, id=None, tag=None, base=None, n=0):
            empty = lambda t: pa.nulls(n, t)
            return pa.record_batch(
                [pa.array(np.full(n, kind, dtype=np.int32)),
                 empty(pa.bool_()) if known is None else pa.array(known),
                 empty(pa.int64()) if hash is None else pa.array(hash.view(np.int64)),
                 empty(pa.int64()) if place is None else pa.array(place),
                 empty(id_type) if id is None else id,
                 empty(pa.int64()) if tag is None else tag,
                 empty(pa.int64()) if base is None else pa.array(base)],
                names=["kind", "known", "hash", "place", "id", "tag", "base"])

        def handed_on():
            hash, place = np.concatenate(hashes), np.concatenate(places)
            hashes.clear()
            places.clear()
            by = np.argsort(hash, kind="stable")
            in_order = hash[by]
            start = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
            n = np.diff(start, append=len(by))
            # Of each window: whether it is the first of its hash, and whether there are more.
            first, twice = np.zeros(len(by), dtype=bool), np.empty(len(by), dtype=bool)
            first[by[start]] = True
            twice[by] = np.repeat(n > 1, n)
            del by, in_order, start, n
            # One kind after the other: readers of either skip the pages of the other.
            for kind, chosen in ((0, first), (1, twice)):
                for at in range(0, len(hash), BATCH_ROWS):
                    rows = slice(at, at + BATCH_ROWS)
                    here = chosen[rows]
                    n = int(here.sum())
                    if n and kind == 0:
                        yield batch(0, known=twice[rows][here], hash=hash[rows][here], place=place[rows][here], n=n)
                    elif n:
                        yield batch(1, place=place[rows][here], n=n)

        for part in parts:
            id_type = part.column("id").type
            for rows, texts in batches.runs(part, "text"):
                p = Parsed(texts, window, gram, with_hash=True)
                if not len(p.start):
                    continue
                a, b = _filter_places(p.block, n_bits)
                hit = np.ones(len(a), dtype=bool)
                for x in (a, b):
                    hit &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.any():
                    continue
                owner, word = p.owner[hit], p.start[hit] - p.first[p.owner[hit]]
                chunk = word >> WORD_BITS
                new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(chunk) != 0)])
                number = segment + np.cumsum(new) - 1
                segment = int(number[-1]) + 1
                of = pa.array(owner[new])
                yield batch(2, place=number[new], id=rows.column("id").take(of), tag=rows.column("tag").take(of),
                            base=chunk[new] << WORD_BITS, n=len(of))
                hashes.append(p.hash[hit])
                places.append((number << WORD_BITS) | (word & ((1 << WORD_BITS) - 1)))
                held += len(word)
                if held >= combine_rows:
                    yield from handed_on()
                    held = 0
        if held:
            yield from handed_on()

    return run


def _repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows whose hash stands more than once in rows sorted by hash,
    or is known to.  One row is carried from batch to batch."""
    last = None  # (hash, known, place, whether its place was given)
    for part in parts:
        hash, place = part.column("hash").to_numpy(), part.column("place").to_numpy()
        known = part.column("known").to_numpy(zero_copy_only=False)
        if not len(hash):
            continue
        same = hash[1:] == hash[:-1]
        out = known.copy()
        out[1:] |= same
        out[:-1] |= same
        given = place[out]
        if last is not None and last[0] == hash[0]:
            if not out[0]:
                given = np.append(given, place[0])
                out[0] = True
            if not last[2]:
                given = np.append(given, last[1])
        last = (hash[-1], place[-1], bool(out[-1]))
        if len(given):
            yield pa.record_batch([pa.array(given)], names=["place"])


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, first, last) of consecutive places in rows sorted by place."""
    first = last = None

    def batch(a, b):
        word = (1 << WORD_BITS) - 1
        a, b = np.asarray(a), np.asarray(b)
        return pa.record_batch([pa.array(a >> WORD_BITS), pa.array(a & word), pa.array(b & word)],
                               names=["segment", "first", "last"])

    for part in parts:
        place = part.column("place").to_numpy()
        if not len(place):
            continue
        if last is not None:
            place = np.concatenate([[first], [last], place])
        gap = (np.diff(place) > 1) | (np.diff(place >> WORD_BITS) != 0)
        if last is not None:
            gap[0] = False  # first and last of the run that is carried
        ends = np.flatnonzero(gap)
        starts = np.concatenate([[0], ends + 1])
        ends = np.concatenate([ends, [len(place) - 1]])
        if len(starts) > 1:
            yield batch(place[starts[:-1]], place[ends[:-1]])
        first, last = place[starts[-1]], place[ends[-1]]
    if last is not None:
        yield batch([first], [last])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   combine_rows: int = COMBINE_ROWS) -> DataFrame:
    """Per (id, tag) with repeated windows: ``spans``, the first and last start
    of each run of them, in words.  ``docs`` has id, tag and text (not null)."""
    spark = docs.sparkSession
    python_ready(spark)
    bits, n_bits = block_index(docs, window, gram)
    index = spark.sparkContext.broadcast(bits)
    id_type = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("known", T.BooleanType()),
        T.StructField("hash", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("id", id_type), T.StructField("tag", T.LongType()), T.StructField("base", T.LongType())])
    factors = written(docs.select("id", "tag", "text").mapInArrow(
        _parse(index, n_bits, window, gram, combine_rows), schema), "factors")
    met = (factors.filter("kind = 0").select("hash", "place", "known").repartition("hash")
           .sortWithinPartitions("hash").mapInArrow(_repeated, "place long"))
    own = factors.filter("kind = 1").select("place")
    runs = (met.unionByName(own).withColumn("segment", F.shiftright("place", WORD_BITS))
            .repartition("segment").sortWithinPartitions("place").select("place")
            .mapInArrow(_runs, "segment long, first long, last long"))
    segments = factors.filter("kind = 2").select(F.col("place").alias("segment"), "id", "tag", "base")
    return written(runs.join(segments, "segment")
                   .groupBy("id", "tag").agg(F.sort_array(F.collect_set(F.struct(
                       (F.col("base") + F.col("first")).alias("first"),
                       (F.col("base") + F.col("last")).alias("last")))).alias("spans")), "repeated-spans")


def _cut(window: int, text_at: int):
    """The kept words of each text, and how many words it had and lost."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.column("row")
            for start, end, texts in batches.text_runs(rows.field(text_at)):
                kept, n_words, n_removed = [], [], []
                for t, s in zip(texts, part.column("spans").slice(start, end - start).to_pylist()):
                    words = t.encode("utf-8").split()
                    n_words.append(len(words))
                    if s:
                        # Spans may overlap or touch; each covers its windows whole.
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, [x["first"] for x in s], 1)
                        np.add.at(edge, [x["last"] + window for x in s], -1)
                        words = [w for w, c in zip(words, np.cumsum(edge).tolist()) if c == 0]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(start, end - start), pa.array(kept, pa.string()),
                     pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    names=["row", "kept", "n_words", "n_removed"])

    return run


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
        text_col: str = "text", combine_rows: int = COMBINE_ROWS) -> DataFrame:
    """Per row: ``row`` (all its columns as a struct), ``kept`` (the words that
    stay, joined by one space), ``n_words`` and ``n_removed``."""
    names = docs.columns
    quoted = [docs[f"`{c}`"] for c in names]
    keyed = docs.select(
        F.struct(*quoted).alias("row"), docs[f"`{id_col}`"].alias("id"),
        F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))).alias("tag"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    spans = repeated_spans(keyed.select("id", "tag", text.alias("text")), window, gram, combine_rows)
    spans = spans.select(F.col("id").alias("s_id"), F.col("tag").alias("s_tag"),
                         F.xxhash64("id", "tag").alias("key"), "spans")
    n_bits = repeats.filter_bits(spans.count())
    flagged = repeats.tested(keyed.withColumn("key", F.xxhash64("id", "tag")), "key",
                             repeats.member_filter(spans, "key", n_bits), n_bits, "maybe")
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    whole = flagged.filter("not maybe").select("row", none.alias("spans"))
    met = flagged.filter("maybe").select("row", "id", "tag").join(
        spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left").select("row", "spans")
    schema = T.StructType([keyed.schema["row"], T.StructField("kept", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    step = _cut(window, names.index(text_col))
    return whole.mapInArrow(step, schema).unionByName(met.mapInArrow(step, schema))


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                 text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; where something
    is removed ``chars_col``, if there is one, counts the new text's characters."""
    out = cut(docs, window, gram, id_col, text_col)
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(value)
        elif c == chars_col:
            value = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
