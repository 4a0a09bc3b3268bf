"""Ranked lexical search: the best documents of every item of a query table, by
branch and bound on a document FP-tree.

A first pass cuts every text into terms and writes, for each document, its
number of terms and the numbers of the terms that any item asks for.  Corpus
counts (documents, terms, documents of each asked term) come from that table by
ordinary aggregates.

In the second pass each task takes its documents in blocks.  For an item, a
document's vector is restricted to the item's terms in order of document
frequency; vectors put into a tree share the paths of their frequent terms.  The
tree is kept as its depth-first listing: documents sorted by their vectors, where
a subtree is a run of documents.  A subtree's greatest term numbers and least
length weight ``m`` bound the scores below it.  The search goes depth first, best
bound first, and leaves out subtrees that cannot reach the item's tenth best
document so far; small subtrees are scored.  The tenth best carries over from
block to block of a task.  What leaves a task is at most the best documents of
each item, and one window over these ends the search.

Items are taken in groups of about ``ITEM_BYTES`` of text, one after the other,
each against all documents, so neither the asked terms nor the items grow a
task.  Workers read them from the shared folder.

Defined cases: null and empty texts have no terms; items without known terms get
no rows, documents without terms count for nothing.  Every row of either table
stands for itself, so repeated rows get ranks of their own; null doc_ids come
last among equal scores, and null item_ids are answered like others.  Other
columns are ignored, and an empty table on either side gives an empty result.  A
very long text is cut into terms as a whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batches
from .common import python_ready, text_or_empty, written
from .files import opened as opened_files

#: Bytes of a term, after lower-casing: ASCII letters and digits, and all others beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
#: Item text of a group of items, about.
ITEM_BYTES = 16 << 20
#: Documents of a block, at most, and cells of a block's table of one item, about.
BLOCK_DOCS, BLOCK_CELLS = 16_384, 4_000_000
#: Subtrees of fewer documents are scored as a whole.
SMALL = 256
#: Stands for a null doc_id inside a task; larger than any id.
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, only A-Z lower-cased."""
    return TERM.findall(text.lower())


def weight(n_docs: int, df: int) -> int:
    """w of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def parts_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Asked:
    """The items of a group: their keys and terms (numbers into ``terms``, the
    sorted distinct terms of the group)."""

    def __init__(self, path: str, group: int):
        files, at = opened_files(path)
        t = pq.read_table(at, filesystem=files, columns=["item", "terms", "grp"], filters=[("grp", "=", group)],
                          partitioning=None)
        items = sorted(zip(t.column("item").to_pylist(), t.column("terms").to_pylist()))
        self.terms = sorted({x for _, terms in items for x in terms})
        self.number = {x: i for i, x in enumerate(self.terms)}
        self.items = [(item, np.array([self.number[x] for x in terms], dtype=np.int64)) for item, terms in items]


_ASKED: dict[tuple[str, int], Asked] = {}


def _asked(path: str, group: int) -> Asked:
    """A group of items, read once per Python worker; one is held."""
    if (path, group) not in _ASKED:
        _ASKED.clear()
        _ASKED[path, group] = Asked(path, group)
    return _ASKED[path, group]


class Best:
    """The best documents of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """The score below which no document is needed any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_tree(tf: np.ndarray, m: np.ndarray, ids: np.ndarray, w: np.ndarray, best: Best) -> int:
    """Take into ``best`` what belongs there of documents with the term numbers
    ``tf`` (documents x terms, frequent terms first), ``m`` and ``ids``.  Returns
    how many documents were scored."""
    # The depth-first listing of the tree: vectors in order, a held term before a missing one.
    held = tf > 0
    bits = np.packbits(~held, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(">u8")
    order = np.lexsort(bits.T[::-1])
    tf, m, ids, held = tf[order], m[order], ids[order], held[order]
    n_terms = tf.shape[1]
    scored = 0
    stack = [(None, 0, len(m), -1)]        # bound, run of documents, last term of the path
    while stack:
        bound, lo, hi, at = stack.pop()
        if bound is not None and bound < best.least:
            continue
        if hi - lo <= SMALL:
            best.add((w * parts_of_score(tf[lo:hi], m[lo:hi, None])).sum(axis=1), ids[lo:hi])
            scored += hi - lo
            continue
        # The children: runs of the same next term; those without one end here.
        rest = held[lo:hi, at + 1:]
        following = np.where(rest.any(axis=1), rest.argmax(axis=1) + at + 1, n_terms) if rest.shape[1] \
            else np.full(hi - lo, n_terms)
        starts = np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1])
        bounds = (w * parts_of_score(np.maximum.reduceat(tf[lo:hi], starts, axis=0),
                                     np.minimum.reduceat(m[lo:hi], starts)[:, None])).sum(axis=1)
        ends = np.append(starts[1:], hi - lo)
        for c in np.argsort(bounds, kind="stable").tolist():       # the best is popped first
            s, e, term = lo + int(starts[c]), lo + int(ends[c]), int(following[starts[c]])
            if bounds[c] < best.least:
                continue
            if term < n_terms:
                stack.append((int(bounds[c]), s, e, term))
                continue
            for x in range(s, e, SMALL):       # equal vectors, ended
                stack.append((int(bounds[c]), x, min(x + SMALL, e), n_terms))
    return scored


class Block:
    """Documents with their asked terms, by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 n_docs: int, n_terms: int):
        self.ids, self.m = ids, 10 + (90 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.terms, self.doc, self.tf = terms[order], doc[order], tfs[order]

    def search(self, terms: np.ndarray, w: np.ndarray, best: Best) -> None:
        """One item's terms (frequent ones first) and their weights."""
        lo, hi = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, side="right")
        docs = [self.doc[a:b] for a, b in zip(lo, hi)]
        some = np.unique(np.concatenate(docs)) if docs else np.zeros(0, dtype=np.int64)
        step = max(SMALL, BLOCK_CELLS // max(1, len(terms)))
        for s in range(0, len(some), step):
            part = some[s:s + step]
            tf = np.zeros((len(part), len(terms)), dtype=np.int64)
            for i, (a, d) in enumerate(zip(lo, docs)):
                x, y = np.searchsorted(d, part[0]), np.searchsorted(d, part[-1], side="right")
                tf[np.searchsorted(part, d[x:y]), i] = self.tf[a + x:a + y]
            search_tree(tf, self.m[part], self.ids[part], w, best)


def _vectors(rows: DataFrame, path: str, group: int) -> DataFrame:
    """id, n, and the numbers and counts of the terms that the group asks for."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _asked(path, group).number
        for batch in parts:
            for run, _ in batches.runs(batch.select(["id", "text"]), "text"):
                n, keys = [], []
                for i, text in enumerate(run.column("text").cast(pa.binary()).to_pylist()):
                    terms = terms_of(text)
                    n.append(len(terms))
                    keys += [(i << 32) | t for t in map(number.get, terms) if t is not None]
                keys, tf = np.unique(np.array(keys, dtype=np.int64), return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(n) + 1, dtype=np.int64) << 32).astype(np.int32)
                terms = pa.ListArray.from_arrays(ends, pa.array((keys & 0xFFFFFFFF).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))
                yield pa.record_batch([run.column("id"), pa.array(n, pa.int64()), terms, tfs],
                                      names=["id", "n", "terms", "tfs"])

    return rows.mapInArrow(cut, "id long, n long, terms array<int>, tfs array<long>")


def _searched(vectors: DataFrame, path: str, group: int, df_path: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents of each item."""
    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _asked(path, group)
        files, at = opened_files(df_path)
        t = pq.read_table(at, filesystem=files, columns=["term", "df"], partitioning=None)
        df = np.zeros(len(asked.terms), dtype=np.int64)
        df[t.column("term").to_numpy()] = t.column("df").to_numpy()
        w = np.array([weight(n_docs, d) for d in df.tolist()], dtype=np.int64)
        # Frequent terms first; terms that no document holds count for nothing.
        items = [(item, terms[np.lexsort((terms, -df[terms]))]) for item, terms in asked.items]
        items = [(item, terms[df[terms] > 0], Best(k)) for item, terms in items]
        for batch in parts:
            for s in range(0, batch.num_rows, BLOCK_DOCS):
                rows = batch.slice(s, BLOCK_DOCS)
                terms, tfs = rows.column("terms"), rows.column("tfs")
                block = Block(rows.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False),
                              rows.column("n").to_numpy(), terms.offsets.to_numpy(), terms.flatten().to_numpy(),
                              tfs.flatten().to_numpy(), n_docs, n_terms)
                for _, asked_terms, best in items:
                    block.search(asked_terms, w[asked_terms], best)
        for item, _, best in items:
            if len(best.ids):
                yield pa.record_batch(
                    [pa.array([item] * len(best.ids), pa.int64()),
                     pa.array(best.ids, mask=best.ids == _NO_ID), pa.array(best.scores)],
                    names=["item", "id", "score"])

    return vectors.filter("size(terms) > 0").mapInArrow(search, "item long, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its ``k`` best documents: the item's id, rank (from 1), the
    document's id and score, best first, equal scores by ascending id."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    given = items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text).alias("text"))
    n_bytes = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, -(-n_bytes // ITEM_BYTES))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))],
                                  names=["item_id", "terms"])

    item_type = given.schema["item_id"].dataType.simpleString()
    asked = (given.mapInArrow(cut, f"item_id {item_type}, terms array<binary>")
             .withColumn("item", F.monotonically_increasing_id())
             .withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(n_groups)).cast("int")))
    asked = written(asked, "items")
    path = asked.inputFiles()[0].rsplit("/", 1)[0]
    found = None
    for group in range(n_groups):
        vectors = written(_vectors(rows, path, group), "vectors")
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        df = written(vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count(F.lit(1)).alias("df")), "term-counts")
        df_path = (df.inputFiles() or [""])[0].rsplit("/", 1)[0]
        if n_docs and df_path:
            one = _searched(vectors, path, group, df_path, n_docs, n_terms, k)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # At most k rows an item.
    return top.join(asked.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
