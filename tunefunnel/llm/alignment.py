"""Alignment of two tokenizers' tokens over the same bytes, and the counts of
their linked id pairs.

Both tokenizers encode the same bytes (a blank and the text).  Pointer jumping
finds the groups: every token points to its farthest-right overlapping token, of
either side, and doubling the successors (``to = to[to]``, over all tokens of a
run of texts at once) converges to the terminal token of each connected piece,
which labels the group.  Tokens of one group link across the sides.

Corpus-wide counts of linked id pairs take two passes.  The first encodes,
aligns and writes the ids; each task also writes the distinct pairs of its
documents with their numbers of documents, so one row for each pair and task
shuffles, however often texts repeat.  The counts come from those rows; each
task's pairs get theirs back by one join, written as one folder for each task.
The second pass reads ids in place, aligns them again and reads the counts of
its part.  No document row shuffles and nothing is broadcast but the best count
of each id of the first vocabulary.

Defined cases: texts that are null, empty, or whose tokens' bytes are not a
blank and the text (those holding U+2581) have no tokens, zeros and no groups;
special strings are plain text; repeated rows and null ids are aligned row by
row, each row a document; other columns are ignored; an empty table gives an
empty result.  A group of very many tokens is counted by distinct ids, in slices.
A text is aligned as a whole, so a task's memory grows with its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, byte_pairs, sentence_pieces
from .caches import ByteCache
from .common import python_ready, text_or_empty, written
from .files import opened as opened_files
from .word_pieces import batched
from ..session import scratch_path

#: Links of groups that are expanded at once.
LINKS_AT_ONCE = 500_000
#: Characters of texts that are aligned at once.
RUN_BYTES = 384 << 10
#: Groups of more links are first reduced to distinct ids.
LARGE_GROUP = 4096
#: Distinct pairs that a task gathers before it adds them up, and that a row holds.
GATHERED, PAIRS_A_ROW = 500_000, 50_000
#: A blank between white space: words may reach over it.
_WIDE = re.compile(r"\s \s|  ")
#: Bytes of a generation of each side's cache.
_CACHE = 40 << 20


class Tokens:
    """The ids of two tokenizers and the bytes that they stand for: ``first`` a
    byte-level BPE file, ``second`` a merge-type sentencepiece file."""

    def __init__(self, first: str, second: str):
        self.a, self.b = byte_pairs.opened(first), sentence_pieces.opened(second)
        library = self.b.library
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        blank = sentence_pieces.BLANK
        self.b_bytes = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(blank, " ").encode("utf-8")
                        for i, p in enumerate(pieces)]
        self.blank_id = library.piece_to_id(blank)
        self.a_size = np.array(list(map(len, self.a.bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.n_b = len(pieces)
        self.words, self.chunks = ByteCache(_CACHE), ByteCache(_CACHE)

    def _know_words(self, new: list[str]) -> None:
        """Words of a blank and letters are words again when put together, so many
        go through the library at once; the others are encoded on their trie."""
        plain = [w for w in new if w[0] == " " and w[1:].isalpha() and byte_pairs.PLAIN.fullmatch(w)]
        for part in batched(plain):
            ids = np.array(self.a.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            held = _portions(ids, self.a_size, [len(w.encode("utf-8")) for w in part])
            if held is None:
                raise ValueError("the ids do not end where the words end")
            self.words.new.update(zip(part, held))
        for word, ids in self.a.encode_words(w.encode("utf-8") for w in set(new).difference(plain)):
            self.words.new[word.decode("utf-8")] = np.array(ids, dtype="<u4").tobytes()

    def _know_chunks(self, new: list[str]) -> None:
        """Chunks are chunks again when put together with blanks; those that hold
        blanks are asked alone.  None where the bytes differ."""
        blank, library = sentence_pieces.BLANK, self.b.library
        plain = [c for c in new if c and blank not in c]
        alone = list(set(new).difference(plain))
        for part in batched(plain):
            text = " ".join(part)
            ids = np.array(library.encode(text), dtype="<u4")
            held = _portions(ids, self.b_size, [1 + len(c.encode("utf-8")) for c in part])
            if held is None or b"".join([self.b_bytes[i] for i in ids.tolist()]) != (" " + text).encode("utf-8"):
                alone += part
            else:
                self.chunks.new.update(zip(part, held))
        # The library gives a chunk its first blank; a lone blank is not asked.
        for c, ids in zip(alone, library.encode([c.replace(blank, " ") for c in alone], num_threads=1)):
            ids = ids if c else [self.blank_id]
            same = b"".join([self.b_bytes[i] for i in ids]) == (" " + c.replace(blank, " ")).encode("utf-8")
            self.chunks.new[c] = np.array(ids, dtype="<u4").tobytes() if same else None

    def _words(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The first side's words of a chunk and the blank before it."""
        if chunk.isascii():
            # Letters, and letters before a mark, are the common cases.
            if chunk.isalpha():
                return (" " + chunk,)
            if chunk[:-1].isalpha() and not chunk[-1].isalnum() and not chunk[-1].isspace():
                return " " + chunk[:-1], chunk[-1]
        return self.a.text_words(" " + chunk, special=False)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids of both sides, as little-endian 32-bit bytes;
        both empty where the bytes differ.  A single blank between two strings
        that are not both white space there ends a word and a chunk, so such
        texts are cut at their blanks, and each distinct chunk of a run is cut
        into words once."""
        out = [(b"", b"")] * len(texts)
        blank = sentence_pieces.BLANK
        given = [i for i, t in enumerate(texts) if t and blank not in t]
        single = [i for i in given if texts[i][0] != " " and texts[i][-1] != " " and not _WIDE.search(texts[i])]
        other = sorted(set(given).difference(single))
        chunks, places, ends = batches.distinct(pc.split_pattern(
            pa.array([texts[i] for i in single], pa.large_string()), " "))
        words = list(map(self._words, chunks))
        other_words = [self.a.text_words(" " + texts[i], special=False) for i in other]
        other_chunks = [self.b.text_chunks(texts[i]) for i in other]
        self.words.turn()
        self._know_words(self.words.missing(set().union(*words, *other_words)))
        self.chunks.turn()
        self._know_chunks(self.chunks.missing(set(chunks).union(*other_chunks)))
        a_of, b_of = self.words.new.__getitem__, self.chunks.new.__getitem__
        firsts = [a_of(w[0]) if len(w) == 1 else b"".join(map(a_of, w)) for w in words]
        seconds = list(map(b_of, chunks))
        differ = np.array([x is None for x in seconds], dtype=np.int64)
        differs = np.diff(np.concatenate([[0], np.cumsum(differ[places])])[np.concatenate([[0], ends])]).tolist()
        for i, no, x, y in zip(single, differs, batches.put_together(firsts, places, ends),
                               batches.put_together([x or b"" for x in seconds], places, ends)):
            if not no:
                out[i] = x, y
        for i, w, c in zip(other, other_words, other_chunks):
            parts = list(map(b_of, c))
            if None not in parts:
                out[i] = b"".join(map(a_of, w)), b"".join(parts)
        return out


def _portions(ids: np.ndarray, sizes: np.ndarray, lengths: list[int]) -> list[bytes] | None:
    """The ids of strings put together, cut where the strings end by their bytes;
    None if an id stands across such an end."""
    ends, wanted = np.cumsum(sizes[ids]), np.cumsum(lengths)
    at = np.searchsorted(ends, wanted)
    if not len(ids) or at[-1] != len(ids) - 1 or not np.array_equal(ends[at], wanted):
        return None
    data, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
    return [data[s:e] for s, e in zip([0, *cuts[:-1]], cuts)]


_OPEN: dict[tuple[str, str], Tokens] = {}


def opened(first: str, second: str) -> Tokens:
    """Both vocabularies, once per Python worker."""
    if (first, second) not in _OPEN:
        _OPEN[first, second] = Tokens(first, second)
    return _OPEN[first, second]


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered from the left, from the
    end offsets of the tokens of two sides that cover the same bytes."""
    n, m = len(a_ends), len(b_ends)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # The token of the other side that holds a token's last byte overlaps it and
    # ends farthest right.  Where both end together, the second side's is last.
    over_a = np.searchsorted(b_ends, a_ends - 1, side="right")
    over_b = np.searchsorted(a_ends, b_ends - 1, side="right")
    own = np.arange(m) + n
    to = np.concatenate([over_a + n, np.where(a_ends[over_b] > b_ends, over_b, own)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    # Terminals are tokens of the second side whose end is a common one.
    number = np.cumsum(to[n:] == own) - 1
    return number[to[:n] - n], number[to[n:] - n]


class Aligned:
    """The groups and links of the documents of a run."""

    def __init__(self, tokens: Tokens, ids: list[tuple[bytes, bytes]]):
        self.tokens, self.n_docs = tokens, len(ids)
        self.a = np.frombuffer(b"".join([x for x, _ in ids]), dtype="<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join([y for _, y in ids]), dtype="<u4").astype(np.int64)
        self.n_a = np.array([len(x) // 4 for x, _ in ids], dtype=np.int64)
        self.n_b = np.array([len(y) // 4 for _, y in ids], dtype=np.int64)
        self.a_group, self.b_group = group_labels(np.cumsum(tokens.a_size[self.a]), np.cumsum(tokens.b_size[self.b]))
        n = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        self.in_a, self.in_b = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        doc = np.repeat(np.arange(self.n_docs), self.n_a)
        self.group_doc = doc[np.cumsum(self.in_a) - 1] if n else np.zeros(0, dtype=np.int64)
        self.n_groups = np.bincount(self.group_doc, minlength=self.n_docs)
        self.n_links = np.bincount(self.group_doc, weights=self.in_a * self.in_b, minlength=self.n_docs).astype(np.int64)

    def texts(self) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.a_group]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.b_group]
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # 0 a comma, 1 the bar after the last token of the first side, 2 the group's end.
        code[at_a], code[at_b] = 3 * self.a, 3 * self.b
        code[at_a[np.cumsum(self.in_a) - 1]] += 1
        code[at_b[np.cumsum(self.in_b) - 1]] += 2
        parts = _decimals(max(len(self.tokens.a_size), self.tokens.n_b))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), parts.take(pa.array(code)))
        return [t[:-1] for t in pc.binary_join(lists, pa.scalar("", pa.large_string())).to_pylist()]

    def digests(self) -> list[str]:
        """The SHA-256 of each document's groups; without tokens the empty text."""
        return [sha256(t.encode("ascii")).hexdigest() if t else "" for t in self.texts()]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair code, times) of all links, in portions.  A pair's code
        is a * n_b + b; a portion may hold a pair of a document again."""
        size = self.in_a * self.in_b
        a_start, b_start = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        large = np.flatnonzero(size > LARGE_GROUP)
        small = np.flatnonzero(size <= LARGE_GROUP)
        for start, end in batches.cuts(size[small], LINKS_AT_ONCE):
            g = small[start:end]
            # Every token of the first side in these groups, once for each token of the second.
            na, nb = self.in_a[g], self.in_b[g]
            at_a = np.repeat(a_start[g] - (np.cumsum(na) - na), na) + np.arange(na.sum())
            of = np.repeat(np.arange(len(g)), na)
            times = nb[of]
            first = np.cumsum(times) - times
            at_b = np.arange(times.sum()) - np.repeat(first - b_start[g][of], times)
            code = np.repeat(self.a[at_a], times) * self.tokens.n_b + self.b[at_b]
            yield np.repeat(self.group_doc[g][of], times), code, np.ones(len(code), dtype=np.int64)
        for g in large.tolist():
            a, ta = np.unique(self.a[a_start[g]:a_start[g] + self.in_a[g]], return_counts=True)
            b, tb = np.unique(self.b[b_start[g]:b_start[g] + self.in_b[g]], return_counts=True)
            step = max(1, LINKS_AT_ONCE // len(b))
            for s in range(0, len(a), step):
                code = (a[s:s + step, None] * self.tokens.n_b + b[None, :]).ravel()
                yield np.full(len(code), self.group_doc[g]), code, (ta[s:s + step, None] * tb[None, :]).ravel()

    def distinct(self) -> Iterator[np.ndarray]:
        """The distinct pairs of each document, documents after each other."""
        held: list[np.ndarray] = []
        for doc, code, _ in self.links():
            held.append(_unique((doc << 32) | code))
            if sum(map(len, held)) > GATHERED:
                held = [_unique(np.concatenate(held))]
        if held:
            yield (_unique(np.concatenate(held)) if len(held) > 1 else held[0]) & 0xFFFFFFFF


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum) of parts of (key, number)."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


_DECIMALS: dict[int, pa.Array] = {}


def _decimals(n: int) -> pa.Array:
    """Each id with each of the three marks after it."""
    if n not in _DECIMALS:
        _DECIMALS[n] = pa.array([f"{i}{mark}" for i in range(n) for mark in ",|;"], pa.large_string())
    return _DECIMALS[n]


class Alignment:
    """Aligned documents and the counts of their linked pairs.

    ``documents`` holds per row: the id, ``a_ids``, ``b_ids`` (32-bit
    little-endian), n_a, n_b, n_groups, n_links and ``groups_sha256``;
    ``pairs`` the table (a, b, n_docs, best) of all linked id pairs."""

    def __init__(self, docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text"):
        python_ready(docs.sparkSession)
        self.first, self.second, self.id_col = first, second, id_col
        rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
        self.id_type = rows.schema["id"].dataType.simpleString()
        aligned = rows.mapInArrow(self._encode(), f"id {self.id_type}, a_ids binary, b_ids binary, n_a long, n_b long, "
                                  "n_groups long, n_links long, groups_sha256 string, part long, pairs array<long>, docs array<long>")
        self.written = written(aligned, "aligned")
        self.documents = self.written.filter("pairs is null").drop("pairs", "docs")
        asked = self.written.filter("pairs is not null").select(
            "part", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("part", "p.pairs", "p.docs")
        n_b = opened(first, second).n_b
        counts = written(asked.groupBy("pairs").agg(F.sum("docs").alias("n_docs")), "pair-counts")
        of_a = counts.withColumn("a", F.expr(f"pairs div {n_b}"))
        # One row for each id of the first vocabulary.
        best = of_a.groupBy("a").agg(F.max("n_docs").alias("most"))
        marked = of_a.join(F.broadcast(best), "a").withColumn("best", F.col("n_docs") == F.col("most"))
        self.pairs = marked.select("a", (F.col("pairs") % n_b).alias("b"), "n_docs", "best")
        self.replies = scratch_path(docs.sparkSession, "pair-replies")
        told = asked.select("part", "pairs").join(marked.select("pairs", "n_docs", "best"), "pairs")
        told.repartition("part").sortWithinPartitions("part", "pairs").write.partitionBy("part").parquet(self.replies)

    def _encode(self):
        first, second = self.first, self.second
        names = ["id", "a_ids", "b_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "part", "pairs", "docs"]

        def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = opened(first, second)
            part = TaskContext.get().partitionId()
            gathered: list = []
            id_type = None
            for batch in parts:
                id_type = batch.schema.field("id").type
                for run, texts in batches.runs(batch, "text"):
                    encoded = tokens.encode(texts)
                    for s, e in batches.by_bytes(texts, RUN_BYTES):
                        n, ids = e - s, encoded[s:e]
                        found = Aligned(tokens, ids)
                        for pairs in found.distinct():
                            gathered.append(_added([(pairs, np.ones(len(pairs), dtype=np.int64))]))
                        if sum(len(g[0]) for g in gathered) > GATHERED:
                            gathered = [_added(gathered)]
                        yield pa.record_batch(
                            [run.column("id").slice(s, n), pa.array([x for x, _ in ids], pa.binary()),
                             pa.array([y for _, y in ids], pa.binary()), pa.array(found.n_a), pa.array(found.n_b),
                             pa.array(found.n_groups), pa.array(found.n_links), pa.array(found.digests(), pa.string()),
                             pa.array([part] * n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
                             pa.nulls(n, pa.list_(pa.int64()))], names=names)
            keys, n = _added(gathered) if gathered else (np.zeros(0, dtype=np.int64),) * 2
            for s in range(0, len(keys), PAIRS_A_ROW):
                k, d = keys[s:s + PAIRS_A_ROW], n[s:s + PAIRS_A_ROW]
                zero = pa.array([0], pa.int64())
                yield pa.record_batch(
                    [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), zero, zero, zero, zero,
                     pa.nulls(1, pa.string()), pa.array([part], pa.int64()), pa.array([k], pa.list_(pa.int64())),
                     pa.array([d], pa.list_(pa.int64()))], names=names)

        return encode

    def scored(self) -> DataFrame:
        """``documents`` without the ids, with ``n_best`` (links whose pair is
        the most frequent one of its first id) and ``count_sum``."""
        first, second, replies = self.first, self.second, self.replies
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = opened(first, second)
            held, counts = None, None
            for batch in parts:
                of = np.asarray(batch.column("part"))
                sizes = np.asarray(batch.column("n_links")) + 1
                # Rows of one part stand together; cut there, and by links.
                cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else [0, 0]
                for s, e in zip(cut[:-1], cut[1:]):
                    if e > s and held != of[s]:
                        held, counts = int(of[s]), _replies(replies, int(of[s]))
                    for x, y in batches.cuts(sizes[s:e], LINKS_AT_ONCE):
                        rows = batch.slice(s + x, y - x)
                        a, b = rows.column("a_ids").to_pylist(), rows.column("b_ids").to_pylist()
                        best, total = _sums(Aligned(tokens, list(zip(a, b))), counts)
                        yield pa.record_batch([*(rows.column(c) for c in names), pa.array(best), pa.array(total)],
                                              names=[*names, "n_best", "count_sum"])

        out = self.documents.mapInArrow(score, f"id {self.id_type}, n_a long, n_b long, n_groups long, n_links long, "
                                        "groups_sha256 string, n_best long, count_sum long")
        return out.withColumnRenamed("id", self.id_col)


def _replies(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a part, sorted, their numbers of documents and best marks."""
    files, path = opened_files(f"{folder}/part={part}")
    info = files.get_file_info(path)
    if info.type.name == "NotFound":       # no document of the part has tokens
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
    t = pq.read_table(path, filesystem=files, columns=["pairs", "n_docs", "best"], partitioning=None)
    pairs = t.column("pairs").to_numpy()
    order = np.argsort(pairs, kind="stable")
    return pairs[order], t.column("n_docs").to_numpy()[order], t.column("best").to_numpy()[order]


def _sums(found: Aligned, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of each document."""
    best, total = np.zeros(found.n_docs, dtype=np.int64), np.zeros(found.n_docs, dtype=np.int64)
    for doc, code, times in found.links():
        at = np.searchsorted(counts[0], code)
        if len(code) and (at[-1] >= len(counts[0]) or not np.array_equal(counts[0][at], code)):
            raise ValueError("a linked pair has no count")
        np.add.at(best, doc, times * counts[2][at])
        np.add.at(total, doc, times * counts[1][at])
    return best, total
