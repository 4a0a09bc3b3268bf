"""Stage-1 retrieval: exact top-N by dot product for every user at once
(M-03, M-05, M-06, J-09, J-10, L-07, P-12).

Plan
----
* Rows are never paired.  Users are hashed into groups and, where there are few of
  them, items into ranges; one task takes a (group, range).  It receives its users
  and their seen items, then reads the items, which are written once in order of the
  length of their vectors, longest first, from the shared folder, some at a time.  It
  holds its users' best rows and a piece of the items, never all items, and no item
  is copied for a group.
* There are as many (group, range) tasks as the session runs at once, and more only
  where a group would hold more than ``user_block`` users.  Only best rows leave a
  task, and they are merged per user only where there are several ranges.
* No score of a user exceeds the user's length times that of the longest item to
  come, so a user whose k-th score is above that bound is done.
* Pieces are multiplied in single precision.  An item whose rough score is below the
  user's k-th score by more than the rounding can make up is dropped; the others
  are scored in double precision and held until there are enough to select from.
* Ties are broken by item id ascending; the selection is exact even with ties
  at the cut-off (no candidate cap), and a bound equal to the k-th score still
  counts as reached.
* Already-seen items (J-10) go to their user's group and are masked there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector_table as VT
from ..session import shared_copy, ship_package, written_copy

USER = "user_id"
ITEM = "item_id"
USER_BLOCK = 32768      # users of a group, about
ITEM_BLOCK = 131072     # items of a block, about
FIRST_CHUNK = 1024      # item columns scored first; then twice as many, up to ITEM_CHUNK
ITEM_CHUNK = 8192       # item columns scored at once inside a task
USER_CHUNK = 256        # user rows scored at once inside a task
PAIR_CHUNK = 1 << 15    # pairs scored at once in double precision
HELD_PAIRS = 1 << 16    # scored pairs held before the best are selected, at least
MERGE_CELLS = 1 << 18   # scores that are selected from at once
BOUND_SLACK = 1 + 1e-9  # for the rounding of lengths and scores

_BEST = "user_id long, item_id long, score double, rank int"
_REPORT = "block int, n_items long, max_length double, n_scored long"


def _select_topk(rows, scores, ids, k):
    """Exact per-row top-k by (score desc, id asc) from flat candidate arrays;
    the kept (rows, scores, ids) come sorted by row, then rank."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], scores[keep], ids[keep]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of every place in the spans [lo, hi)."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + lo[owner]


class _Group:
    """The best ``k`` items of a group's users, as items come longest first.  Rows
    of one user share a list."""

    def __init__(self, users: np.ndarray, lengths: np.ndarray, vectors: np.ndarray, seen: tuple, k: int):
        order = np.argsort(users, kind="stable")
        self.k, self.length, self.vectors = k, lengths[order], vectors[order].astype(np.float64)
        self.users, self.of = np.unique(users[order], return_inverse=True)
        self.score = np.full((len(self.users), k), -np.inf)
        self.item = np.zeros((len(self.users), k), dtype=np.int64)
        self.least = np.full(len(self.users), -np.inf)      # k-th score, as selected last
        self.pairs, self.n_pairs = [], 0                    # scored since then
        self.scores = np.empty(0)
        self.hits = np.zeros(0, dtype=bool)
        by, items = seen
        at = np.minimum(np.searchsorted(self.users, by), max(len(self.users) - 1, 0))
        here = self.users[at] == by if len(self.users) else np.zeros(len(by), dtype=bool)
        at, items = at[here], items[here]
        order = np.argsort(items, kind="stable")
        self.seen_item, self.seen_by = items[order], at[order]

    def reached(self, longest: float, kth: np.ndarray) -> np.ndarray:
        """The rows that an item of this length may still serve."""
        return np.flatnonzero(self.length * longest * BOUND_SLACK >= kth[self.of])

    def kth(self) -> np.ndarray:
        self.select()
        return self.least.copy()

    def _masked(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, column) of the seen items among these, by list; of an item that is
        there several times, one row is masked."""
        if not len(self.seen_item):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        once = np.unique(ids, return_index=True)[1]
        column, place = _spans(np.searchsorted(self.seen_item, ids[once], side="left"),
                               np.searchsorted(self.seen_item, ids[once], side="right"))
        order = np.argsort(self.seen_by[place], kind="stable")
        return self.seen_by[place][order], once[column][order]

    def _hits(self, scores: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Flat places of the scores that are not below their row's bound."""
        n = scores.size
        hits = self.hits[:n].reshape(scores.shape)
        np.greater_equal(scores, low[:, None], out=hits)
        self.hits[n:-(-n // 8) * 8] = False
        eights = np.flatnonzero(self.hits[:-(-n // 8) * 8].view(np.uint64))
        flat = (eights[:, None] * 8 + np.arange(8)[None, :]).ravel()
        return flat[self.hits[flat]]

    def add(self, rows: np.ndarray, ids: np.ndarray, items: np.ndarray, longest: float) -> None:
        """Score the rows against a piece of the items."""
        peak = float(self.length[rows].max(initial=0.0)) * longest
        kind = np.float32 if peak < 1e30 else np.float64
        d = items.shape[1]
        # the rounding of a sum of d products, of its inputs, and of the least numbers
        relative, least = (d + 8) * 2.0 * np.finfo(kind).eps, (d + 8) * float(np.finfo(kind).tiny)
        rough = np.ascontiguousarray(items, dtype=kind).T
        by, column = self._masked(ids)
        room = min(USER_CHUNK, len(rows)) * len(ids)
        if self.scores.dtype != kind or len(self.scores) < room:
            self.scores, self.hits = np.empty(room, dtype=kind), np.zeros(room + 8, dtype=bool)
        for start in range(0, len(rows), USER_CHUNK):
            r = rows[start:start + USER_CHUNK]
            of = self.of[r]
            scores = self.scores[:len(r) * len(ids)].reshape(len(r), len(ids))
            np.matmul(self.vectors[r].astype(kind), rough, out=scores)
            if len(by):
                masked, place = _spans(np.searchsorted(by, of, side="left"), np.searchsorted(by, of, side="right"))
                scores[masked, column[place]] = -np.inf
            margin = self.length[r] * longest * relative + least
            kth = self.least[of]
            low = kth - margin
            short = np.flatnonzero(kth == -np.inf)
            if len(short) and self.k < len(ids):
                # a row keeps at least its k best of the piece, ties included
                own = np.partition(scores[short], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                low[short] = own.astype(np.float64) - 2 * margin[short]
            low = np.nextafter(low.astype(kind), kind(-np.inf))
            i, j = np.divmod(self._hits(scores, low), len(ids))
            open_ = scores[i, j] > -np.inf
            self._score(r, of, i[open_], j[open_], ids, items, kth)

    def _score(self, r, of, i, j, ids, items, kth) -> None:
        for a in range(0, len(i), PAIR_CHUNK):
            p, q = i[a:a + PAIR_CHUNK], j[a:a + PAIR_CHUNK]
            exact = np.einsum("ij,ij->i", self.vectors[r[p]], items[q].astype(np.float64))
            good = (exact >= kth[p]) & (exact > -np.inf)
            self.pairs.append((of[p[good]], exact[good], ids[q[good]]))
            self.n_pairs += int(good.sum())
        if self.n_pairs > max(HELD_PAIRS, len(self.users) * self.k // 2):
            self.select()

    def select(self) -> None:
        """Keep each list's best ``k`` of what it holds and what was scored since."""
        if not self.n_pairs:
            self.pairs = []
            return
        lists, scores, items = (np.concatenate(x) for x in zip(*self.pairs))
        self.pairs, self.n_pairs = [], 0
        order = np.argsort(lists, kind="stable")
        lists, scores, items = lists[order], scores[order], items[order]
        touched, first, n = np.unique(lists, return_index=True, return_counts=True)
        by_size = np.argsort(n, kind="stable")
        at = 0
        while at < len(by_size):
            cells = (n[by_size[at:at + MERGE_CELLS]] + self.k) * np.arange(1, min(MERGE_CELLS, len(by_size) - at) + 1)
            part = by_size[at:at + max(1, int(np.searchsorted(cells, MERGE_CELLS, side="right")))]
            at += len(part)
            owner, place = _spans(first[part], first[part] + n[part])
            held = np.full((len(part), self.k + int(n[part[-1]])), -np.inf)
            found = np.zeros(held.shape, dtype=np.int64)
            held[:, :self.k], found[:, :self.k] = self.score[touched[part]], self.item[touched[part]]
            column = self.k + place - first[part][owner]
            held[owner, column], found[owner, column] = scores[place], items[place]
            cut = held.shape[1] - self.k
            kth = np.partition(held, cut, axis=1)[:, cut]
            keep = (held >= kth[:, None]) & (held > -np.inf)
            tied = np.flatnonzero(keep.sum(axis=1) > self.k)
            row, column = np.nonzero(keep)
            best, ids = held[row, column], found[row, column]
            if len(tied):                      # more than k: the least ids of the k-th score stay
                row, best, ids = _select_topk(row, best, ids, self.k)
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            score, item = np.full((len(part), self.k), -np.inf), np.zeros((len(part), self.k), dtype=np.int64)
            score[row, place], item[row, place] = best, ids
            self.score[touched[part]], self.item[touched[part]] = score, item
            self.least[touched[part]] = score.min(axis=1)

    def best(self) -> Iterator[dict]:
        """Best rows, some users at a time."""
        self.select()
        for start in range(0, len(self.users), 2048):
            score, item = self.score[start:start + 2048], self.item[start:start + 2048]
            order = np.lexsort((item, -score), axis=-1)
            score, item = np.take_along_axis(score, order, axis=1), np.take_along_axis(item, order, axis=1)
            user, place = np.nonzero(score > -np.inf)
            yield {USER: self.users[start:start + 2048][user], ITEM: item[user, place],
                   "score": score[user, place], "rank": (place + 1).astype(np.int32)}


def _starts_wave(block: int) -> bool:
    """Blocks come in waves of 1, 1, 2, 4, ... blocks."""
    return block & (block - 1) == 0


def _scored(table: VT.VectorTable, parts: int, k: int, item_block: int, with_report: bool):
    """Best rows of a task's users, which come before their seen items, over its range
    of the written items.  With a report, the rows in reach are found at the start of
    each wave of blocks, and each block's rows follow; else before each piece."""
    names = [*(f.split()[0] for f in _BEST.split(", ")), *(f.split()[0] for f in _REPORT.split(", "))]

    def frame(columns: dict) -> pa.RecordBatch:
        types = {"rank": pa.int32(), "block": pa.int32(), "score": pa.float64(), "max_length": pa.float64()}
        n = len(next(iter(columns.values())))
        asked = names if with_report else names[:4]
        return pa.record_batch([pa.array(columns[c], types.get(c, pa.int64())) if c in columns
                                else pa.nulls(n, types.get(c, pa.int64())) for c in asked], names=asked)

    def pieces(task: int) -> Iterator[tuple]:
        """(ids, lengths, vectors) of the task's items, cut at blocks with a report."""
        held, n, size, place = [], 0, min(FIRST_CHUNK, item_block), 0
        for ids, vectors, lengths, part in table.pieces("length", "part"):
            if parts > 1:
                mine = part == task % parts
                ids, vectors, lengths = ids[mine], vectors[mine], lengths[mine]
            held.append((ids, lengths, vectors))
            n += len(ids)
            if n < size:
                continue
            joined, at = [np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held)], 0
            while n - at >= size:
                yield [x[at:at + size] for x in joined]
                at, place = at + size, place + size
                size = min(place, ITEM_CHUNK, item_block)
                size = min(size, item_block - place % item_block) if with_report else size
            held, n = [tuple(x[at:] for x in joined)], n - at
        if n:
            yield [np.concatenate(x) for x in zip(*held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        users, seen, kth, place, report, task = [], [], None, 0, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("_task")[0].as_py()
            kinds = batch.column("_kind").to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                part = batch.slice(0, cut)
                users.append((part.column(USER).to_numpy(), -part.column("_shorter").to_numpy(), VT.matrix(part.column("features"))))
            if cut < batch.num_rows:
                part = batch.slice(cut)
                seen.append((part.column(USER).to_numpy(), part.column(ITEM).to_numpy()))
        if not users and not with_report:
            return
        joined = [np.concatenate(x) for x in zip(*users)] if users else [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, 1))]
        pairs = [np.concatenate(x) for x in zip(*seen)] if seen else [np.zeros(0, dtype=np.int64)] * 2
        group = _Group(*joined, tuple(pairs), k)
        del users, seen, joined, pairs
        for ids, lengths, vectors in pieces(task or 0):
            block, first = divmod(place, item_block)
            if with_report and first == 0:
                if _starts_wave(block):
                    kth = group.kth()
                rows = group.reached(lengths[0], kth)
                report.append([block, 0, lengths[0], len(rows)])
            elif not with_report:
                rows = group.reached(lengths[0], group.least)
                if not len(rows):              # nor will a shorter item serve any
                    break
            if with_report:
                report[-1][1] += len(ids)
            if len(rows):
                group.add(rows, ids, vectors, lengths[0])
            place += len(ids)
        for columns in group.best():
            yield frame(columns)
        if report:
            yield frame(dict(zip(names[4:], map(list, zip(*report)))))

    return run


def _length(features):
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _shape(n_users: int, n_items: int, k: int, slots: int, item_block: int, user_block: int, ranges: bool) -> tuple[int, int]:
    """(user groups, item ranges): at least ``slots`` tasks, whole waves of them; an
    item's copy is about eight times a best row."""
    least, most = -(-n_users // user_block), max(1, n_users)
    least = -(-least // slots) * slots if least > slots else least
    if not ranges:
        return min(most, max(slots, least)), 1
    groups = math.ceil(math.sqrt(slots * n_users * k / (8 * max(1, n_items))))
    groups = min(most, max(1, least, min(groups, slots)))
    parts = max(1, min(slots // groups, -(-n_items // item_block)))
    return min(most, max(groups, -(-slots // parts))), parts


def _dealt(users: DataFrame, seen: DataFrame | None, groups: int, parts: int) -> DataFrame:
    """The users of every (group, range) in one partition, then their seen items."""
    group = F.pmod(F.xxhash64(USER), F.lit(groups)).cast("int")
    vector = users.schema["features"].dataType.simpleString()
    rows = users.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        (group * parts + F.col("_part")).alias("_task"), F.lit(0).alias("_kind"), (-_length(F.col("features"))).alias("_shorter"),
        USER, F.lit(None).cast("long").alias(ITEM), "features")
    if seen is not None:
        rows = rows.unionByName(seen.dropna().select(
            (group * parts + _range(parts)).alias("_task"), F.lit(1).alias("_kind"), F.lit(0.0).alias("_shorter"), USER, ITEM,
            F.lit(None).cast(vector).alias("features")))
    return rows.repartitionById(groups * parts, "_task").sortWithinPartitions("_kind")


def _range(parts: int):
    return F.pmod(F.xxhash64(ITEM), F.lit(parts)).cast("int")


def _item_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = VT.byte_rows(VT.matrix(batch.column("features")))
            yield pa.record_batch([batch.column(ITEM), batch.column("length"), batch.column("part"), vectors],
                                  names=["item_id", "length", "part", "vector"])


def _written_items(items: DataFrame, parts: int) -> VT.VectorTable:
    """The items in single precision, longest first, ties by id."""
    rows = items.select(ITEM, _length(F.col("features")).alias("length"), _range(parts).alias("part"),
                        F.col("features").cast("array<float>").alias("features"))
    rows = rows.orderBy(F.desc("length"), ITEM).mapInArrow(_item_bytes, "item_id long, length double, part int, vector binary")
    return VT.VectorTable(written_copy(rows, "items"))


def _top(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None, item_block: int, user_block: int,
         with_report: bool):
    spark = users.sparkSession
    ship_package(spark)
    # read for their number and for the search
    users = shared_copy(users.select(F.col(USER).cast("long").alias(USER), "features"), "users")
    items = items.select(F.col(ITEM).cast("long").alias(ITEM), "features")
    n_users, n_items = users.count(), items.count()
    if seen is not None:
        seen = seen.select(F.col(USER).cast("long").alias(USER), F.col(ITEM).cast("long").alias(ITEM))
    groups, parts = _shape(n_users, n_items, k, spark.sparkContext.defaultParallelism, item_block, user_block, not with_report)
    search = _scored(_written_items(items, parts), parts, k, item_block, with_report)
    out = _dealt(users, seen, groups, parts).mapInArrow(search, f"{_BEST}, {_REPORT}" if with_report else _BEST)
    if parts > 1:
        w = Window.partitionBy(USER).orderBy(F.desc("score"), F.asc(ITEM))
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out, n_users, n_items


def top_n_blocks(users: DataFrame, items: DataFrame, k: int = 200, seen: DataFrame | None = None,
                 item_block: int = ITEM_BLOCK, user_block: int = USER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """M-05: top ``k`` items per user by dot product, seen items removed, and what
    each block of ``item_block`` items, longest first, cost.

    ``users[user_id, features array<float>]``, ``items[item_id, features]``,
    ``seen[user_id, item_id]`` (optional, duplicates allowed).
    Returns ``[user_id, item_id, score double, rank int]`` with rank 1..k, and
    ``[block, n_items, max_length, n_users, n_scored]``: of all users, those that
    were scored against the block.  Before each wave of 1, 1, 2, 4, ... blocks a
    user's k-th score so far decides which of its blocks the user still reaches.
    """
    out, n_users, n_items = _top(users, items, k, seen, item_block, user_block, with_report=True)
    if not n_items:
        return out.select(USER, ITEM, "score", "rank"), out.sparkSession.createDataFrame(
            [(0, 0, None, n_users, n_users)], "block int, n_items long, max_length double, n_users long, n_scored long")
    out = shared_copy(out, "best")
    report = out.filter(F.col("block").isNotNull()).groupBy("block").agg(
        F.max("n_items").alias("n_items"), F.max("max_length").alias("max_length"),
        F.lit(n_users).cast("long").alias("n_users"), F.sum("n_scored").alias("n_scored"))
    return out.filter(F.col("block").isNull()).select(USER, ITEM, "score", "rank"), report


def top_n(users: DataFrame, items: DataFrame, k: int = 200, seen: DataFrame | None = None,
          item_block: int = ITEM_BLOCK, user_block: int = USER_BLOCK) -> DataFrame:
    """M-05: the rows of ``top_n_blocks``, found without its report."""
    return _top(users, items, k, seen, item_block, user_block, with_report=False)[0]


def top_k_prefix(candidates: DataFrame, k: int) -> DataFrame:
    """L-07 / M-06: the first ``k`` of a larger candidate pool (same as asking
    for ``k`` directly, since the pool is a score-ordered prefix)."""
    return candidates.filter(F.col("rank") <= k)


def lookup_ids(candidates: DataFrame, id_map: DataFrame, key: str = USER,
               int_col: str = ITEM, out_id: str = "track_id") -> DataFrame:
    """J-09 (K15): map int ids to text ids; unmapped candidates are dropped
    and the positions close up (``position`` renumbered by rank)."""
    mapped = candidates.join(id_map.select(F.col(int_col).cast("long").alias(int_col), out_id), int_col)
    w = Window.partitionBy(key).orderBy("rank", int_col)
    return mapped.withColumn("position", F.row_number().over(w))
