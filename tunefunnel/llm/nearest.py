"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner product becomes nearest direction when each candidate gets one
more coordinate that fills it up to the greatest length; a query gets zero there.
``ORDERINGS`` random projections to ``DIMS`` dimensions, each with its own random
shift, are cut into grids, and the Hilbert keys of the cells order the vectors,
all orderings in one Spark range sort.  In each ordering a query meets the
vectors of the key windows around its own place, in blocks of ``BLOCK_ROWS``
neighbours; each block gives its best ``k`` by exact inner product, and the
blocks of all orderings merge and are ranked again.

The window is fitted, not set: for ``SAMPLE`` queries the true neighbours are
found by a scan, and the least half-width that holds ``TARGET`` of them in one
ordering or another is taken for all queries.  Vectors without structure, as
those of the test tables, need windows of several hundredths of the table;
clustered ones far smaller windows.  The window holds a share of all pairs, so
single queries can lose more than others.

Every distinct vector is indexed and searched once, numbered in the order of the
smallest id that holds it.  Each hit then stands for the ``k + 1`` smallest ids
of its vector, and each list for all ids that ask with its vector, so copies take
no places in the windows and their ties are exact.  A query's own copies are
added without a search.

Defined cases: vectors that are null, empty or zero or hold null or non-finite
components take no part, nor do those of another length than most vectors have
(the greater of equally frequent lengths); a query is never its own neighbour,
by id; an id on several rows is one candidate at its best score, and as a query
it searches once for each row and keeps the best; null ids take no part; equal scores go to the smaller
id; with fewer than ``k`` candidates all are found, if the windows reach them;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hilbert
from .common import python_ready, written

#: Neighbours of a query.
NEAREST = 20
#: Orderings, projected dimensions and grid bits of each.
ORDERINGS, DIMS, BITS = 16, 4, 10
#: Vectors of a block.
BLOCK_ROWS = 2048
#: Queries whose true neighbours fit the window, and the share it must hold.
SAMPLE, TARGET = 64, 0.95
#: Scores held in memory at once.
BLOCK_CELLS = 1 << 20
#: Parts into which the joins with the ids of one vector are dealt.
SALTS = 16


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
            k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, score) of the ``k`` best of each query, ties to smaller ids.

    The product matrix only selects, with a margin for its rounding; scores are
    then summed in one fixed order, so equal vectors have equal scores wherever
    they are compared."""
    if not len(vectors):
        return
    lengths = np.linalg.norm(vectors, axis=1).max()
    # Rows that repeat an id must not take the places of others.
    rows = k * int(np.unique(ids, return_counts=True)[1].max())
    step = max(1, BLOCK_CELLS // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        some = queries[at:at + step]
        scores = some @ vectors.T
        margin = 1e-12 * lengths * np.linalg.norm(some, axis=1)
        scores[query_ids[at:at + step, None] == ids[None, :]] = -np.inf
        if scores.shape[1] > rows:
            floor = -np.partition(-scores, rows - 1, axis=1)[:, rows - 1] - margin
        else:
            floor = np.full(len(some), -np.inf)
        q, x = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        exact = (some[q] * vectors[x]).sum(axis=1)
        if rows > k:
            order = np.lexsort((-exact, ids[x], q))
            q, x, exact = q[order], x[order], exact[order]
            new = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(ids[x]) != 0)])[:len(q)]
            q, x, exact = q[new], x[new], exact[new]
        order = np.lexsort((ids[x], -exact, q))
        q, x, exact = q[order], x[order], exact[order]
        first = np.searchsorted(q, np.arange(len(some)))
        keep = np.arange(len(q)) - first[q] < k
        yield query_ids[at:at + step][q[keep]], ids[x[keep]], exact[keep]


_SCORED = "query_id long, vec_id long, score double"


def _scored(query: np.ndarray, found: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query), pa.array(found), pa.array(score)],
                           names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """The written rows (id, vec, is_query, h1, h2) of vectors that take part; equal
    vectors, and no others, have equal pairs of hashes."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return written(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                       F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .filter(F.col("id").isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))
        .withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec")),
        "vectors")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The written distinct vectors (id, vec, is_query, h1, h2): ``id`` numbers
    them in the order of their smallest ids, ``is_query`` is whether any row asks."""
    groups = rows.groupBy("vec", "h1", "h2").agg(F.min("id").alias("least"), F.max("is_query").alias("is_query"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["least", "h1", "h2"]
    return written(groups.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("id"), "vec", "is_query", "h1", "h2"), "distinct-vectors")


def smallest_ids(members: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, ids): the ``keep`` smallest ids of each vector.  A first round by
    salt leaves few rows of a vector that many ids share."""
    salted = members.select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    for key in (["h1", "h2", "salt"], ["h1", "h2"]):
        w = Window.partitionBy(*key).orderBy("id")
        salted = salted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
    return salted.groupBy("h1", "h2").agg(F.collect_list("id").alias("ids"))


def by_id(hits: DataFrame, rows: DataFrame, groups: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ids of each asking id, from hits between distinct vectors.

    One hit can stand in the lists of most queries, and one vector can be asked
    by many ids, so both joins are dealt by salt too."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def salt(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")

    ids = (smallest_ids(members, k + 1).join(groups.select(F.col("id").alias("vec_id"), "h1", "h2"), ["h1", "h2"])
           .select("vec_id", "ids", salts))
    named = (hits.select("query_id", "vec_id", "score", salt("query_id")).join(ids, ["vec_id", "salt"])
             .select("query_id", F.explode("ids").alias("vec_id"), "score"))
    lists = (merged(named, k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("list"))
             .join(groups.select(F.col("id").alias("query_id"), "h1", "h2"), "query_id")
             .select("h1", "h2", "list", salts))
    asking = rows.filter("is_query").select("id", "h1", "h2").distinct().select("*", salt("id"))
    return merged(asking.join(lists, ["h1", "h2", "salt"])
                  .select(F.col("id").alias("query_id"), F.explode("list").alias("hit"))
                  .select("query_id", "hit.vec_id", "hit.score").filter("query_id <> vec_id"), k)


def own_scores(groups: DataFrame, dim: int) -> DataFrame:
    """Each asking vector as a hit of itself, for its copies."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = matrix(part.column("vec"), dim)
                own = part.column("id").to_numpy()
                yield _scored(own, own, (x * x).sum(axis=1))

    return groups.filter("is_query").select("id", "vec").mapInArrow(run, _SCORED)


def curve_rows(vectors: DataFrame, dim: int, longest: float) -> DataFrame:
    """(ordering, key, id, role): each vector's key in each ordering, as a
    candidate (role 0) and, if it is one, as a query (role 1)."""
    rng = np.random.default_rng(11)
    turns = [np.linalg.qr(rng.standard_normal((max(dim + 1, DIMS), DIMS)))[0] for _ in range(ORDERINGS)]
    shifts = rng.random((ORDERINGS, DIMS)) * 0.25

    def keyed(points: np.ndarray, ordering: int) -> np.ndarray:
        if points.shape[1] < DIMS:
            points = np.pad(points, ((0, 0), (0, DIMS - points.shape[1])))
        z = points @ turns[ordering] * np.sqrt(dim)
        share = (0.5 + 0.5 * np.tanh(0.8 * z) + shifts[ordering]) / 1.25
        return hilbert.keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("id").to_numpy()
            if not len(ids):
                continue
            asked = part.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            x = matrix(part.column("vec"), dim) / longest
            length = np.linalg.norm(x, axis=1, keepdims=True)
            as_candidate = np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - length**2))])
            as_query = np.hstack([x / length, np.zeros_like(length)])[asked]
            for ordering in range(ORDERINGS):
                for role, points, own in ((0, as_candidate, ids), (1, as_query, ids[asked])):
                    yield pa.record_batch(
                        [pa.array(np.full(len(own), ordering, dtype=np.int32)),
                         pa.array(keyed(points, ordering)), pa.array(own),
                         pa.array(np.full(len(own), role, dtype=np.int32))],
                        names=["ordering", "key", "id", "role"])

    return vectors.select("id", "vec", "is_query").mapInArrow(
        run, "ordering int, key long, id long, role int")


def positions(rows: DataFrame, n: int) -> DataFrame:
    """(ordering, id, role, pos): the number of candidates before each row in its
    ordering.  One range sort for all orderings, a running count within each
    partition, and one total per partition."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ordering", "key", "id", "role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            one = batch.column("role").to_numpy() == 0
            before = total + np.cumsum(one) - one
            total += int(one.sum())
            yield pa.record_batch(
                [batch.column("ordering"), batch.column("id"), batch.column("role"),
                 pa.array(before), pa.array(np.full(len(one), part, dtype=np.int32))],
                names=["ordering", "id", "role", "before", "part"])

    ranged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .mapInArrow(run, "ordering int, id long, role int, before long, part int"), "curve-order")
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(
        F.count(F.when(F.col("role") == 0, 1)).alias("n")).collect())
    starts, at = [], 0
    for part, count in totals:
        starts.append((part, at))
        at += count
    start = spark.createDataFrame(starts, "part int, start long")
    return ranged.join(F.broadcast(start), "part").select(
        "ordering", "id", "role",
        (F.col("before") + F.col("start") - F.col("ordering") * F.lit(n)).alias("pos"))


def merged(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of each query, ranked from 1."""
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def scanned(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The true neighbours of a few given queries: every task scans its rows."""
    spark = vectors.sparkSession
    dim = len(queries[0][1])
    asked = spark.sparkContext.broadcast(
        (np.array([q[0] for q in queries], dtype=np.int64), np.array([q[1] for q in queries], dtype=np.float64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = asked.value
        for part in parts:
            if part.num_rows:
                for out in best_of(ids, points, part.column("id").to_numpy(), matrix(part.column("vec"), dim), k):
                    yield _scored(*out)

    return merged(vectors.select("id", "vec").mapInArrow(run, _SCORED), k)


def half_window(vectors: DataFrame, placed: DataFrame, k: int, sample: int = SAMPLE,
                target: float = TARGET) -> int:
    """The least distance along the curves that reaches ``target`` of the true
    neighbours of ``sample`` queries, chosen by a hash of their ids."""
    queries = [(r.id, list(r.vec)) for r in vectors.filter("is_query").orderBy(
        F.xxhash64("id"), "id").select("id", "vec").limit(sample).collect()]
    if not queries:
        return 1
    truth = scanned(vectors, queries, k).select("query_id", "vec_id")
    mine = placed.filter("role = 1").select(F.col("id").alias("query_id"), "ordering", F.col("pos").alias("at"))
    theirs = placed.filter("role = 0").select(F.col("id").alias("vec_id"), "ordering", "pos")
    # At most sample x k rows.
    reach = sorted(r.d for r in truth.join(mine, "query_id").join(theirs, ["vec_id", "ordering"])
                   .groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("d")).collect())
    return max(1, int(reach[min(len(reach) - 1, int(np.ceil(target * len(reach))) - 1)])) if reach else 1


def _compare(dim: int, k: int):
    """The best of each block for each query that visits it.  Rows come sorted by
    block, vectors first, so one block and one batch of queries are held."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, points = None, [], []
        for part in parts:
            if not part.num_rows:
                continue
            ordering, number, role, own = (part.column(c).to_numpy() for c in ("ordering", "block", "role", "id"))
            x = matrix(part.column("vec"), dim)
            cuts = np.flatnonzero((np.diff(ordering) != 0) | (np.diff(number) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if block != (ordering[start], number[start]):
                    block, ids, points = (ordering[start], number[start]), [], []
                split = start + int(np.searchsorted(role[start:end], 1))
                if split > start:
                    ids.append(own[start:split])
                    points.append(x[start:split])
                if split < end and ids:
                    ids, points = [np.concatenate(ids)], [np.concatenate(points)]
                    for out in best_of(own[split:end], x[split:end], ids[0], points[0], k):
                        yield _scored(*out)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id",
            vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by
    inner product in double precision."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = usable(vectors, id_col, vec_col, is_query)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest"))
    common = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vec") == common.dim)
    groups = distinct_vectors(rows)
    members = written(rows.select("id", "h1", "h2").distinct(), "vector-ids")
    n = groups.count()
    # An id on several vectors must not take the places of others.
    most = members.groupBy("id").count().agg(F.max("count")).first()[0]
    wanted = k * most + most - 1
    placed = written(positions(curve_rows(groups, common.dim, common.longest), n), "curve-positions")
    half = half_window(groups, placed, wanted, target=target)
    blocks = -(-n // block_rows)
    reach = -(-half // block_rows)
    own = F.expr(f"pos div {block_rows}").cast("int")
    held = placed.filter("role = 0").select("ordering", own.alias("block"), "role", "id")
    first = F.greatest(F.lit(0), F.least(own, F.lit(blocks - 1 - reach)) - reach)
    visits = placed.filter("role = 1").select(
        "ordering", F.explode(F.sequence(first, F.least(F.lit(blocks - 1), first + 2 * reach))).alias("block"),
        "role", "id")
    tiles = (held.unionByName(visits).join(groups.select("id", "vec"), "id")
             .repartition("ordering", "block").sortWithinPartitions("ordering", "block", "role")
             .select("ordering", "block", "role", "id", "vec"))
    hits = merged(tiles.mapInArrow(_compare(common.dim, wanted), _SCORED), wanted).select("query_id", "vec_id", "score")
    return by_id(hits.unionByName(own_scores(groups, common.dim)), rows, groups, members, k)
