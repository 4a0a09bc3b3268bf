"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has 64 bits, each set when over half of the XXH64
values of its word shingles set it.  Fingerprints link at ``radius`` or fewer
differing bits, and documents of linked fingerprints form components.

Distinct fingerprints are laid out in tiles by the population counts of their
four 16-bit quarters.  Fingerprints within the radius differ in these counts by
the radius at most, summed over the quarters, so a tile meets only the tiles
whose counts are that near, and all other tile pairs are skipped.  Tiles of more
than ``TILE_ROWS`` are split.  Each task compares a tile with its visitors by
numpy exclusive-or and bit counts in blocks of bounded size, and gives a spanning
forest of the links found there, so a dense group gives as many links as it has
members, not pairs.  Copies of a text share one fingerprint and are counted in
before the comparison.

Defined cases: null text and text without words have fingerprint zero, which is
linked like any other; fewer words than a shingle are one shingle; null doc_ids
are no candidates for the smallest doc_id (a component of nothing else has a
null id); repeated rows keep their rows; other columns are ignored (and carried
by ``one_of_each``); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches, repeats
from .common import python_ready, text_or_empty, written
from .components import components

#: Words of a shingle, seed of XXH64, differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Resident fingerprints of a tile, and comparisons held in memory at once.
TILE_ROWS = 4096
BLOCK_CELLS = 1 << 21
#: Shingle hashes whose bits are unpacked at once.
BIT_ROWS = 1 << 16
QUARTERS, SIDE = 4, 17


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(
        starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        part = hashes[at:at + BIT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text", tagged: bool = False) -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit number; a written table.  With
    ``tagged`` it has a hash of the text (tag) too."""
    python_ready(docs.sparkSession)
    tag = [F.xxhash64(text_or_empty(text_col)).alias("tag")] if tagged else []
    rows = docs.select(F.col(id_col).alias("id"), *tag, text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    carried = ["id", "tag"] if tagged else ["id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in batches.runs(part, "text"):
                values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([*(rows.column(c) for c in carried), pa.array(values)],
                                      names=[*carried, "fp"])

    return written(rows.mapInArrow(run, f"id {id_type}, {'tag long, ' if tagged else ''}fp long"), "fingerprints")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_pairs(residents: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a resident and a visitor (unsigned) at ``radius`` bits or fewer."""
    step = max(1, BLOCK_CELLS // max(1, len(residents)))
    found = []
    for at in range(0, len(visitors), step):
        some = visitors[at:at + step]
        i, j = np.nonzero(np.bitwise_count(residents[:, None] ^ some[None, :]) <= radius)
        found.append((residents[i], some[j]))
    if not found:
        return residents[:0], visitors[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(radius: int):
    """Links of the tiles of a task.  The rows come sorted by tile, residents
    first, so only one tile's residents and one batch are held."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for part in parts:
            cell, sub, role, fp = (part.column(c).to_numpy() for c in ("cell", "sub", "role", "fp"))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(sub) != 0)) + 1
            a, b = [], []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if tile != (cell[start], sub[start]):
                    tile, held = (cell[start], sub[start]), []
                split = start + int(np.searchsorted(role[start:end], 1))
                if split > start:
                    held.append(fp[start:split])
                if split < end:
                    held = [np.concatenate(held)]
                    x, y = near_pairs(held[0], fp[split:end], radius)
                    other = x != y
                    a.append(x[other])
                    b.append(y[other])
            a, b = np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])
            if len(a):
                a, b = forest(a.view(np.int64), b.view(np.int64))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius of each
    other.  ``distinct`` has the distinct fingerprints (fp)."""
    python_ready(distinct.sparkSession)
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(QUARTERS)]
    cell = counts[0].cast("int")
    for c in counts[1:]:
        cell = cell * SIDE + c
    placed = distinct.select("fp", *(c.alias(f"q{i}") for i, c in enumerate(counts)), cell.alias("cell"))
    # At most 17^4 rows: the tiles, and into how many parts each is split.
    tiles = F.broadcast(placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("subs")))
    residents = placed.join(tiles, "cell").select(
        "cell", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int").alias("sub"), F.lit(0).alias("role"), "fp")
    # Each pair of tiles meets once: a tile visits itself and those after it.
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
             if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    steps = F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps))
    visits = placed.select("fp", *(f"q{i}" for i in range(QUARTERS)), F.explode(steps).alias("step"))
    inside, there = F.lit(True), F.lit(0)
    for i in range(QUARTERS):
        q = F.col(f"q{i}") + F.col("step")[i]
        inside, there = inside & q.between(0, SIDE - 1), there * SIDE + q
    visitors = (visits.filter(inside).select(there.alias("cell"), "fp").join(tiles, "cell")
                .select("cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"),
                        F.lit(1).alias("role"), "fp"))
    return (residents.unionByName(visitors).repartition("cell", "sub")
            .sortWithinPartitions("cell", "sub", "role")
            .mapInArrow(_compare(radius), "a long, b long"))


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (id, fp) rows."""
    first = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    linked = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    smallest = linked.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    member = linked.join(smallest, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    return written(first.join(member, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")),
        "fingerprint-classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, fp (signed) and component_id, the smallest id reachable
    over links."""
    fps = fingerprints(docs, shingle, id_col, text_col)
    return fps.join(classes(fps, radius), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near-duplicates: of each component the
    row of the smallest id stays, by the smaller text hash where that id has
    several texts there.  Rows are told apart by id and text: those that repeat
    both stay or go together, and those of null ids stay.  Rows of other
    components never shuffle."""
    fps = fingerprints(docs, shingle, id_col, text_col, tagged=True)
    groups = fps.join(classes(fps, radius), "fp").select("id", "tag", "component_id")
    gone = groups.filter("id <> component_id").select("id", "tag")
    # Few: the ids that stand on more than one text.
    several = written(fps.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("tag").alias("low"), F.max("tag").alias("high")).filter("low <> high").select("id"), "ids-of-texts")
    if not several.isEmpty():
        own = written(groups.filter("id = component_id").join(several, "id", "left_semi").select("id", "tag"),
                      "texts-of-ids")
        first = own.groupBy("id").agg(F.min("tag").alias("first"))
        gone = gone.unionByName(own.join(first, "id").filter("tag <> first").select("id", "tag"))

    def key(id: Column, tag: Column) -> Column:
        return F.when(id.isNotNull(), F.struct(id.alias("id"), tag.alias("tag")))

    gone = written(gone.distinct().select(key(F.col("id"), F.col("tag")).alias("key")), "near-duplicates")
    name = "__sh_key"
    keyed = docs.withColumn(name, key(F.col(f"`{id_col}`"), F.xxhash64(text_or_empty(text_col))))
    return repeats.without(keyed, name, gone).drop(name)
