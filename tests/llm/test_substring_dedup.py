import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tunefunnel.llm import substring_dedup as sd


def brute(rows, window):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[s:s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] > 1:
                keep[s:s + window] = [False] * window
        out.append((r[0], b" ".join(x for x, k in zip(w, keep) if k).decode(), len(w), len(w) - sum(keep)))
    return Counter(out)


def cut(docs, **kw):
    return Counter(map(tuple, sd.cut(docs, **kw).select("row.doc_id", "kept", "n_words", "n_removed").collect()))


def test_edges_match_brute_force(edge_docs, edge_rows, no_docs):
    assert cut(edge_docs) == brute(edge_rows, 35)
    assert sd.cut(no_docs).count() == 0


@pytest.mark.parametrize("combine_rows", [1 << 20, 5])
def test_random_overlaps_match_brute_force(spark, combine_rows):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(30)]
    parts = [[rng.choice(pool) for _ in range(rng.randrange(4, 14))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = [w for _ in range(rng.randrange(0, 6)) for w in rng.choice(parts)]
        if i % 7 == 0:
            text = text * 3  # windows that repeat within one document
        rows.append((i, " ".join(text)))
    rows.append((99, "a b c " * 30))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut(docs, window=8, gram=4, combine_rows=combine_rows) == brute(rows, 8)


def test_deduplicated_keeps_columns(clashing, edge_rows):
    out = sd.deduplicated(clashing)
    assert out.columns == clashing.columns
    want = brute(edge_rows, 35)
    texts = {r[0]: r[1] for r in edge_rows}
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.select("doc_id", "text", "n_chars").collect())
    expected = Counter()
    for (i, kept, _, removed), n in want.items():
        for r in [r for r in edge_rows if r[0] == i][:1]:
            if i is not None:
                expected[(i, kept if removed else texts[i], len(kept) if removed else r[4])] += n
    assert {k: v for k, v in got.items() if k[0] is not None} == dict(expected)


def test_numpy_helpers():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 5, 200).astype(np.uint64)
    for size in (1, 2, 3, 20, 35):
        got = sd._leftmost_least(values, size)
        assert got.tolist() == [s + int(np.argmin(values[s:s + size])) for s in range(200 - size + 1)]
        grams = sd._grams(values, size)
        by_content = {}
        for s, g in enumerate(grams.tolist()):
            assert by_content.setdefault(tuple(values[s:s + size].tolist()), g) == g
        assert len(set(by_content.values())) == len(by_content)


def test_windows_leave_a_task_in_bounded_batches(monkeypatch):
    """A task's windows are added up together, but handed on in small batches."""
    monkeypatch.setattr(sd, "BATCH_ROWS", 100, raising=False)
    monkeypatch.setattr(sd, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(150)]
    texts = [[f"w{rng.randrange(10 ** 9)}" for _ in range(300)] + passage * (i % 3) for i in range(9)]
    part = pa.record_batch([pa.array(range(9), pa.int64()), pa.array(range(9), pa.int64()),
                            pa.array([" ".join(t) for t in texts])], names=["id", "tag", "text"])
    every_block = SimpleNamespace(value=b"\xff" * 4096)
    out = list(sd._parse(every_block, 8 * 4096, 8, 4, 1 << 20)(iter([part])))
    assert max(b.num_rows for b in out) <= 100

    rows = [r for b in out for r in b.to_pylist()]
    segment = {r["id"]: r["place"] for r in rows if r["kind"] == 2}
    found = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - 8 + 1):
            found.setdefault(tuple(t[s:s + 8]), []).append((segment[i] << sd.WORD_BITS) | s)
    lead = [(r["place"], r["known"]) for r in rows if r["kind"] == 0]
    assert lead == sorted((places[0], len(places) > 1) for places in found.values())
    assert len({r["hash"] for r in rows if r["kind"] == 0}) == len(found)
    own = [r["place"] for r in rows if r["kind"] == 1]
    assert own == sorted(p for places in found.values() if len(places) > 1 for p in places)
