import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tunefunnel.llm import language_id, packing, word_pieces
from tunefunnel.llm.common import written
from test_exact_dedup import BLANKS
from test_simhash import brute_components, brute_fingerprint
from test_substring_dedup import brute

SF = "/root/testdata/sf0.001"


def by_hand(rows, model):
    """The first four stages in plain Python."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "") and model.predict([r[1]])[1][0] >= 0.5]
    best = {}
    for r in rows:
        key = r[1].translate(BLANKS)
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    rows = sorted(best.values())
    component = brute_components([r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows], 2)
    rows = [r for r, c in zip(rows, component) if r[0] == c]
    texts = {r[0]: r[1] for r in rows}
    return {(i, kept if removed else texts[i]) for i, kept, _, removed in brute(rows, 35)}


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language_id.train(docs.filter(~language_id.held_out()))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, SF), name)
        assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == by_hand(rows, model)
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    encoder = word_pieces.opened(corpus_pipeline.TOKENIZER)
    ids = {r.doc_id: np.append(np.frombuffer(encoder.encode([r.text or ""])[0], "<u4"), np.uint32(packing.END_ID)).astype("<u4")
           for r in out.collect()}
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(list(ids))
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) == p.ids_crc32
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))


def test_stages_take_edge_rows(spark, clashing, no_docs):
    docs = written(clashing.drop("a.b"), "edge")
    empty = written(no_docs, "edge")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs, empty = written(stage(spark, docs, SF), name), written(stage(spark, empty, SF), name)
        assert docs.columns == columns and empty.count() == 0
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter(F.col("length") < 1).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
