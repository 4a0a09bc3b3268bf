import zlib

import numpy as np
import pytest

from tunefunnel.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    rows = queries.op3_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in judged]) >= 0.9


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog", "en"), ("and the house", "en"), ("der hund und die katze", "de"),
            ("und das haus", "de"), (None, "de"), ("x", None)]
    return language_id.train(spark.createDataFrame(rows, "text string, lang string"))


def brute_grams(text, bits):
    out = []
    for buckets, _ in language_id._grams([text], bits):
        out += buckets.tolist()
    return sorted(out)


def test_grams_stay_within_texts():
    texts = ["abc", "", "Zürich 😀", "a"]
    together = {}
    for n, (buckets, ends) in enumerate(language_id._grams(texts, 12)):
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            together.setdefault(i, []).extend(buckets[a:b].tolist())
    for i, t in enumerate(texts):
        assert sorted(together[i]) == brute_grams(t, 12)
        assert len(together[i]) == sum(len(t) + 2 - (n - 1) for n in language_id.ORDERS)


def test_probabilities_match_the_formula(model):
    text = "the hound"
    want = model.prior.copy()
    for buckets, _ in language_id._grams([text], model.bits):
        want += model.log_p[:, buckets].sum(axis=1)
    lang, score = model.predict([text])
    p = np.exp(want - want.max())
    assert lang == [model.languages[want.argmax()]] and score[0] == pytest.approx(p.max() / p.sum())


def test_edges(edge_docs, clashing, no_docs, edge_rows, model, spark):
    out = language_id.predict(edge_docs.select("doc_id", "text"), model).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    kept = language_id.identified(clashing, model, min_score=0.0)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in edge_rows)
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.train(no_docs)
    assert {r.lang_pred for r in language_id.predict(edge_docs, nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    rows = spark.range(2000).selectExpr("concat('text number ', id) as text", "'en' as lang")
    model = language_id.train(rows, train_rows=100)
    assert model.languages == ["en"]
    assert 0 < model.log_p.size == 1 << model.bits


def test_rare_languages_are_learned_from_large_tables(spark):
    rows = [(i, f"text number {i}", "en") for i in range(3000)] + [(3000 + i, f"żółć gęślą {i}", "pl") for i in range(3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=30)
    assert model.languages == ["en", "pl"]
    assert np.exp(model.prior) == pytest.approx([3000 / 3003, 3 / 3003])
    assert model.predict(["żółć gęślą jaźń"])[0] == ["pl"]


def test_copies_are_drawn_one_by_one(spark):
    rows = spark.range(4000).selectExpr("id", "if(id < 3000, 'a copy', concat('text ', id)) as text", "'en' as lang")
    drawn = language_id.sample(rows, [("en", 4000)], 400)
    copies = drawn.filter("text = 'a copy'").count()
    assert 200 <= copies <= 400 and 50 <= drawn.count() - copies <= 150
    same = rows.withColumn("id", rows.id * 0)
    assert language_id.sample(same, [("en", 4000)], 400).count() <= 200
