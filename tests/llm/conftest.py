import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_text(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, shared passages, other scripts and special strings."""
    rng = random.Random(5)
    passage = word_text(rng, 60)
    long = word_text(rng, 30_000)
    texts = [None, "", "   ", "\n\t", "a", "a b", "A  b\n", "<|endoftext|> x <s>", "İ ΣΑΣ ﬁ é é 日本語 😀",
             long, long, "12 34 ++", "x" * 5000, passage, "start " + passage + " end",
             passage.upper(), "spam " * 200, "don't they'll 3rd ½"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t))
            for i, t in enumerate(texts)]
    for i in range(40):
        t = word_text(rng, rng.randrange(1, 200))
        rows.append((100 + i, t, rng.choice(["en", "de"]), "s", len(t)))
        if i % 4 == 0:
            rows.append((200 + i, t.replace(" ", "  ", 3), "en", "s", len(t) + 3))
    rows.append(rows[-1])
    rows += [(None, "null id", "en", None, 7), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    out = edge_docs
    for name in ("kept", "keep_id", "group_size", "lang_pred", "score", "row", "spans", "id", "key",
                 "fp", "component_id", "tag", "maybe", "n_removed", "a.b"):
        out = out.withColumn(name, F.lit("x"))
    return out
