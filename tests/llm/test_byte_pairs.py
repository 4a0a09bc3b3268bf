import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from tunefunnel.llm import byte_pairs
from tunefunnel.llm.caches import ByteCache
from tunefunnel.llm.queries import BYTES, QUERIES

SF = "/root/testdata/sf0.001"
PARTS = ["a", "b", "  ", "\n", "\t", " ", "'s", "'", "'LL", "é", "ß", "日本", "😀", "́", " ", "\x85", "\x1c", "1",
         "²", "½", "<|endoftext|>", "<|", "the ", "ing", "----", "\r\n", "ǆ", "א", "ﬁ", " ", "​", "$", "€", "՘"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ",".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(library, edge_rows):
    pairs = byte_pairs.opened(BYTES)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += [r[1] or "" for r in edge_rows] + ["a" * 5000, "ab" * 3000, "x" * 129 + "y", " " * 3000, "=-" * 500, "\x00"]
    for start in range(0, len(texts), 500):
        part = texts[start:start + 500]
        for text, *got in zip(part, *pairs.encode(part)):
            assert tuple(got) == expected(library, text), text[:40]


def test_plain_characters_are_cut_as_by_the_library(library):
    pairs = byte_pairs.opened(BYTES)
    plain = [chr(c) for c in range(0x3000) if byte_pairs.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 0x250
    for c in plain:
        text = f"a{c}b1{c}2 {c}!{c}? {c}{c}"
        assert pairs.cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_every_prefix_of_a_word_is_encoded_on_the_way(library):
    """Words that are prefixes of each other share a path, in any set."""
    pairs = byte_pairs.opened(BYTES)
    word = "internationalisations" * 3
    words = {word[:i].encode() for i in range(1, len(word) + 1)}
    for w, ids in pairs.encode_words(words):
        assert ids == library.encode(w.decode(), add_special_tokens=False).ids
    assert {w for w, _ in pairs.encode_words(words)} == words


def test_operator(edge_docs, edge_rows, no_docs, library, clashing):
    want = Counter((r[0], *expected(library, r[1] or "")) for r in edge_rows)
    for docs in (edge_docs, clashing):
        out = byte_pairs.encoded(docs, BYTES).select("doc_id", "ids", "n_tokens", "decoded")
        assert Counter(map(tuple, out.collect())) == want
    assert byte_pairs.encoded(no_docs, BYTES).count() == 0


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in rows:
        ids, n, decoded = expected(library, text or "")
        want.append((doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, SF).collect())) == sorted(want)


def test_other_vocabularies_are_refused():
    from tunefunnel.llm.queries import WORDS
    with pytest.raises(ValueError):
        byte_pairs.BytePairs(WORDS)


def test_cache_is_bounded_by_bytes():
    cache = ByteCache(limit=20_000)
    for i in range(200):
        cache.turn()
        keys = [f"k{i}-{j}" for j in range(10)] + ["hot", "x" * 2000 + str(i)]
        for k in cache.missing(keys):
            cache.new[k] = k
        assert all(cache.new[k] == k for k in keys)
    assert len(cache.new) + len(cache.old) < 200
    cache.turn()
    assert not any(len(k) > 1000 for k in cache.new)
