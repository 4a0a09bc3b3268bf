import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tunefunnel.llm import packing, sentence_pieces, token_counts, word_pieces
from tunefunnel.llm.queries import PIECES, WORDS, packed_digest


@pytest.fixture(scope="module")
def library():
    words = Tokenizer.from_file(WORDS)
    return lambda t: words.encode(t or "", add_special_tokens=False).ids


def test_word_pieces_equal_the_library(edge_rows, library):
    encoder = word_pieces.opened(WORDS)
    assert encoder.by_piece
    texts = [r[1] or "" for r in edge_rows] + ["a\x1cb\x85c\xa0d", "á ́x", "ǅ ß ẞ ŉ ª º", "\x00a"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text[:40]
    small = word_pieces.WordPieces(WORDS)
    small.chunks.entries = small.pieces.entries = 3
    for _ in range(2):  # generations that turn all the time
        for text in texts:
            assert small.count([text]) == [len(library(text))]


def test_sentence_pieces_equal_the_library(edge_rows):
    pieces = sentence_pieces.opened(PIECES)
    texts = [r[1] or "" for r in edge_rows] + [
        " ", "  a  b ", "▁a ▁▁b", "a\n\nb", "    def f():\n\treturn", "�", "x" * 300 + " " + "ab" * 200]
    ids, decoded, checked = pieces.encode(texts)
    assert all(checked)
    for text, i, d in zip(texts, ids, decoded):
        want = pieces.library.encode(text)
        assert i == ",".join(map(str, want)), text[:40]
        assert d == pieces.library.decode(want), text[:40]


def test_the_two_agendas_agree(edge_rows):
    pieces = sentence_pieces.opened(PIECES)
    atoms = ["▁" + w for r in edge_rows for w in (r[1] or "").split()[:50]]
    atoms = [a for a in dict.fromkeys(atoms) if len(a) < 300]
    assert pieces.merge_all(atoms) == [pieces.merge_one(a) for a in atoms]


def test_sentencepiece_operator(edge_docs, edge_rows, no_docs):
    out = sentence_pieces.encoded(edge_docs, PIECES)
    got = Counter((r.doc_id, r.n_tokens, r.ids, r.decoded, r.checked) for r in out.collect())
    library = sentence_pieces.opened(PIECES).library
    want = Counter()
    for r in edge_rows:
        ids = library.encode(r[1] or "")
        want[(r[0], len(ids), ",".join(map(str, ids)), library.decode(ids), True)] += 1
    assert got == want
    assert sentence_pieces.encoded(no_docs, PIECES).count() == 0


def test_token_counts(edge_docs, edge_rows, no_docs, library):
    got = Counter(map(tuple, token_counts.token_counts(edge_docs, WORDS).collect()))
    assert got == Counter((r[0], len((r[1] or "").encode()), len(library(r[1])), len(library(r[1])) > 2048)
                          for r in edge_rows)
    pieces = sentence_pieces.opened(PIECES).library
    got = token_counts.token_counts(edge_docs, PIECES).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], len(pieces.encode(r[1] or ""))) for r in edge_rows)
    assert token_counts.token_counts(no_docs, WORDS).count() == 0


def test_packing_is_whole_and_gapless(edge_docs, edge_rows, library):
    pieces = [r.asDict() for r in packing.pack(edge_docs, WORDS, length=128).collect()]
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"]
    last = max(sequences)
    for s, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 128 or s == last
    # Put together by place, the documents are those of the table.
    stream = b"".join(p["ids"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])))
    ends = np.flatnonzero(np.frombuffer(stream, "<u4") == packing.END_ID)
    assert len(stream) // 4 == sum(len(library(r[1])) + 1 for r in edge_rows)
    starts = Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert starts == Counter((r[0], len(library(r[1])) + 1) for r in edge_rows)
    whole = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: p["start"]):
        whole[p["doc_id"]] += p["ids"]
    for r in edge_rows:
        if sum(x[0] == r[0] for x in edge_rows) == 1:
            assert np.frombuffer(whole[r[0]], "<u4").tolist() == library(r[1]) + [packing.END_ID]
    assert len(ends) >= len(edge_rows)


def test_packing_digest_and_empty(edge_docs, no_docs):
    for p, d in zip(packing.pack(edge_docs, WORDS).collect()[:5], packed_digest(packing.pack(edge_docs, WORDS)).collect()[:5]):
        assert zlib.crc32(p.ids) == d.ids_crc32
    assert packing.pack(no_docs, WORDS).count() == 0


def test_similar_documents_are_neighbours(spark):
    rows = [(i, f"{'alpha beta gamma' if i % 2 else 'rot gelb blau'} " * 40) for i in range(60)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    order = [p.doc_id % 2 for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_sha_of_the_registered_query(spark):
    from tunefunnel.llm import queries
    out = queries.op5_sentencepiece(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library = sentence_pieces.opened(PIECES).library
    for r in out:
        ids = library.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_new_chunks_are_checked_and_decoded_many_in_a_call():
    pieces, asked, undone = sentence_pieces.Pieces(PIECES), [], []
    library = pieces.library

    class Counted:
        def encode(self, text, **more):
            asked.append(text)
            return library.encode(text, **more)

        def decode(self, ids, **more):
            undone.append(ids)
            return library.decode(ids, **more)

    pieces.library = Counted()
    texts = [" ".join(f"{w}{i}" for i in range(500)) for w in ("haus", "日本", "w😀")] + ["x" * 300 + ", b"]
    ids, decoded, checked = pieces.encode(texts)
    assert [list(map(int, i.split(","))) for i in ids] == library.encode(texts)
    assert decoded == texts and all(checked)
    assert len(asked) == len(undone) == 1 and isinstance(asked[0], str)


def test_chunks_on_which_the_library_differs_are_marked():
    pieces = sentence_pieces.Pieces(PIECES)
    library = pieces.library

    class Other:
        def encode(self, text, **more):
            swap = lambda t: library.encode("other" if t == "odd" else t)
            return swap(text) if isinstance(text, str) else list(map(swap, text))

        def decode(self, ids, **more):
            return library.decode(ids, **more)

    pieces.library = Other()
    # Put together, "odd" is not seen; alone it is.
    pieces.know({"odd"})
    ids, decoded, checked = pieces.encode(["an odd text", "another"])
    assert checked == [False, True] and decoded == ["an other text", "another"]
    assert ids[1] == ",".join(map(str, library.encode("another")))


def test_a_run_cuts_each_distinct_chunk_once(monkeypatch, library):
    cut = []

    class Counted:
        findall = staticmethod(lambda t, whole=word_pieces.PIECE: cut.append(t) or whole.findall(t))

    monkeypatch.setattr(word_pieces, "PIECE", Counted)
    texts = ["It's 3.5, Straße! (İ) " * 50, "it's\t3.5,\n\nabc", "", " \n", "foo' 'foo d'l "]
    encoder = word_pieces.WordPieces(WORDS)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert len(cut) == len(set(cut)) and max(map(len, cut)) < 10


def test_chunks_are_cut_as_by_the_pattern(monkeypatch):
    chunks = ["abc", "abc.)", "ü,", "", "it's", "'s", "a.'s", "x'", "--", "3", "a3,", "(i̇)", "i̇.", "×a", "ß÷", "a\x01", "ŉſ!", "\"abc\""]
    want = {c: word_pieces.PIECE.findall(c) for c in chunks}
    alone = []

    class Counted:
        findall = staticmethod(lambda t, whole=word_pieces.PIECE: alone.append(t) or whole.findall(t))

    monkeypatch.setattr(word_pieces, "PIECE", Counted)
    pieces, order, sizes = word_pieces.cut(pa.array(chunks, pa.large_string()))
    left = iter(pieces.to_pylist())
    assert {chunks[i]: [next(left) for _ in range(n)] for i, n in zip(order, sizes)} == want
    assert next(left, None) is None and sorted(order) == list(range(len(chunks)))
    # Letters, with marks after them or not, are cut many in a call.
    assert not {"abc", "abc.)", "ü,", "x'", "ŉſ!"}.intersection(alone)


def test_pieces_go_once_through_the_library_while_they_are_held(monkeypatch, library):
    encoder, asked = word_pieces.WordPieces(WORDS), []
    ids_of = encoder._model_ids
    monkeypatch.setattr(encoder, "_model_ids", lambda pieces: asked.extend(pieces) or ids_of(pieces))
    texts = ["Alpha beta, beta (gamma)... alpha's", "gamma! Alpha 33", "", "delta alpha\nBETA;"]
    for _ in range(2):
        for run in (texts, texts[::-1]):
            for text, ids in zip(run, encoder.encode(run)):
                assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert len(asked) == len(set(asked)) == len(encoder.pieces.keys)
    # When full, what was found again stays, but for long pieces.
    encoder.encode(["x" * 100 + " omega"])
    encoder.pieces.used[:] = False
    encoder.encode(["x" * 100 + " gamma, alpha"])
    encoder.pieces.entries = 3
    encoder.pieces.turn()
    assert sorted(encoder.pieces.keys.to_pylist()) == [",", "alpha", "gamma"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert asked.count("alpha") == 1 and asked.count("beta") == 2
