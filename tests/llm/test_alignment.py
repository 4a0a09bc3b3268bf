import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tunefunnel.llm import alignment
from tunefunnel.llm.queries import BYTES, PIECES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The contract's columns for (doc_id, text) rows, by plain loops."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    tokens = alignment.opened(BYTES, PIECES)
    grouped = []
    for _, text in rows:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        whole = (" " + (text or "")).encode()
        if (not text or b"".join(tokens.a.bytes[i] for i in a) != whole
                or b"".join(tokens.b_bytes[i] for i in b) != whole):
            grouped.append(None)
            continue
        ends_a, ends_b = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            to_a, to_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        assert (at_a, at_b) == (len(a), len(b))
        grouped.append((len(a), len(b), groups))
    counts = Counter(p for g in grouped if g for p in {(x, y) for xs, ys in g[2] for x in set(xs) for y in set(ys)})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = Counter()
    for (doc_id, _), g in zip(rows, grouped):
        if g is None:
            out[(doc_id, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        links = Counter()
        for xs, ys in g[2]:
            cx, cy = Counter(xs), Counter(ys)
            links.update({(x, y): n * m for x, n in cx.items() for y, m in cy.items()})
        digest = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g[2])
        out[(doc_id, g[0], g[1], len(g[2]), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
             sum(n * counts[p] for p, n in links.items()), hashlib.sha256(digest.encode()).hexdigest())] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def scored(docs):
    return Counter(map(tuple, alignment.Alignment(docs, BYTES, PIECES).scored().select(*COLUMNS).collect()))


def test_operator(spark, edge_docs, edge_rows, no_docs, clashing):
    rows = [(r[0], r[1]) for r in edge_rows]
    want = brute(rows)
    assert scored(edge_docs) == want
    assert scored(clashing.repartition(7)) == want
    assert scored(no_docs) == Counter()
    odd = [(1, "▁x"), (2, "  a  b "), (3, "x" * 20_000), (4, "ab" * 3000 + "=" * 999), (5, "日本語 <s> <0x41> é😀\x00"),
           (None, "x"), (5, None), (5, None)]
    assert scored(spark.createDataFrame(odd, "doc_id long, text string")) == brute(odd)
    assert scored(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == brute([(1, None), (2, "")])


def test_small_portions_change_nothing(spark, edge_rows, monkeypatch):
    """Groups above the limits are counted by distinct ids, in slices."""
    rows = [(i, r[1]) for i, r in enumerate(edge_rows)] + [(999, "abc" * 4000 + " - " * 50)]
    tokens = alignment.opened(BYTES, PIECES)
    ids = tokens.encode([t or "" for _, t in rows])

    def total():
        found = alignment.Aligned(tokens, ids)
        sums = Counter()
        for doc, code, times in found.links():
            for d, c, n in zip(doc.tolist(), code.tolist(), times.tolist()):
                sums[d, c] += n
        distinct = Counter(np.concatenate(list(found.distinct())).tolist())
        assert distinct == Counter(c for _, c in sums)
        return sums

    want = total()
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 50)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 6)
    assert total() == want


def test_pairs_table(spark):
    docs = spark.createDataFrame([(i, "the cat" if i % 3 else "the hat") for i in range(30)], "doc_id long, text string")
    pairs = alignment.Alignment(docs, BYTES, PIECES).pairs.collect()
    assert max(r.n_docs for r in pairs) == 30 and all(0 < r.n_docs <= 30 for r in pairs)
    by_a = {}
    for r in pairs:
        by_a.setdefault(r.a, []).append(r)
    for rs in by_a.values():
        assert all(r.best == (r.n_docs == max(x.n_docs for x in rs)) for r in rs)


def test_pointer_jumping_finds_the_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, size=rng.integers(0, n + 1)), n)) for _ in range(2)]
        common = np.intersect1d(*ends)
        for got, e in zip(alignment.group_labels(*ends), ends):
            assert got.tolist() == np.searchsorted(common, e).tolist()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op13_token_alignment"](spark, SF).select(*COLUMNS).collect())) == brute(rows)


def test_a_run_cuts_each_distinct_chunk_once(monkeypatch):
    tokens, cut = alignment.Tokens(BYTES, PIECES), []
    whole = tokens.a.text_words
    monkeypatch.setattr(tokens.a, "text_words", lambda text, **more: cut.append(text) or whole(text, **more))
    texts = ["it's (odd), no? 3.5 end.\nNext 日本語 " * 100 + "end", "it's (odd)"]
    spaced = ["a\n \nb", "a \n\n b", "a\n b", "a \nb", "x  y", " lead", "trail ", "日本 語  　x", "tab\t \tz",
              "\n x", "a \x1c b", "foo' 's", "'s 't", "1 2,", "a\n", " "]
    for given in (texts, spaced):
        for text, (a, b) in zip(given, tokens.encode(given)):
            assert np.frombuffer(a, "<u4").tolist() == tokens.a.library.encode(" " + text, add_special_tokens=False).ids, text
            assert np.frombuffer(b, "<u4").tolist() == tokens.b.library.encode(text) or text == " ", text
        if given is texts:
            assert len(cut) == len(set(cut)) and max(map(len, cut)) < 20
    [(a, b)] = tokens.encode(["<|endoftext|> b <|endoftext|>"])
    joined = b"".join(tokens.a.bytes[i] for i in np.frombuffer(a, "<u4").tolist())
    assert joined == b" <|endoftext|> b <|endoftext|>" and a != b"" and b != b""
    assert not set(tokens.a.special.values()) & set(np.frombuffer(a, "<u4").tolist())
