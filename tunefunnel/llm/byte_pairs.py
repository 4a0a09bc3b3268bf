"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Each prefix of a word has one last token: the last one of the prefix's own
encoding.  It is the one token that ends the prefix and stays apart from the
last token of what is left, so the last token of a prefix follows from those of
shorter prefixes.  The distinct words of a run are put into a trie, and a
depth-first walk carries the last tokens along the path: a prefix that many
words share is encoded once, and a word's ids are read backwards from its leaf.

Two tokens stay apart if no merge ever joins bytes across their border.  The
tokens' merge trees tell: undo the younger of the two symbols at the border
again and again, and look for a pair that would have merged before either of
the two was used up.  The answer is kept for each pair of tokens.

Texts are cut into words by the vocabulary's pre-tokenizer.  Texts of plain
Latin characters go through its pattern with the classes written out; all
others go through the library's own pre-tokenizer, whose Unicode tables decide.

Defined cases: null counts as empty; the empty text has no ids and decodes to
itself; special strings inside texts become their id, as by the library's
default, and decode to themselves; null ids and repeated rows are encoded row by
row; other columns are ignored; an empty table gives an empty result.  A text is
cut into words as a whole; ids of words are found one distinct word at a time,
and a worker's cache of words is bounded by bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .caches import ByteCache
from .common import python_ready, text_or_empty

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085\u00A0"
#: Texts of these characters are cut by the pattern below.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
#: The byte-level pre-tokenizer's pattern for such texts.
WORD = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
                  rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Pairs of tokens whose answer is kept, at most.
PAIRS = 2_000_000


def _byte_characters() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write it as:
    printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


class _Apart(dict):
    """Whether two adjacent tokens a and b stay two tokens, by a * n + b."""

    def __init__(self, vocabulary: BytePairs):
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        answer = self[pair] = self.vocabulary.first_join(*divmod(pair, self.vocabulary.n)) is None
        return answer


class BytePairs:
    """A byte-level BPE vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or spec["normalizer"] or cutter.get("type") != "ByteLevel"
                or cutter.get("add_prefix_space") or not cutter.get("use_regex")
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                              "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])):
            raise ValueError("only plain byte-level BPE vocabularies")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        byte_of = _byte_characters()
        tokens = {t: bytes(map(byte_of.__getitem__, t)) for t in model["vocab"]}
        n = self.n = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for t, i in model["vocab"].items():
            self.bytes[i] = tokens[t]
        for t, i in self.special.items():
            self.bytes[i] = t.encode("utf-8")
        self.decimal = list(map(str, range(n)))
        # A token made by a merge, its rank and its two sides; single bytes have rank -1.
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        vocabulary = model["vocab"]
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.made[k] >= 0:
                raise ValueError("a token must be made by one merge")
            self.rank[i * n + j] = r
            self.made[k], self.left[k], self.right[k] = r, i, j
        self.apart = _Apart(self)
        # Tokens that are the encoding of their own bytes, by their bytes.
        self.ids: dict[bytes, int] = {}
        whole = [False] * n
        for i in sorted(vocabulary.values(), key=self.made.__getitem__):
            a, b = self.left[i], self.right[i]
            whole[i] = (len(self.bytes[i]) == 1 if a < 0
                        else whole[a] and whole[b] and self.first_join(a, b) == self.made[i])
            if whole[i]:
                self.ids[self.bytes[i]] = i
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("every byte must have a token")
        self.longest = max(map(len, self.ids))
        self.words = ByteCache(weight=10)

    # -- words ------------------------------------------------------------

    def first_join(self, a: int, b: int) -> int | None:
        """The rank of the merge that joins bytes across the border of two
        adjacent tokens, None if none does.  Symbols of one rank are made from
        the left, so of two equal ones the right one is the younger."""
        rank, made, n = self.rank, self.made, self.n
        never = len(rank)
        a_used = b_used = never
        found = None
        while True:
            r = rank.get(a * n + b)
            if r is not None and r < a_used and r <= b_used:
                found = r
            if made[a] < 0 and made[b] < 0:
                return found
            if made[a] > made[b]:
                a, a_used = self.right[a], made[a]
            else:
                b, b_used = self.left[b], made[b]

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in byte order.

        Words in byte order are their trie in depth-first order: what a word
        shares with the one before is the path that both have in common, and
        the last tokens along that path are still there."""
        token_at, n, longest, apart = self.ids.get, self.n, self.longest, self.apart
        if len(apart) > PAIRS:
            apart.clear()
        path = b""
        last, begins = [-1], [0]          # the last token of each prefix of the path, and its start
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], begins[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                # Only one start is right.  Most often the last token grows by a
                # byte, or the byte stands alone.
                start = begins[-1]
                t = token_at(word[start:end])
                if t is None or (start and not apart[last[start] * n + t]):
                    for start in (end - 1, *range(start + 1, end - 1), *range(start - 1, max(-1, end - longest - 1), -1)):
                        t = token_at(word[start:end])
                        if t is not None and (start == 0 or apart[last[start] * n + t]):
                            break
                last.append(t)
                begins.append(start)
            path = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end = begins[end]
            out.reverse()
            yield word, out

    # -- texts ------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if PLAIN.fullmatch(text):
            return WORD.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def text_words(self, text: str, special: bool = True) -> list[str]:
        """The words of a text; special strings are words if ``special``."""
        if special and self.special_cut and any(s in text for s in self.special):
            parts = self.special_cut.split(text)
            return [w for p in parts if p for w in ([p] if p in self.special else self.cut(p))]
        return self.cut(text)

    def know(self, words: set[str]) -> None:
        """Encode the words that are not held yet: ids as decimals joined by
        commas, their number, and the bytes they decode to."""
        self.words.turn()
        new = self.words.missing(words)
        held, decimal = self.words.new, self.decimal
        for s in self.special:
            if s in words:
                held[s] = (str(self.special[s]), 1, s.encode("utf-8"))
        for word, ids in self.encode_words(w.encode("utf-8") for w in new if w not in self.special):
            held[word.decode("utf-8")] = (",".join([decimal[i] for i in ids]), len(ids), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join([self.bytes[i] for i in ids])

    def encode(self, texts: list[str]) -> tuple[list[str], list[int], list[str]]:
        """Of each text: ids as decimals joined by commas, their number, and the
        text decoded from them."""
        split = [self.text_words(t) for t in texts]
        self.know(set().union(*split))
        get = self.words.new.__getitem__
        ids, count, decoded = [], [], []
        for words in split:
            parts = list(map(get, words))
            ids.append(",".join([p[0] for p in parts]))
            count.append(sum([p[1] for p in parts]))
            decoded.append(b"".join([p[2] for p in parts]).decode("utf-8", "replace"))
        return ids, count, decoded


_OPEN: dict[str, BytePairs] = {}


def opened(path: str) -> BytePairs:
    """The vocabulary of a file, once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = BytePairs(path)
    return _OPEN[path]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (decimal ids joined by commas), ``n_tokens`` and
    ``decoded``."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = opened(tokenizer)
        for part in parts:
            for run, texts in batches.runs(part, "text"):
                ids, count, decoded = pairs.encode(texts)
                yield pa.record_batch(
                    [run.column("id"), pa.array(ids, pa.string()), pa.array(count, pa.int64()),
                     pa.array(decoded, pa.string())], names=["id", "ids", "n_tokens", "decoded"])

    return rows.mapInArrow(
        encode, f"id {id_type}, ids string, n_tokens long, decoded string").withColumnRenamed("id", id_col)
