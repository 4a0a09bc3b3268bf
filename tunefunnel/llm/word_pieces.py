"""Encoding of whole texts with a ``tokenizers`` file, one distinct part at a
time.

A boundary is safe when the ids of a text are those of its two sides put
together.  Where the tokenizer drops white space, as word-end BPE does, every
run of ASCII white space is a safe boundary; this is probed when the file is
opened, and a tokenizer that keeps white space gets no boundaries at all.

Most texts hold only ASCII and plain Latin letters.  For those the normaliser
only lower-cases, and the pre-tokenizer's pieces, between which boundaries are
safe too, can be found by its pattern; the distinct chunks between white space
of a run of texts are cut into pieces once, and the distinct pieces are looked
up in one call among those held, an Arrow array with their ids.  New pieces go
to the library's model.  All other texts (special strings, other scripts,
combining marks) are cut at white space, and each distinct chunk goes once
through the library's whole pipeline.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of one string given to the library.
BATCH_BYTES = 1 << 16
#: Entries of a cache generation; two generations are held.
CACHE_ENTRIES = 200_000
#: Pieces that stay when twice as many are held, and bytes of such a piece, at most.
KNOWN_ENTRIES, KNOWN_BYTES = 400_000, 64
#: The pre-tokenizer's pattern that the fast way stands for.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters need no normalisation but lower-casing, which
#: stays among them (but for a dot above that it may add).
PLAIN = re.compile("[\t-\r\x20-\x7E\u00C0-\u017F]*")
_LETTERS = "a-z\u00DF-\u00F6\u00F8-\u017F"
#: The same pattern on such a text in lower case.
PIECE = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTERS}0-9]+")
#: The marks of ASCII.
MARKS = string.punctuation


class Cache:
    """Two generations of a dictionary: what is used stays, the rest goes."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.new, self.old = entries, {}, {}

    def missing(self, keys) -> list:
        """The keys that are not held; those that are come into the new generation."""
        gone = set(keys).difference(self.new)
        kept = gone.intersection(self.old)
        self.new.update(zip(kept, map(self.old.__getitem__, kept)))
        return list(gone - kept)

    def turn(self) -> None:
        """Start a new generation when this one is full (between batches)."""
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}


class Known:
    """ids of strings, looked up for many strings in one call.  When full, what
    was found again since it was full before stays, the rest goes."""

    def __init__(self, entries: int = KNOWN_ENTRIES):
        self.entries = entries
        self._hold(pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64))

    def _hold(self, keys: pa.Array, numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.numbers, self.sizes = keys, numbers, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.used = np.zeros(len(keys), dtype=bool)

    def find(self, keys: pa.Array) -> np.ndarray:
        """The place of each distinct key, -1 where it is not held."""
        # The hash table is that of the keys, which are fewer than those held.
        places = pc.fill_null(pc.index_in(self.keys, value_set=keys), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(places >= 0)
        at = np.full(len(keys), -1, dtype=np.int64)
        at[places[held]] = held
        self.used[held] = True
        return at

    def add(self, keys: pa.Array, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hold new keys with their ids; their places."""
        used, first = self.used, len(self.keys)
        self._hold(pa.concat_arrays([self.keys, keys]), np.concatenate([self.numbers, numbers]),
                   np.concatenate([self.sizes, sizes]))
        self.used[:first] = used
        return np.arange(first, len(self.keys))

    def turn(self) -> None:
        """Between batches, when twice the entries are held: keep as many of the
        keys found again, the oldest first, but no long ones."""
        if len(self.keys) > 2 * self.entries or self.keys.nbytes > 2 * KNOWN_BYTES * self.entries:
            short = pc.binary_length(self.keys).to_numpy() <= KNOWN_BYTES
            kept = np.flatnonzero(self.used & short)[:self.entries]
            numbers, _ = batches.gathered(self.numbers, self.starts, self.sizes, kept)
            self._hold(self.keys.take(pa.array(kept)), numbers, self.sizes[kept])


def cut(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of distinct lower-case chunks of plain texts: all pieces after
    each other, the chunks' order among them, and how many each chunk has there.
    Letters alone are one piece, letters and marks are two; the others are cut
    by the pattern."""
    letters = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~letters)
    marked = chunks.take(pa.array(rest))
    stems = pc.ascii_rtrim(marked, characters=MARKS)
    two = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
    others = marked.filter(pa.array(~two))
    found = [PIECE.findall(c) for c in others.to_pylist()]
    marked, stems = marked.filter(pa.array(two)), stems.filter(pa.array(two))
    # A chunk's stem and marks lie after each other in its bytes.
    ends = np.cumsum(pc.binary_length(marked).to_numpy(), dtype=np.int64)
    starts = ends - pc.binary_length(marked).to_numpy()
    bounds = np.zeros(2 * len(ends) + 1, dtype=np.int64)
    bounds[1::2], bounds[2::2] = starts + pc.binary_length(stems).to_numpy(), ends
    halves = pa.LargeStringArray.from_buffers(2 * len(ends), pa.py_buffer(bounds), marked.buffers()[2])
    pieces = pa.concat_arrays([chunks.filter(pa.array(letters)), halves,
                               pa.array([p for x in found for p in x], pa.large_string())])
    order = np.concatenate([np.flatnonzero(letters), rest[two], rest[~two]])
    sizes = np.ones(len(order), dtype=np.int64)
    at = len(order) - len(rest)
    sizes[at:at + len(marked)] = 2
    sizes[at + len(marked):] = list(map(len, found))
    return pieces, order, sizes


class WordPieces:
    """ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuts = self._drops_white_space()
        self.by_piece = bool(self.cuts and suffix and split[0].get("pattern", {}).get("Regex") == WORD_END_PATTERN)
        self.chunks, self.pieces = Cache(), Known()
        if self.by_piece:
            spec["normalizer"] = None
            spec["added_tokens"] = []
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
                {"type": "WhitespaceSplit"},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.model = Tokenizer.from_str(json.dumps(spec))
            vocabulary = self.full.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            for token, i in vocabulary.items():
                self.ends[i] = token.endswith(suffix)

    def _drops_white_space(self) -> bool:
        ids = lambda t: self.full.encode(t, add_special_tokens=False).ids
        return all(ids(f"ab{s}cd") == ids("ab") + ids("cd") and ids(f"{s}ab{s}") == ids("ab")
                   for s in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "))

    def _library(self, chunks: list[bytes]) -> list[bytes]:
        encoded = self.full.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _model_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct pieces with the library's model, many in one call;
        the ids that end a word show where each piece ends.  The ids of all
        pieces after each other, and the number of each piece's."""
        numbers, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for batch in batched(pieces):
            ids = np.array(self.model.encode_batch_fast([" ".join(batch)], add_special_tokens=False)[0].ids,
                           dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(batch) or ends[-1] != len(ids):
                raise ValueError("the pieces' ids do not end where the words end")
            numbers.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(numbers), np.concatenate(sizes)

    def _plain_ids(self, chunks: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct lower-case chunks of plain texts at the places,
        ``gathered``."""
        pieces, order, sizes = cut(chunks)
        codes = pieces.dictionary_encode()
        self.pieces.turn()
        at = self.pieces.find(codes.dictionary)
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = codes.dictionary.take(pa.array(new))
            at[new] = self.pieces.add(missing, *self._model_ids(missing.to_pylist()))
        numbers, after = batches.gathered(self.pieces.numbers, self.pieces.starts, self.pieces.sizes,
                                          at[np.asarray(codes.indices)])
        # Where each chunk's ids start and how many they are, in the order of the chunks.
        bounds = after[np.concatenate([[0], np.cumsum(sizes)])]
        starts, times = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[order], times[order] = bounds[:-1], np.diff(bounds)
        return batches.gathered(numbers, starts, times, places)

    def _is_plain(self, text: str) -> bool:
        return self.by_piece and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.cuts:
            return self._library([t.encode("utf-8") for t in texts])
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._is_plain(t)]
        # Plain texts have no white space but ASCII's.
        lower = pa.array([texts[i].lower() for i in plain], pa.large_string())
        chunks, places, ends = batches.coded(pc.ascii_split_whitespace(lower))
        for i, ids in zip(plain, batches.rows_of(*self._plain_ids(chunks, places), ends)):
            out[i] = ids
        other = sorted(set(range(len(texts))).difference(plain))
        split = [texts[i].encode("utf-8").split() for i in other]
        self.chunks.turn()
        for batch in batched(self.chunks.missing(set().union(*split))):
            self.chunks.new.update(zip(batch, self._library(batch)))
        get = self.chunks.new.__getitem__
        for i, parts in zip(other, split):
            out[i] = b"".join(map(get, parts))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [len(ids) // 4 for ids in self.encode(texts)]


def batched(items: list) -> list[list]:
    """The items in lists of about ``BATCH_BYTES``."""
    out, size = [], BATCH_BYTES
    for x in items:
        if size >= BATCH_BYTES:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x) + 1
    return out


_OPEN: dict[str, WordPieces] = {}


def opened(path: str) -> WordPieces:
    """The encoder of a file, once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = WordPieces(path)
    return _OPEN[path]
