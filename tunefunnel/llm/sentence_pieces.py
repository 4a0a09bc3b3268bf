"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by
the piece's score, then from the left; it takes the best pair, merges it, and
enters the pairs that the new symbol forms, until none is left.  Characters
without a piece fall back to byte pieces.

A place between two characters that no piece holds side by side can never be
merged over, so each distinct chunk (a word with its blanks) is cut there into
atoms.  Short atoms are merged together in numpy rounds: a round takes the best
pair of every atom.  Long ones use a heap.

Every distinct chunk is checked against the ``sentencepiece`` library and decoded
by it, many in one call.  If the library ever differs, its ids are taken and the
row says so in ``checked``.

Defined cases: null counts as empty; the empty text has no ids and decodes to
itself; null ids and repeated rows are encoded row by row; other columns are
ignored; an empty table gives an empty result.  Only vocabularies of merge type
with byte fallback, dummy prefix and no other normalisation are accepted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .caches import ByteCache
from .common import python_ready, text_or_empty
from .word_pieces import batched

#: SentencePiece writes blanks as this character.
BLANK = "▁"
#: Atoms of more characters are merged with a heap, the rest in numpy rounds.
LONG_ATOM = 64
#: Bytes of a generation of the cache of chunks.
CHUNK_BYTES = 96 << 20
#: The rank of a pair that forms no piece.
_NONE = np.int64(2**62)


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        if (spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback
                or spec.trainer_spec.treat_whitespace_as_suffix or spec.normalizer_spec.precompiled_charsmap
                or not spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces
                or not spec.normalizer_spec.escape_whitespaces):
            raise ValueError("only merge-type vocabularies with byte fallback and no normalisation")
        normal = proto.ModelProto.SentencePiece.NORMAL
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == normal}
        self.bytes = {p.piece: i for i, p in enumerate(spec.pieces)
                      if p.type == proto.ModelProto.SentencePiece.BYTE}
        n = self.n = len(spec.pieces)
        # Symbols: a piece by its id, a character without a piece by n + code point.
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        scores = sorted({-spec.pieces[i].score for i in self.ids.values()})
        rank = {s: r for r, s in enumerate(scores)}
        pairs: dict[int, tuple[int, int]] = {}
        side_by_side = set()
        for piece, i in self.ids.items():
            side_by_side.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = (rank[-spec.pieces[i].score], i)
        self.side_by_side = np.array(sorted((ord(a) << 21) | ord(b) for a, b in side_by_side), dtype=np.int64)
        self.byte_ids = np.array([self.bytes[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int64)
        self.decimal = pa.array(list(map(str, range(n))), pa.large_string())
        self.pairs = pairs
        keys = sorted(pairs)
        self.pair_keys = np.array(keys, dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys], dtype=np.int64)
        self.pair_piece = np.array([pairs[k][1] for k in keys], dtype=np.int64)
        self.blank_starts = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        self.chunks = ByteCache(CHUNK_BYTES)

    # -- the agenda -------------------------------------------------------

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank ``_NONE`` for no piece."""
        key = left * self.n + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        known = (self.pair_keys[at] == key) & (left < self.n) & (right < self.n)
        return np.where(known, self.pair_rank[at], _NONE), self.pair_piece[at]

    def merge_all(self, atoms: list[str]) -> list[list[int]]:
        """The symbols left of each atom, merged in rounds over all atoms."""
        lengths = np.fromiter(map(len, atoms), dtype=np.int64, count=len(atoms))
        symbols = self.symbol[_code_points(atoms)]
        symbols, left = self._merge_rounds(symbols, np.repeat(np.arange(len(atoms)), lengths))
        cuts = np.cumsum(np.bincount(left, minlength=len(atoms))).tolist()
        flat = symbols.tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _merge_rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left and their owners, from symbols put together by owner."""
        ranks = np.full(len(symbols), _NONE)
        merged = np.zeros(len(symbols), dtype=np.int64)

        def look(at: np.ndarray) -> None:
            ranks[at], merged[at] = self._looked_up(symbols[at], symbols[at + 1])

        look(np.flatnonzero(owner[:-1] == owner[1:]))
        done_owner, done_symbols = [owner[:0]], [symbols[:0]]
        while len(symbols):
            starts = np.concatenate([[0], np.flatnonzero(owner[:-1] != owner[1:]) + 1])
            sizes = np.diff(np.append(starts, len(symbols)))
            # The best pair of each atom: least rank, then leftmost.
            place = np.arange(len(symbols))
            agenda = np.where(ranks == _NONE, _NONE, (ranks << np.int64(36)) | place)
            best = np.minimum.reduceat(agenda, starts)
            open_ = best != _NONE
            if not open_.all():
                ended = np.repeat(~open_, sizes)
                done_owner.append(owner[ended])
                done_symbols.append(symbols[ended])
            at = best[open_] & ((1 << 36) - 1)
            symbols[at] = merged[at]
            keep = np.repeat(open_, sizes)
            keep[at + 1] = False
            ranks[at] = _NONE
            shifted = np.cumsum(keep) - 1
            at = shifted[at]
            symbols, owner, ranks, merged = symbols[keep], owner[keep], ranks[keep], merged[keep]
            right = at[at + 1 < len(symbols)]
            right = right[owner[right] == owner[right + 1]]
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            look(np.concatenate([left, right]))
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def merge_one(self, atom: str) -> list[int]:
        """The symbols left of one atom, with a heap and a linked list."""
        symbols = self.symbol[np.frombuffer(atom.encode("utf-32-le"), dtype="<u4")].tolist()
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def enter(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and symbols[i] < self.n and symbols[j] < self.n:
                found = self.pairs.get(symbols[i] * self.n + symbols[j])
                if found is not None:
                    heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            enter(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            symbols[i] = self.pairs[left * self.n + right][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            enter(before[i])
            enter(i)
        return [s for s in symbols if s >= 0]

    def _ids(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids and their owners, characters without a piece as byte pieces."""
        other = symbols >= self.n
        if not other.any():
            return symbols, owner
        written = [chr(c).encode("utf-8") for c in (symbols[other] - self.n).tolist()]
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[other] = list(map(len, written))
        ids = np.repeat(symbols, sizes)
        ids[np.repeat(other, sizes)] = self.byte_ids[np.frombuffer(b"".join(written), dtype=np.uint8)]
        return ids, np.repeat(owner, sizes)

    # -- chunks -----------------------------------------------------------

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks after each other, and where each chunk's ids
        end.  Chunks are cut into atoms wherever no piece holds both neighbours."""
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        points = _code_points(chunks)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        pair = (points[:-1] << 21) | points[1:]
        at = np.searchsorted(self.side_by_side, pair)
        at[at == len(self.side_by_side)] = 0
        begins = np.concatenate([[True], (self.side_by_side[at] != pair) | (chunk[1:] != chunk[:-1])])
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(points)))
        atom = np.cumsum(begins) - 1
        long = np.flatnonzero(sizes > LONG_ATOM)
        short = np.repeat(sizes <= LONG_ATOM, sizes)
        symbols, owner = self._merge_rounds(self.symbol[points[short]], atom[short])
        if len(long):
            text = "".join(chunks)
            heaped = [self.merge_one(text[starts[i]:starts[i] + sizes[i]]) for i in long.tolist()]
            owner = np.concatenate([owner, np.repeat(long, list(map(len, heaped)))])
            symbols = np.concatenate([symbols, *(np.array(h, dtype=np.int64) for h in heaped)])
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        ids, owner = self._ids(symbols, owner)
        return ids, np.cumsum(np.bincount(chunk[starts][owner], minlength=len(chunks)))

    def text_chunks(self, text: str) -> list[str]:
        """A text's chunks, each without its first blank, which all have: the
        dummy prefix gives it to the first one."""
        if not text:
            return []
        if "  " not in text and BLANK not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in regex.findall(f"{BLANK}+[^{BLANK}]*", (" " + text).replace(" ", BLANK))]

    def know(self, chunks: set[str]) -> None:
        """Encode the chunks that are not held yet, and check them against the
        library: decimal ids joined by commas; where the decoded text is not the
        chunk after a blank, or the library disagrees, also the decoded text with
        its first blank, and whether it agrees.  Chunks without blanks are chunks
        again when put together, so many are checked and decoded in one call."""
        self.chunks.turn()
        new = self.chunks.missing(chunks)
        plain = [c for c in new if c and BLANK not in c]
        for part in batched(plain):
            ids, ends = self.merge([BLANK + c for c in part])
            text, flat = " ".join(part), ids.tolist()
            if self.library.encode(text) == flat and self.library.decode(flat) == text:
                self.chunks.new.update(zip(part, self._decimals(ids, ends)))
            else:
                self._know_alone(part)
        if len(plain) < len(new):
            self._know_alone([c for c in new if not c or BLANK in c])

    def _know_alone(self, new: list[str]) -> None:
        """``know`` with each chunk checked and decoded alone."""
        merged, ends = self.merge([BLANK + c for c in new])
        flat, ends = merged.tolist(), ends.tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        # The library gives its own dummy prefix, the chunk's first blank; it
        # gives none to the empty text, so a lone blank is not asked.
        asked = [c.replace(BLANK, " ") for c in new]
        theirs = self.library.encode(asked, num_threads=1)
        decoded = self.library.decode(ids, num_threads=1)
        for c, text, mine, their, back in zip(new, asked, ids, theirs, decoded):
            agrees = mine == their or not text
            if not agrees:
                mine, back = their, self.library.decode(their)
            self.chunks.new[c] = (",".join(map(str, mine)), " " + back if text else " ", agrees)

    def _decimals(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The ids up to each end as decimals joined by commas."""
        cuts = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = pa.ListArray.from_arrays(cuts, self.decimal.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string())).to_numpy(zero_copy_only=False).tolist()

    def encode(self, texts: list[str]) -> tuple[list[str], list[str], list[bool]]:
        """Of each text: ids as decimals joined by commas, the text decoded from
        them, and whether the library agreed on all its chunks."""
        split = [self.text_chunks(t) for t in texts]
        self.know(set().union(*split))
        get = self.chunks.new.__getitem__
        ids, decoded, checked = [], [], []
        for s in split:
            parts = list(map(get, s))
            try:
                ids.append(",".join(parts))
                decoded.append(" ".join(s))
                checked.append(True)
            except TypeError:        # some chunk has more than its ids
                parts = [(p, " " + c, True) if isinstance(p, str) else p for c, p in zip(s, parts)]
                ids.append(",".join([p[0] for p in parts]))
                decoded.append("".join([p[1] for p in parts])[1:])
                checked.append(all([p[2] for p in parts]))
        return ids, decoded, checked


def _code_points(texts: list[str]) -> np.ndarray:
    """The code points of texts put together."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)


_OPEN: dict[str, Pieces] = {}


def opened(path: str) -> Pieces:
    """The vocabulary of a file, once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (decimal ids joined by commas), ``n_tokens``,
    ``decoded`` and ``checked``."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(model)
        for part in parts:
            for run, texts in batches.runs(part, "text"):
                ids, decoded, checked = pieces.encode(texts)
                count = [x.count(",") + 1 if x else 0 for x in ids]
                yield pa.record_batch(
                    [run.column("id"), pa.array(ids, pa.string()), pa.array(count, pa.int64()),
                     pa.array(decoded, pa.string()), pa.array(checked, pa.bool_())],
                    names=["id", "ids", "n_tokens", "decoded", "checked"])

    return rows.mapInArrow(
        encode, f"id {id_type}, ids string, n_tokens long, decoded string, checked boolean"
    ).withColumnRenamed("id", id_col)
