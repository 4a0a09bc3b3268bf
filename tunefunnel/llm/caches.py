"""A dictionary bounded by bytes, for what a Python worker keeps between batches."""

from __future__ import annotations

from collections.abc import Iterable

#: Bytes of the keys and values of a generation, about; two generations are held.
CACHE_BYTES = 48 << 20
#: Bytes that a dictionary entry takes beside its key and value, about.
ENTRY_BYTES = 200


class ByteCache:
    """Two generations of a dictionary: what is used stays, the rest goes.  A
    generation ends when its keys, counted ``weight`` times for their values,
    hold ``limit`` bytes; an entry that alone is a sixteenth of that is kept
    for the batch only."""

    def __init__(self, limit: int = CACHE_BYTES, weight: int = 4):
        self.limit, self.weight = limit, weight
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0
        self.large: list = []

    def missing(self, keys: Iterable) -> list:
        """The distinct keys that are not held; those that are come into the new generation."""
        gone = set(keys).difference(self.new)
        kept = gone.intersection(self.old)
        self.new.update(zip(kept, map(self.old.__getitem__, kept)))
        self._count(gone)
        return list(gone - kept)

    def _count(self, keys) -> None:
        for k in keys:
            size = ENTRY_BYTES + self.weight * len(k)
            if size > self.limit // 16:
                self.large.append(k)
            else:
                self.size += size

    def turn(self) -> None:
        """Between batches: let go of large entries, and start a new generation
        when this one is full."""
        for k in self.large:
            self.new.pop(k, None)
        self.large = []
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
