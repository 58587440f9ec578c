"""An open-addressing hash table over numpy arrays: 64-bit keys to row numbers, looked up and filled by whole arrays."""

import numpy as np

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class HashTable:
    """Keys get the numbers 0, 1, 2 ... in the order in which they are added. Doubles when half full."""

    def __init__(self, keys=(), bits=12):
        keys = np.asarray(keys, np.uint64)
        while (1 << bits) < 2 * len(keys) + 2:
            bits += 1
        self._clear(bits)
        if len(keys):
            self.add(keys)

    def _clear(self, bits):
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys):
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        """Row numbers, -1 where a key is absent."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        slot, last = self._slots(keys), len(self.keys) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, keys):
        """Adds distinct keys that are not there yet."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys != 0
            old, rows = self.keys[used], self.rows[used]
            bits = self.bits
            while (1 << bits) < 2 * (self.n + len(keys)) + 2:
                bits += 1
            n = self.n
            self._clear(bits)
            self._place(old, rows)
            self.n = n
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys, rows):
        slot, last = self._slots(keys), len(self.keys) - 1
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.rows[slot[won]] = rows[won]
            mine = self.keys[slot[open_]] == keys[open_]
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & last
