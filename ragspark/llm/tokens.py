"""Whole texts to token ids with the tokenizers library, a distinct unit of text at a time.

Both vocabularies in use cut a text into pre-tokens before anything else, and cut it between any run of white space and
the non-space before it, and between a letter and a punctuation mark other than the apostrophe. A text is cut at the
places of these kinds that its bytes show beyond doubt; what lies between is a unit, and the ids of a text are those of
its units. Each distinct unit is encoded once per worker process and remembered under its 64-bit hash.
"""

import os
import re

import numpy as np

from ragspark.llm import words as T
from ragspark.llm.hashing import HashTable

#: A worker forgets its units when it has so many.
MAX_UNITS = 500_000

_BYTE = np.arange(256)
_SPACE = (_BYTE == 32) | (_BYTE == 10)
_VISIBLE = (_BYTE > 32) & (_BYTE < 127)
_ALPHA = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_MARK = _VISIBLE & ~_ALPHA & ~((_BYTE >= 48) & (_BYTE <= 57)) & (_BYTE != 39)
# one class per byte: 1 cut-able space, 2 ASCII letter, 4 mark, 8 lead of a two-byte letter, 16 other visible ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[_SPACE], _CLASS[_ALPHA], _CLASS[_MARK] = 1, 2, 4
_CLASS[_VISIBLE & ~_ALPHA & ~_MARK] = 16
_CLASS[0xC3] = 8
_encoders = {}


def unit_starts(data, offsets):
    """Ascending byte positions at which a unit starts; every row that is not empty starts one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    after_lead = np.zeros(n, bool)
    after_lead[1:] = (kind[:-1] == 8) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter_end = (kind == 2) | after_lead
    lead = np.zeros(n, bool)
    lead[:-1] = after_lead[1:]
    letter_start = (kind == 2) | lead
    visible_end = letter_end | (kind == 4) | (kind == 16)
    start = np.zeros(n, bool)
    start[1:] = (visible_end[:-1] & (kind[1:] == 1)) | (letter_end[:-1] & (kind[1:] == 4)) | ((kind[:-1] == 4) & letter_start[1:])
    edge = offsets[:-1]
    start[edge[edge < n]] = True
    return np.flatnonzero(start)


class UnitEncoder:
    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError(f"{path} has added tokens that depend on the text around them")
        self.added = re.compile(b"|".join(re.escape(c) for c in sorted((t.content.encode() for t in added), key=len, reverse=True)) or b"(?!)")
        self._forget()

    def _forget(self):
        self.table = HashTable(bits=16)
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def units(self, texts):
        """Ids of every unit."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, data, offsets):
        start = unit_starts(data, offsets)
        raw = data.tobytes()
        spans = []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()) if self.added.search(raw) else ():
            spans += [m.span() for m in self.added.finditer(raw, a, z)]
        if not spans:
            return start
        first, stop = np.array(spans, np.int64).T
        at = np.searchsorted(first, start, "right") - 1
        inside = (at >= 0) & (start > first[at]) & (start < stop[at])
        return np.unique(np.concatenate((start[~inside], first, stop[stop < len(data)])))

    def _learn(self, hashes, texts):
        encoded = self.units(texts)
        n, size = self.table.n, np.fromiter(map(len, encoded), np.int64, len(encoded))
        while n + len(size) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + size.sum() > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.count[n : n + len(size)] = size
        self.first[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + size.sum()] = np.fromiter((i for e in encoded for i in e), np.uint32, size.sum())
        self.used += size.sum()
        self.table.add(hashes)

    def encode(self, data, offsets, end=None):
        """Ids of all rows one after another, and the n + 1 offsets of the rows; ``end`` is appended to every row."""
        if self.table.n > MAX_UNITS:
            self._forget()
        start = self.starts(data, offsets)
        stop = np.append(start[1:], len(data)) if len(start) else start
        up, down = T.powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(T.BYTE_CODE[data] * up[: len(data)], out=total[1:])
        key = T.mix((total[stop] - total[start]) * down[start])
        unit = self.table.find(key)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            raw = data.tobytes()
            texts = [raw[start[i] : stop[i]].decode("utf-8", "replace") for i in missing[at].tolist()]
            self._learn(new, texts)
            unit[missing] = self.table.find(key[missing])
        count = self.count[unit]
        edge = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(count, out=edge[1:])
        ids = self.ids[np.repeat(self.first[unit] - edge[:-1], count) + np.arange(edge[-1])]
        rows = edge[np.searchsorted(start, offsets)]
        if end is not None:
            ids = np.insert(ids, rows[1:], end)
            rows = rows + np.arange(len(rows))
        return ids, rows


def encoder(path):
    """The encoder of this worker process for a tokenizer file that every worker finds at ``path``."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def encoded(column, path, end):
    """Yields (first row, ids, row offsets) for slices of a text column; null texts are empty."""
    own = encoder(path)
    for first, data, offsets in T.slices(column):
        yield first, *own.encode(data, offsets, end)
