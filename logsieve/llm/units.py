"""Splitting a text into units that a tokenizer may encode one by one, and a bounded memo of their ids.

A unit starts at a single space between two non-spaces, or is a single newline between two non-spaces: places where
the byte-level pattern always starts a new token.  Texts with any other white space are split at the first kind only."""

from __future__ import annotations

import ctypes
import re
import weakref

import numpy as np
import pyarrow as pa

#: White space other than space and newline, as Python's str.isspace() has it.
_OTHER_SPACE = [chr(i) for i in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_RUNS = ("  ", " \n", "\n ", "\n\n")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def plain(text: str) -> bool:
    """Whether all its white space is single spaces and newlines between two non-spaces."""
    if text[0] in " \n" or text[-1] in " \n":
        return False
    for x in _RUNS:
        if x in text:
            return False
    for x in _OTHER_SPACE[:8] if text.isascii() else _OTHER_SPACE:
        if x in text:
            return False
    return True


def word_units(text: str) -> list[str]:
    """Units whose concatenation is text."""
    if not text:
        return []
    if not plain(text):
        return _SAFE.split(text)
    out = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        words = line.split(" ")
        out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


_LIVE: weakref.WeakSet = weakref.WeakSet()
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Memory that the allocators keep for later goes back to the machine: workers outlive their tasks, and an executor's
    limit counts what all of its workers hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def forget() -> None:
    """Empty all memos of this process: called where a reused worker begins other work, which needs the memory."""
    for memo in list(_LIVE):
        memo.clear()
    give_back()


def grown(values: np.ndarray, least: int) -> np.ndarray:
    """values in an array of at least that length.  What is added is not written, so it takes no memory yet."""
    if len(values) >= least:
        return values
    out = np.empty(max(least, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


class Memo:
    """Token ids of units.  The first `most` units stay; from then on new ones go to a part of a quarter of that size,
    which starts anew when it is full, and after RESTARTS such starts so does the whole memo.

    encode_many(units) gives a list of ids for each unit.  encode_spaced(words) gives (ids of all, lengths) for units
    that are a space and a word without white space.  first_spaced: the first word of a text is such a unit too; split
    cuts texts that are not plain."""

    class _Numbers(dict):
        """Word to unit number; new words get the next one."""

        def __init__(self, memo):
            super().__init__()
            self.memo, self.late, self.fresh, self.fresh_numbers = memo, {}, [], []

        def __missing__(self, word):
            memo = self.memo
            if memo.base is None:
                self[word] = n = memo.count
            else:
                n = self.late.get(word)
                if n is not None:
                    return n
                self.late[word] = n = memo.count
            memo.count += 1
            self.fresh.append(word)
            self.fresh_numbers.append(n)
            return n

    RESTARTS = 24

    def __init__(self, encode_many, encode_spaced=None, most: int = 900_000, first_spaced: bool = False, split=_SAFE.split):
        self.encode_many, self.most, self.first_spaced, self.split = encode_many, most, first_spaced, split
        self.encode_spaced = encode_spaced or (lambda words: _flat(encode_many([" " + w for w in words])))
        self.clear()
        _LIVE.add(self)

    def clear(self):
        self.count, self.base, self.restarts = 0, None, 0
        self.other, self.spaced = self._Numbers(self), self._Numbers(self)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self, numbers, encode):
        if not numbers.fresh:
            return
        ids, sizes = encode(numbers.fresh)
        where = np.array(numbers.fresh_numbers)
        numbers.fresh, numbers.fresh_numbers = [], []
        self.at, self.size = grown(self.at, self.count), grown(self.size, self.count)
        self.ids = grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[where] = sizes
        self.at[where] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(ids)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has (with the end id)."""
        if self.base is None:
            if self.count > self.most:
                self.base = (self.count, self.used)
        elif self.count > self.base[0] + self.most // 4:
            self.restarts += 1
            if self.restarts > self.RESTARTS:
                self.clear()
            else:
                self.count, self.used = self.base
                self.other.late.clear()
                self.spaced.late.clear()
        other, spaced, counts, units, before = self.other.__getitem__, self.spaced.__getitem__, [], [], 0
        newline, begin = other("\n"), spaced if self.first_spaced else other
        append, extend = units.append, units.extend
        for text in texts:
            if not text:
                pass
            elif plain(text):
                for i, line in enumerate(text.split("\n")):
                    words = line.split(" ")
                    if i:
                        append(newline)
                        append(other(words[0]))
                    else:
                        append(begin(words[0]))
                    del words[0]
                    extend(map(spaced, words))
            else:
                units.extend(map(other, self.split(text)))
            counts.append(len(units) - before)
            before = len(units)
        self._learn(self.other, lambda u: _flat(self.encode_many(u)))
        self._learn(self.spaced, self.encode_spaced)
        units = np.array(units, np.int64)
        sizes = self.size[units].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        lengths = at[edges[1:]] - at[edges[:-1]]
        ids = self.ids[np.repeat(self.at[units] - at[:-1], sizes) + np.arange(at[-1])]
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
        return ids, lengths


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum())), sizes
