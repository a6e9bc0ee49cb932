"""Words of many texts at once, on their UTF-8 bytes, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa

#: Words are runs of other bytes than these: [^\x20\x09-\x0D]+
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of up to so many bytes are their own key; a longer one has a cryptographic digest.
SHORT = 15
#: Which bytes of eight belong to a word of so many.
HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of words before it (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def keys(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits for each word, equal only for equal words.

    A word of up to SHORT bytes is its bytes and, in the last one, its length: exact. A longer word is a digest of its
    bytes with a last byte that no short word has.
    """
    size = ends - begins
    held = np.concatenate((data, np.zeros(16, np.uint8)))
    eights = np.ndarray((len(data) + 9,), "<u8", held.data, 0, (1,))  # the eight bytes from each place on
    out = np.empty((len(begins), 2), np.uint64)
    out[:, 0] = eights[begins] & HEADS[np.minimum(size, 8)]
    out[:, 1] = eights[begins + 8] & HEADS[np.clip(size - 8, 0, 7)] | np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        digests = b"".join(hashlib.blake2b(data[b:e], digest_size=SHORT).digest() + b"\xff" for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True))
        out[long] = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return out


def folded(keys: np.ndarray) -> np.ndarray:
    """64 bits of each key, well mixed."""
    return mix(keys[:, 0] ^ mix(keys[:, 1] ^ np.uint64(0xA24BAED4963EE407)))


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return folded(keys(data, begins, ends))


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the number of its distinct word; for each distinct word one place where it stands, and its key."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    own = keys(data, begins, ends)
    codes, _ = pd.factorize(folded(own))
    first = _firsts(codes)
    if (own != own[first[codes]]).any():  # two words have one hash
        codes, _ = pd.MultiIndex.from_arrays([own[:, 0], own[:, 1]]).factorize()
        first = _firsts(codes)
    return codes, first, own[first]


def _firsts(codes: np.ndarray) -> np.ndarray:
    first = np.full(int(codes.max()) + 1, -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


class Memory:
    """Numbers distinct words in the order in which they were added, by their keys: an open hash table in arrays."""

    def __init__(self, expected: int = 0):
        self.count, self.keys = 0, np.zeros((1 << 10, 2), np.uint64)
        self._room(expected)

    def _room(self, most: int) -> None:
        """Empty slots for so many words, half as many again at least."""
        self.mask = (1 << max(8, (3 * most // 2).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (folded(keys) & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            held = self.slots[slot]
            same = (held >= 0) & (self.keys[held] == keys[left]).all(axis=1)
            out[left[same]] = held[same]
            on = (held >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for words that are distinct and unknown. The table grows with them."""
        to = self.count + len(keys)
        while to > len(self.keys):
            self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)))
        self.keys[self.count : to] = keys
        numbers = np.arange(self.count, to)
        self.count = to
        if 3 * to > 2 * len(self.slots):
            self._room(2 * to)
            self._place(np.arange(to))
        else:
            self._place(numbers)
        return numbers

    def _place(self, numbers: np.ndarray) -> None:
        left, slot = numbers, (folded(self.keys[numbers]) & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several for one slot the last stays
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + 1) & self.mask


class Ragged:
    """Lists of ids that only grow, by number."""

    def __init__(self, kind: type):
        self.ids, self.used = np.zeros(1 << 12, kind), 0
        self.begins, self.lengths, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Appends so many lists that lie end to end."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        to = self.count + len(lengths)
        while to > len(self.begins):
            self.begins, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.begins, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begins[self.count : to] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : to] = lengths
        self.used, self.count = self.used + len(flat), to

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers end to end, and their lengths."""
        lengths = self.lengths[numbers].astype(np.int64)
        return self.ids[gather(self.begins[numbers], lengths)], lengths


def pieces(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words themselves."""
    whole = data.tobytes()
    return [whole[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def cut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given spans end to end, and where each begins (one more entry than spans)."""
    return data[gather(begins, ends - begins)], np.concatenate(([0], np.cumsum(ends - begins)))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings that lie end to end; under 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges starts[i] .. starts[i] + lengths[i], one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
