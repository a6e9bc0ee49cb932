"""A minimal acyclic transducer: words share prefixes and suffixes, the numbers on a word's arcs add up to its place."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TWFS"


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """Compiles distinct words, each with its output ids, to one byte string that open_lexicon() maps.

    Words are added in byte order; a state that no later word can change is looked up among the states made so
    far by its finality and arcs, so equal suffixes are stored once. An arc carries the number of words that sort
    before those below it in its state: the sum over a path is the word's place, where its outputs stand.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    made: dict[tuple, int] = {}
    below: list[int] = []  # of each state, the words that end at or after it
    finals: list[bool] = []
    arcs: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = made.get(key)
        if state is None:
            state = made[key] = len(below)
            below.append(node[0] + sum(below[to] for _, to in key[1]))
            finals.append(bool(node[0]))
            arcs.append(key[1])
        return state

    path: list[list] = [[0, []]]
    last = b""
    for k in order:
        word = words[k]
        if word == last and k != order[0]:
            raise ValueError("a word stands twice")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path += [[0, []] for _ in word[same:]]
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        state = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = freeze(path[0])
    keys, targets, adds = [], [], []
    for state, out in enumerate(arcs):
        before = int(finals[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            adds.append(before)
            before += below[to]
    flat = [i for k in order for i in outputs[k]]
    ends = np.cumsum([0] + [len(outputs[k]) for k in order])
    parts = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(adds, "<i4"), np.array(finals, np.uint8), ends.astype("<i8"), np.array(flat, "<i4")]
    return MAGIC + struct.pack("<q6q", root, *(len(x) for x in parts)) + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)


class Lexicon:
    """Looks words up in what build() made. Words are followed through the arcs all at once, byte by byte."""

    def __init__(self, raw: np.ndarray):
        if raw[:4].tobytes() != MAGIC:
            raise ValueError("not a lexicon")
        self.root, *sizes = struct.unpack("<q6q", raw[4:60].tobytes())
        parts, at = [], 60
        for kind, n in zip(("<i8", "<i4", "<i4", "u1", "<i8", "<i4"), sizes, strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(np.dtype(kind)) if (at % 8 == 0) else np.frombuffer(raw[at : at + size], kind))
            at += size + -size % 8
        self.keys, self.targets, self.adds, self.finals, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't in."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        live = order
        for k in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > k]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | data[begins[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            place[live[~hit]] = -1
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            place[live] += self.adds[at]
        ended = (state >= 0) & (lengths > 0 if not len(self.keys) else True)
        done = np.zeros(len(words), bool)
        done[ended] = self.finals[state[ended]] == 1
        return np.where(done, place, -1)

    def output(self, place: int) -> list[int]:
        return self.ids[self.ends[place] : self.ends[place + 1]].tolist()


def open_lexicon(path: str) -> Lexicon:
    """Maps a file: workers of one machine share its pages, and only those that are looked at are read."""
    return Lexicon(np.memmap(path, np.uint8, "r"))
