"""A minimal acyclic transducer: words to positive numbers, over UTF-8 bytes, in flat arrays.

States with equal futures are shared while the sorted words come in, so suffixes are stored
once.  The output of a word is the sum of the outputs along its path, which is its place among
the sorted words; a second flat array has the ids of each place.  The file is memory-mapped.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

MAGIC = b"GWLEX1\0\0"


def compile_words(entries: dict[str, list[int]]) -> bytes:
    """The file for words and their ids."""
    words = sorted(w.encode() for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # minimised: final, arcs

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], list(node[1])))
        return register[key]

    path: list[list] = [[False, []]]
    before = b""
    for w in words:
        k = 0
        while k < min(len(w), len(before)) and w[k] == before[k]:
            k += 1
        while len(path) > k + 1:
            child = freeze(path.pop())
            path[-1][1].append((before[len(path) - 1], child))
        for _ in w[k:]:
            path.append([False, []])
        path[-1][0] = True
        before = w
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1][1].append((before[len(path) - 1], child))
    root = freeze(path[0])

    count = np.zeros(len(states), np.int64)
    first = np.zeros(len(states) + 1, np.uint32)
    labels, targets, outputs = bytearray(), [], []
    for i, (final, arcs) in enumerate(states):  # children come before their parents
        n = int(final)
        for label, child in arcs:
            labels.append(label)
            targets.append(child)
            outputs.append(n)
            n += int(count[child])
        count[i] = n
        first[i + 1] = len(targets)
    final = np.array([f for f, _ in states], np.uint8)
    ids = [entries[w.decode()] for w in words]
    start = np.zeros(len(ids) + 1, np.uint32)
    start[1:] = np.cumsum([len(x) for x in ids])
    flat = np.array([i for x in ids for i in x], np.uint32)
    arrays = [first, np.array(targets, np.uint32), np.array(outputs, np.uint32), start, flat, final, np.frombuffer(bytes(labels), np.uint8)]
    head = MAGIC + struct.pack("<8I", root, *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Looks words up in a mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, *sizes = struct.unpack_from("<8I", self.map, 8)
        at, out = 40, []
        for n, kind in zip(sizes, (np.uint32,) * 5 + (np.uint8,) * 2, strict=True):
            out.append(np.frombuffer(self.map, kind, n, at))
            at += out[-1].nbytes
        self.first, self.targets, self.outputs, self.start, self.flat, self.final, self.labels = out
        self.data = self.flat.tobytes()

    def get_many(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as little-endian words of 32 bits, or None if it is not in the lexicon.
        All words go from state to state in step; an arc is found by halving those of its state."""
        out: list[bytes | None] = [None] * len(words)
        coded = [w.encode() for w in words]
        size = np.array([len(b) for b in coded], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1] if len(words) else size
        text = np.frombuffer(b"".join(coded), np.uint8)
        at = np.flatnonzero(size > 0)
        state, place = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            ended = size[at] == step
            if ended.any():
                hit = np.flatnonzero(ended & (self.final[state] > 0))
                for i, p in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
                    out[i] = self.data[4 * int(self.start[p]) : 4 * int(self.start[p + 1])]
                at, state, place = at[~ended], state[~ended], place[~ended]
            byte = text[begin[at] + step]
            lo, end = self.first[state].astype(np.int64), self.first[state + 1].astype(np.int64)
            hi = end.copy()
            while (busy := lo < hi).any():
                mid = (lo + hi) // 2
                less = self.labels[np.minimum(mid, len(self.labels) - 1)] < byte
                lo, hi = np.where(busy & less, mid + 1, lo), np.where(busy & ~less, mid, hi)
            lo_ = np.minimum(lo, len(self.labels) - 1)
            ok = (lo < end) & (self.labels[lo_] == byte)
            at, place, state = at[ok], place[ok] + self.outputs[lo_[ok]], self.targets[lo_[ok]].astype(np.int64)
            step += 1
        return out

    def get(self, word: str) -> list[int] | None:
        """The ids of a word, or None if it is not in the lexicon."""
        found = self.get_many([word])[0]
        return None if found is None else np.frombuffer(found, np.uint32).tolist()
