"""Word and shingle hashes of many texts at once, with numpy over the bytes."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes of text for which the arrays are made at once (about 60 bytes each).
BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 5  # 5 modulo 8, so powers differ in their low bits
U = np.uint64


@functools.cache
def _tables(n: int):
    rng = np.random.Generator(np.random.PCG64(20260101))
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    inverse = pow(_P, -1, 1 << 64)
    up = np.ones(n + 1, np.uint64)
    up[1:] = np.cumprod(np.full(n, _P, np.uint64))
    down = np.ones(n + 1, np.uint64)
    down[1:] = np.cumprod(np.full(n, inverse, np.uint64))
    return table, up, down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


WHITE = separators(b" \t\n\v\f\r")


def prefix_sums(block: np.ndarray) -> np.ndarray:
    table, up, _ = _tables(max(BLOCK, 1 << (len(block) - 1).bit_length()) if len(block) else BLOCK)
    out = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(table[block] * up[: len(block)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that depend on their content alone."""
    down = _tables(max(BLOCK, 1 << (len(sums) - 2).bit_length()) if len(sums) > 1 else BLOCK)[2]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * U(0x632BE59BD9B4E019))


def word_bounds(block: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(block) + 2, np.int8)
    inside[1:-1] = ~sep[block]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, sep: np.ndarray = WHITE) -> np.ndarray:
    """The hash of each word of a text, in order; long texts go by in blocks cut between words."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end < len(text):
            block = np.frombuffer(text, np.uint8, end - at, at)
            cut = np.flatnonzero(sep[block])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a block: up to where it ends
                tail = np.flatnonzero(sep[np.frombuffer(text, np.uint8, len(text) - end, end)])
                end = end + int(tail[0]) + 1 if len(tail) else len(text)
        block = np.frombuffer(text, np.uint8, end - at, at)
        s, e = word_bounds(block, sep)
        out.append(range_hashes(prefix_sums(block), s, e))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of n consecutive words; fewer words count as one shingle."""
    if not len(words):
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h = h * U(0xD6E8FEB86659FD93) + words[j : j + m]
    return np.unique(mix(h))
