"""Hashes of words and of word shingles, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

U = np.uint64

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of texts that are hashed together (a longer text goes alone).
BLOCK = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
_LENGTH = U(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`, with A-Z in lower case, in order; none for null."""
    waiting: list[bytes] = []
    length = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if waiting and length + len(data) > BLOCK:
            yield from _hashed(waiting)
            waiting, length = [], 0
        waiting.append(data)
        length += len(data) + 1
    if waiting:
        yield from _hashed(waiting)


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    """A word's hash starts from its length and takes eight bytes at each step, mixed with all before: no sum or polynomial, under which words of repeated parts would meet. Long words take XXH3."""
    joined = b" ".join([*texts, b"       "])  # eight bytes can be read from any place in a word
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    borders = np.flatnonzero(np.append(True, space[:-1]) != space)
    starts, ends = borders[: len(borders) // 2 * 2 : 2], borders[1::2]
    eights = np.ndarray(len(data) - 7, "<u8", joined, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _LENGTH)
    now = np.flatnonzero(left <= LONG)
    for step in range(LONG // 8):
        rest = left[now] - 8 * step
        chunk = eights[starts[now] + 8 * step] & _MASKS[np.minimum(rest, 8)]
        h[now] = mix(h[now] ^ chunk)
        now = now[rest > 8]
        if not len(now):
            break
    for k in np.flatnonzero(left > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.split(h, np.searchsorted(starts, np.cumsum(sizes)[:-1]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingled(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words (of all words, if there are fewer) and how often each occurs."""
    n = len(words)
    if n == 0:
        return words, np.zeros(0, np.int64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = h * U(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
    return np.unique(mix(h), return_counts=True)
