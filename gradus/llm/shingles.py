"""Sets of word shingles as sorted arrays of 64-bit hashes, made for many texts at once with numpy.

Words are runs of characters other than space and x09-x0D, with A-Z lower-cased. A text's set holds
its distinct 5-word shingles; a text of fewer words has its whole sequence as one shingle, and a
text without words an empty set. Hashes depend on the words alone, so they agree between workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
CHUNK_BYTES = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_PLACES = np.array([pow(_BASE, 7 * (j + 1), 1 << 64) for j in range(WIDTH)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < size:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every word of lower-cased bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    starts, ends = edge[::2], edge[1::2]
    up, down = _tables(max(len(data), 2 * CHUNK_BYTES))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def _chunk(raws: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(x) + 1 for x in raws])
    starts, hashes = _words(b"\n".join(raws))
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    whole = np.zeros(max(0, len(hashes) - WIDTH + 1), dtype=np.uint64)
    for j in range(WIDTH):
        whole += hashes[j : j + len(whole)] * _PLACES[j]
    whole = mix(whole)
    for s, e in zip(firsts, firsts[1:], strict=False):
        if e - s >= WIDTH:
            yield np.unique(whole[s : e - WIDTH + 1])
        elif e > s:
            yield mix((hashes[s:e] * _PLACES[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order; memory is bounded by a chunk or one text."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().lower()
        if part and size + len(raw) > CHUNK_BYTES:
            yield from _chunk(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield from _chunk(part)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
