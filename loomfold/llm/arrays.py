"""Texts of an Arrow batch as one array of code points, and rolling hashes over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Code points worked on at once: a few arrays of this length stay small beside an executor.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters together; a longer text is a range of its own."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts one after another, and where each text begins and the last ends."""
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null is taken as empty."""
    return [t or "" for t in column.to_pylist()]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(cp: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch comes in one step."""
    up, _ = _powers(len(cp))
    x = (cp.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= up
    out = np.zeros(len(cp) + 1, dtype=U)
    np.cumsum(x, out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hashes of the stretches from ``starts`` up to ``ends``; equal stretches have equal hashes."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes of many ranges, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
