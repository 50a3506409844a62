"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text taken at once; the tables of powers reach as far.
PIECE = 1 << 18


def _odd(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") | 1


#: A random number for each byte; A-Z have those of a-z.
_VALUES = np.array([_odd(f"byte {b + 32 if 65 <= b <= 90 else b}") for b in range(256)], dtype=np.uint64)
_SOLID = np.ones(256, np.int8)
_SOLID[[9, 10, 11, 12, 13, 32]] = 0
_BASE = _odd("base")
_STEPS = np.array([_odd(f"word {j}") for j in range(WORDS)], dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, place of each text's first word and the end) for texts that lie at ``offsets`` of the bytes.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums over the whole piece.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    solid = _SOLID[data]
    change = np.empty(n + 1, np.int8)
    change[0], change[-1] = solid[0], -solid[-1]
    np.subtract(solid[1:], solid[:-1], out=change[1:-1])
    starts, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    borders = np.unique(offsets[1:-1])
    borders = borders[(borders > 0) & (borders < n)]
    borders = borders[(solid[borders] == 1) & (solid[borders - 1] == 1)]  # a text that begins where another ends
    if len(borders):
        starts, ends = np.sort(np.append(starts, borders)), np.sort(np.append(ends, borders))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def _joined(words: np.ndarray, span: int) -> np.ndarray:
    h = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        h = h * _STEPS[j] + words[j:len(words) - span + 1 + j]
    return mixed(h)


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    words, edges = word_hashes(data, offsets)
    shingles = _joined(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(shingles[a:b - WORDS + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            yield _joined(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text in UTF-8 the sorted 64-bit hashes of its distinct shingles: five words, or the whole sequence if it is
    shorter; none without words or text. Words are split at ASCII white space after lower-casing A-Z."""
    texts = texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, side="left")) - 1)
        end = min(end, len(texts))
        yield from _sets(data[offsets[k]:offsets[end]], offsets[k:end + 1] - offsets[k])
        k = end


def shingle_set(text: bytes | None) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.binary())))
