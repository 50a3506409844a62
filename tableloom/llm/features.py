"""Text features and small linear solvers for the classifiers."""

from __future__ import annotations

import numpy as np

#: Letters are compared without case; digits and marks are left out of character n-grams.
_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(97, 123), *range(128, 256)]] = True
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Bytes of a text looked at together; longer texts are counted in parts that overlap.
PART = 1 << 20


def ngram_counts(text: str, bits: int) -> np.ndarray:
    """Hashed counts of the byte 1- to 4-grams of the lower-cased letters of a whole text; other characters become one space."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(1 << bits, np.int64)
    for k in range(0, len(data), PART):
        part = data[max(0, k - 3):k + PART]
        letters = _KEEP[part]
        part = np.where(letters, part, 32)
        part = part[letters | np.concatenate([[True], letters[:-1]])].astype(np.uint64)  # one space for a run of others
        code = part.copy()
        for n in range(1, 5):
            if len(part) < n:
                break
            if n > 1:
                code = (code[:-1] << np.uint64(8)) | part[n - 1:]
            index = ((code + np.uint64(n)) * _MULTIPLIERS[n % 3]) >> np.uint64(64 - bits)
            counts += np.bincount(index.astype(np.int64), minlength=1 << bits)
    return counts


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1 (zero rows stay)."""
    x = np.sqrt(counts).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine with squared hinge loss; ``y`` is 1 or -1.

    Newton steps on the rows inside the margin, each solved by conjugate gradients.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    y = y.astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    weight = (np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c).astype(x.dtype)

    def loss(v):
        return 0.5 * v @ v + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], weight[active]
        gradient = w + 2 * xa.T @ (ca * (xa @ w - ya))
        if np.abs(gradient).max() < 1e-3:
            break
        step = np.zeros_like(w)
        r = -gradient
        p, rr = r.copy(), r @ r
        for _ in range(20):
            hp = p + 2 * xa.T @ (ca * (xa @ p))
            a = rr / (p @ hp)
            step += a * p
            r = r - a * hp
            new = r @ r
            if new < 1e-4 * (gradient @ gradient):
                break
            p, rr = r + new / rr * p, new
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = (w + size * step).astype(x.dtype)
    return w
