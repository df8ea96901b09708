"""Word and byte features of texts as numpy arrays: whole arrays per text, no loop over words."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit number for every byte value, for prefix-sum hashes modulo 2**64.
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS = {"n": 0}
#: Texts are walked in stretches of about so many bytes, cut between words, so memory stays bounded.
STRETCH = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters and the bytes of longer code points.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j below n at least."""
    if _POWERS["n"] < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["n"] = m
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def stretches(raw: bytes, gaps: np.ndarray = SPACES):
    """raw as byte arrays of about STRETCH, cut where ``gaps`` holds."""
    at, n = 0, len(raw)
    whole = np.frombuffer(raw, np.uint8)
    while at < n:
        end = min(n, at + STRETCH)
        while end < n:
            found = np.flatnonzero(gaps[whole[end : end + STRETCH]])
            if len(found):
                end += int(found[0])
                break
            end = min(n, end + STRETCH)
        yield whole[at:end]
        at = end


def spans(a: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.ones(len(a) + 2, np.int8)
    edge[1:-1] = gaps[a]
    at = np.flatnonzero(np.diff(edge))
    return at[0::2], at[1::2]


def prefix_sums(a: np.ndarray) -> np.ndarray:
    up, _ = powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(TABLE[a] * up[: len(a)], out=sums[1:], dtype=np.uint64)
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for the same bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: bytes, gaps: np.ndarray = SPACES) -> np.ndarray:
    found = []
    for a in stretches(raw, gaps):
        starts, ends = spans(a, gaps)
        found.append(span_hashes(prefix_sums(a), starts, ends))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lowered.

    With fewer words than a shingle has, the whole sequence is one; no words: empty.
    """
    h = word_hashes(raw.lower()) if raw else np.zeros(0, np.uint64)
    if not len(h):
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + h[j : j + n])
    return np.unique(out)


def ngram_counts(raw: bytes, bits: int, orders=(1, 2, 3)) -> np.ndarray:
    """Counts of byte n-grams hashed into 2**bits cells; long texts in stretches."""
    total = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(raw), STRETCH):
        a = np.frombuffer(raw[at : at + STRETCH + 2], np.uint8).astype(np.uint32)
        code = np.zeros(len(a), np.uint32)
        for order in range(1, max(orders) + 1):
            n = len(a) - order + 1
            if n <= 0:
                break
            code = code[:n] * np.uint32(256) + a[order - 1 :]
            if order in orders:
                total += np.bincount((code * np.uint32(2654435761) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> shift, minlength=1 << bits)
    return total


def unit_sqrt(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a vector of length 1, or zeros."""
    total = counts.sum()
    return np.sqrt(counts / total, dtype=np.float32) if total else counts.astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 150, pairs: np.ndarray | None = None, pair_weight: float = 0.0) -> np.ndarray:
    """Logistic weights (last row: intercepts) for one or more 0/1 targets, by Nesterov steps.

    pairs: differences of feature rows whose scores should not change; their squared
    scores are penalised by pair_weight.
    """
    n, d = x.shape
    y = y.reshape(n, -1).astype(np.float32)
    weight = np.ones((n, 1), np.float32) if weight is None else weight.reshape(n, 1).astype(np.float32)
    weight = weight / max(float(weight.sum()), 1e-9)
    w = np.zeros((d + 1, y.shape[1]), np.float32)
    ahead, t = w.copy(), 1.0
    top = float(((x * x).sum(1, keepdims=True) * weight).sum()) + 1.0
    if pairs is not None and len(pairs):
        top += 8 * pair_weight * float((pairs * pairs).sum(1).mean())
    rate = 4.0 / (top + 4 * ridge)
    for _ in range(steps):
        z = x @ ahead[:-1] + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.vstack([x.T @ g + ridge * ahead[:-1], g.sum(0, keepdims=True)])
        if pairs is not None and len(pairs):
            grad[:-1] += (2 * pair_weight / len(pairs)) * (pairs.T @ (pairs @ ahead[:-1]))
        new = ahead - rate * grad
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + ((t - 1) / after) * (new - w), new, after
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
