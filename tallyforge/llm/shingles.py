"""Word shingles of whole texts as 64-bit hashes, computed over a batch of texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(1 << 20, 1 << n.bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _powers["down"] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased ``data``, and how many each text has; text i begins at starts[i]; starts has the end too.

    Texts must be set apart by a white-space byte.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    low, word = _LOWER[data], ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    at, end = edge[::2], edge[1::2]
    up, down = _inverse_powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], dtype=np.uint64)])
    hashes = mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(at, starts))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, as sorted hashes.

    A-Z count as a-z, words are runs of bytes other than the six ASCII spaces; a text of fewer words has its whole
    sequence as its one shingle; one without words, or null, has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        hashes, counts = words(data, starts)
        ends = np.cumsum(counts)
        n = len(hashes)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + hashes[k : n - width + 1 + k]) if n >= width else rolled
        for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if count >= width:
                out.append(np.unique(rolled[end - count : end - width + 1]))
            elif count:
                one = np.zeros(1, np.uint64)
                for x in hashes[end - count : end]:
                    one = mix(one * np.uint64(0x2545F4914F6CDD1D) + x)
                out.append(mix(one + np.uint64(count)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
