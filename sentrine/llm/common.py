"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
SPACE = b" \t\n\x0b\f\r"
PIECE = 1 << 20  # bytes of text that are hashed at a time
LONG = 32  # bytes of a word beyond which it has a cryptographic hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher, element by element."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64; tables grow to the longest piece of text seen, which is seldom above ``PIECE``."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_STEP, n), _powers(_BACK, n)
        return self.up[:n], self.down[:n]


POWERS = _Powers()
#: A number for each byte; A-Z have those of a-z.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


def prefix_sums(raw: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums ``h`` of powers over all prefixes of some bytes, and ``down``: the hash of bytes lo to hi is ``(h[hi] - h[lo]) * down[lo]``."""
    up, down = POWERS.upto(len(raw) + 1)
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[:-1], out=h[1:])
    return h, down


def _pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts joined by spaces in pieces of about ``PIECE`` bytes, and where each text begins; a long text is cut at white space and begins once."""
    parts, at, have = [], [], 0
    for t in texts:
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        at.append(have)
        lo = 0
        while len(raw) - lo > PIECE:  # a word is never cut
            ends = [x for x in (raw.find(bytes([c]), lo + PIECE // 2) for c in SPACE) if x >= 0]
            if not ends:
                break
            yield b" ".join([*parts, raw[lo : min(ends)], b""]), np.array(at, np.int64)
            parts, at, have, lo = [], [], 0, min(ends)
        parts.append(raw[lo:])
        have += len(raw) - lo + 1
        if have >= PIECE:
            yield b" ".join([*parts, b""]), np.array(at, np.int64)
            parts, at, have = [], [], 0
    if parts:
        yield b" ".join([*parts, b""]), np.array(at, np.int64)


_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the bounds of each text in them (one more than texts).

    Words are the maximal runs of anything but space, tab, LF, VT, FF and CR, with A-Z lower-cased.
    """
    hashes, bounds, have = [], [], 0
    for piece, at in _pieces(texts):
        raw = np.frombuffer(piece, np.uint8)
        gap = _GAP[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        lo, hi = (turn[::2], turn[1::2]) if gap[0] else (np.concatenate([[0], turn[1::2]]).astype(np.int64), turn[::2])
        lo = lo[: len(hi)]
        h, down = prefix_sums(raw, FOLDED)
        own = mix((h[hi] - h[lo]) * down[lo] + (hi - lo).astype(np.uint64))
        for i in np.flatnonzero(hi - lo > LONG).tolist():  # sums of powers can be made to meet in long words
            own[i] = int.from_bytes(blake2b(piece[lo[i] : hi[i]].lower(), digest_size=8).digest(), "little")
        hashes.append(own)
        bounds.append(np.searchsorted(lo, at) + have)
        have += len(lo)
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate([*bounds, [have]]).astype(np.int64)


def gram_hashes(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its word n-grams, repeats included; one for the whole of a text of fewer words."""
    h, bound = word_hashes(texts)

    def grams(words: np.ndarray, k: int) -> np.ndarray:
        m = len(words) - k + 1
        acc = np.full(m, k, np.uint64)
        for i in range(k):
            acc = mix(acc + words[i : i + m])
        return acc

    full = grams(h, n) if len(h) >= n else None
    out = []
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        out.append(full[lo : hi - n + 1] if hi - lo >= n else grams(h[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
    return out
