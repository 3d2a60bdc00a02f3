"""Vectorised text primitives: words, word hashes, shingles, lines, over batches of whole texts.

Everything works on UTF-8 bytes held in one numpy array per batch. Each text is followed by
one line feed, so that neither words nor lines run over the end of a text. Null texts count
as empty ones.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text for which 8-byte temporaries are held at once.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters to one class by case, digits to one, all bytes above 127 to small letters.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _ensure(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n + n // 4, SLICE_BYTES + 4096)
        p, q = np.full(size, _MULT), np.full(size, _INVERSE)
        p[0] = q[0] = 1
        _powers, _inverses = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the weighted sum of bytes i to j-1; see span_hash."""
    _ensure(len(buf) + 1)
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers[: len(buf)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, which depends on the bytes and not on their place."""
    return mix((s[end] - s[start]) * _inverses[start] + (end - start).astype(np.uint64))


def spans_hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of ascending, disjoint spans, with bounded temporaries."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        a = int(start[i])
        s = prefix_sums(buf[a : int(end[j - 1])])
        out[i:j] = span_hash(s, start[i:j] - a, end[i:j] - a)
        i = j
    return out


class Texts:
    """A batch of texts as one buffer; at[i] to at[i + 1] - 1 are text i's bytes (the last is its line feed)."""

    def __init__(self, texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.n = len(parts)
        self.buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in parts], out=self.at[1:])

    def words(self, lower: bool = True) -> "Words":
        return Words(self, lower)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte flag over each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.at[1:]] - c[self.at[:-1]]


class Words:
    """Words of a batch: byte spans, the text of each, and first[i] to first[i + 1] - 1 as text i's words."""

    def __init__(self, texts: Texts, lower: bool = True):
        self.texts = texts
        self.buf = LOWER[texts.buf] if lower else texts.buf
        inside = ~SPACE[texts.buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, texts.at)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(texts.n), self.count)

    def hashes(self) -> np.ndarray:
        return spans_hashed(self.buf, self.start, self.end)

    def shape_hashes(self) -> np.ndarray:
        """Hash of each word's shape: classes of characters, runs of a class as one."""
        shape = SHAPE[self.texts.buf]
        keep = np.ones(len(shape), bool)
        keep[1:] = (shape[1:] != shape[:-1]) | SPACE[shape[1:]]
        buf = shape[keep]
        edge = np.flatnonzero(np.diff(~SPACE[buf], prepend=False, append=False))
        return spans_hashed(buf, edge[::2], edge[1::2])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; the result is k - 1 shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _PLACE[j]
    return mix(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of fewer words has its whole sequence as one; none for no words."""
    h = words.hashes()
    w = windows(h, k)
    out = []
    for i in range(words.texts.n):
        a, n = int(words.first[i]), int(words.count[i])
        if n >= k:
            out.append(np.unique(w[a : a + n - k + 1]))
        elif n:
            out.append(mix((h[a : a + n] * _PLACE[32 : 32 + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
