"""Word, line and shingle hashes of whole Arrow text columns with numpy; no Python work per word.

A piece of text is hashed as a polynomial over random 64-bit values of its bytes (mod 2**64), so prefix sums give the hash of any span and any
run of words. Equal pieces always have equal hashes; different pieces share one with probability about 2**-64 per compared pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D | 5
BASE, WORD_BASE = (BASE & ~7) | 5, (WORD_BASE & ~7) | 5
SLICE_BYTES = 2_000_000

EXACT_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = EXACT_VALUES.copy()
FOLDED_VALUES[65:91] = EXACT_VALUES[97:123]          # A-Z hash as a-z
_POWERS: dict[int, np.ndarray] = {}


def _table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in spans:
        out[low:high + 1] = True
    return out


SPACED = ~_table((0x20, 0x20), (0x09, 0x0D))                                    # [^\x20\x09-\x0D]
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))          # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
LINES = ~_table((0x0A, 0x0A))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (an invertible finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of what `prefix` sums; equal contents, equal hashes, wherever they stand."""
    inverse = powers(pow(base, -1, 2**64), len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


class Pieces:
    """The words (or lines) of some consecutive texts: byte bounds, hashes, and for text d the pieces first[d] .. first[d+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        n = len(data)
        word = np.zeros(n + 2, dtype=np.int8)
        word[1:-1] = inside[data]
        begins = (word[1:-1] == 1) & (word[:-2] == 0)
        stops = (word[1:-1] == 1) & (word[2:] == 0)
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = word[1:-1][edges] == 1
        stops[edges - 1] = word[1:-1][edges - 1] == 1
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.byte_prefix = _prefix(values[data], BASE)
        self.hashes = span_hashes(self.byte_prefix, BASE, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix(self) -> np.ndarray:
        return _prefix(self.hashes, WORD_BASE)


def slices(texts: pa.Array, inside: np.ndarray, values: np.ndarray = FOLDED_VALUES, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Pieces]]:
    """Consecutive texts [low, high) of about `limit` bytes (one text at least, always whole) with their pieces."""
    data, offsets = _bytes_of(texts)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, Pieces(data[offsets[low]:offsets[high]], offsets[low:high + 1], inside, values)
        low = high


def shingles(pieces: Pieces, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-piece runs, text by text, and their bounds; a text of fewer pieces, but not none, has one run: all of it."""
    counts = pieces.counts()
    runs = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    starts = np.repeat(pieces.first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    ends = np.minimum(starts + k, np.repeat(pieces.first[1:], runs))
    return span_hashes(pieces.prefix(), WORD_BASE, starts, ends), bounds


def minima(h: np.ndarray, bounds: np.ndarray, n_hashes: int, seed: int) -> np.ndarray:
    """For each non-empty run of `h` the minima under n_hashes universal hash functions: an array (runs, n_hashes) of 32-bit values."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 2**31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, n_hashes, dtype=np.uint64)
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, n_hashes), dtype=np.uint32)
    for i in range(n_hashes):
        # the high half enters too, so that two shingles equal in one half stay apart; the top bits of the product are the well-mixed ones
        v = low * a[i] + np.uint32(b[i] & np.uint64(0xFFFFFFFF))
        v ^= high + np.uint32(b[i] >> np.uint64(7) & np.uint64(0xFFFFFFFF))
        v *= a[-1 - i]
        out[:, i] = np.minimum.reduceat(v, bounds[:-1])
    return out


def binned_minima(h: np.ndarray, bounds: np.ndarray, functions: int, bins: int, seed: int) -> np.ndarray:
    """For each run of `h` functions * bins minima of 32 bits: every function deals the elements into bins, and a bin has the smallest value dealt to it. An
    empty bin takes the next filled one's value, changed by the distance. Two sets agree in a bin with the probability of their Jaccard similarity."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(bounds) - 1
    place = np.repeat(np.arange(n) * (functions * bins), np.diff(bounds))
    out = np.full(n * functions * bins, 0xFFFFFFFF, dtype=np.uint32)
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for f in range(functions):
        a, b, c, d = rng.integers(0, 2**31, 4, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        m = low * a + high * b
        m ^= m >> np.uint32(15)
        m *= c
        np.minimum.at(out, place + (f * bins + ((m >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16))), (m ^ m >> np.uint32(16)) * d)
    out = out.reshape(n, functions, bins)
    at = np.where(out == 0xFFFFFFFF, 2 * bins, np.arange(bins))
    after = np.minimum.accumulate(np.concatenate((at, at + bins), axis=2)[:, :, ::-1], axis=2)[:, :, ::-1][:, :, :bins]
    filled = np.take_along_axis(out, after % bins, axis=2)
    return (filled + (after - np.arange(bins)).astype(np.uint32) * np.uint32(0x9E3779B1)).reshape(n, functions * bins)


def low_bits(signatures: np.ndarray, n: int) -> np.ndarray:
    """The lowest bits of the first n <= 64 minima as one number: two sets of similarity s agree in a bit with probability (1 + s) / 2."""
    return ((signatures[:, :n] & np.uint32(1)).astype(np.uint64) << np.arange(n, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` minima, different bands never sharing one on purpose."""
    n, k = signatures.shape
    bands = k // rows
    out = np.empty((n, bands), dtype=np.int64)
    for band in range(bands):
        h = np.full(n, band + 1, dtype=np.uint64)
        for r in range(rows):
            h = mixed(h * np.uint64(WORD_BASE) + signatures[:, band * rows + r].astype(np.uint64) + np.uint64(1))
        out[:, band] = h.view(np.int64)
    return out
