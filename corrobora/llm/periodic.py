"""Periodic runs of words: block convolution by an exact integer transform at dyadic scales, then extension.

A run is a longest stretch of consecutive words in which words q apart are equal, q being its smallest such distance, and which has at least
max(6, 4 * q) words. At scale B = 1, 2, 4, ... a text is cut into blocks of B words. A run with B <= q < 2 * B holds a whole block together with its
occurrence q words later, because it is longer than 4 * B. So each block is correlated with the 2 * B words that follow it: with words as integers, the sum
of squared differences, sum(x*x) + sum(y*y) - 2 * sum(x*y), is zero exactly where the block occurs again. All lags of a block come from one
number-theoretic transform modulo 15 * 2**27 + 1. A sum that is zero is zero there too; one that is only a multiple of the modulus is thrown out
when the words themselves are compared. The lags that stand are candidate periods: the stretch is extended both ways as long as words that far apart agree.

Two kinds of blocks need no transform, since they have no new occurrence: those with a word that does not return within 2 * B words, and those that lie, with
all that follows, in a run that a smaller scale found (there only multiples of that run's period fit).

Words are runs of [^\\x20\\x09-\\x0D], unchanged; equal 64-bit hashes stand for equal words. Nulls: a null text has no words and no runs, and its collapsed text is empty; a
null id stays null. Rows are independent, repeated rows give repeated results, other columns are ignored; an empty table gives an empty result.

Scale: one pass over the rows without a shuffle; a text is one row and is worked on whole, with memory in proportion to its length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

PRIME, GENERATOR = 15 * 2**27 + 1, 31
LEAST_WORDS, LEAST_TIMES = 6, 4
CELLS = 1 << 19          # numbers transformed at a time
FAR = np.iinfo(np.int64).max // 4
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(n: int, inverse: bool) -> np.ndarray:
    """w**0 .. w**(n/2 - 1) for a primitive n-th root w."""
    if (n, inverse) not in _ROOTS:
        w = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        out = np.ones(max(n // 2, 1), dtype=np.int64)
        filled = 1
        while filled < len(out):                       # double what is there
            out[filled:2 * filled] = out[:filled] * pow(w, filled, PRIME) % PRIME
            filled *= 2
        _ROOTS[n, inverse] = out
    return _ROOTS[n, inverse]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (its length a power of two, values below PRIME); the inverse is not divided by the length."""
    count, n = rows.shape
    size, stride, x = n, 1, rows
    while size > 1:
        x = x.reshape(count, 2, size // 2, stride)
        low, high = x[:, 0], x[:, 1]
        out = np.empty((count, size // 2, 2, stride), dtype=np.int64)
        out[:, :, 0] = (low + high) % PRIME
        out[:, :, 1] = (low - high) % PRIME * _roots(size, inverse)[None, :, None] % PRIME
        x, size, stride = out, size // 2, stride * 2
    return x.reshape(count, n)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row: sum((block - window[lag:lag + B])**2) modulo PRIME for lag 0 .. B-1, of blocks of B numbers and windows of 2 * B."""
    count, size = blocks.shape
    padded = np.zeros_like(windows)
    padded[:, :size] = blocks
    both = transform(windows) * transform(padded, inverse=True) % PRIME
    products = transform(both, inverse=True)[:, :size] * pow(2 * size, -1, PRIME) % PRIME
    squares = np.zeros((count, 2 * size + 1), dtype=np.int64)
    np.cumsum(windows * windows % PRIME, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % PRIME).sum(axis=1)
    return (own[:, None] + squares[:, size:2 * size] - squares[:, :size] - 2 * products) % PRIME


def _next_distance(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the distance to the next equal word of its text."""
    order = np.argsort(text * (int(ids.max(initial=0)) + 1) + ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out = np.full(len(ids), FAR)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _extended(ids: np.ndarray, at: int, d: int, low: int, high: int) -> tuple[int, int]:
    """The longest [a, b) around `at` with ids[i] == ids[i + d] in it, within the text's words [low, high)."""
    b, step = at, 64
    while b < high - d:
        stop = min(b + step, high - d)
        wrong = ids[b:stop] != ids[b + d:stop + d]
        if wrong.any():
            b += int(wrong.argmax())
            break
        b, step = stop, step * 2
    a, step = at, 64
    while a > low:
        start = max(a - step, low)
        wrong = (ids[start:a] != ids[start + d:a + d])[::-1]
        if wrong.any():
            a -= int(wrong.argmax())
            break
        a, step = start, step * 2
    return a, b


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period; text t has the word numbers ids[first[t]:first[t + 1]]."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    found: list[dict[tuple[int, int], int]] = [{} for _ in counts]
    covered = np.zeros(len(ids), dtype=np.int64)       # for each word the end of the runs found that hold it
    farthest, size, pad = _next_distance(ids, text), 1, int(ids.max(initial=0)) + 1
    n_blocks = counts
    while (counts >= 4 * size).any():
        begin = np.concatenate(([0], np.cumsum(n_blocks)))
        owner = np.repeat(np.arange(len(counts)), n_blocks)
        starts = first[owner] + (np.arange(begin[-1]) - begin[owner]) * size
        ends = first[owner + 1]
        hopeful = np.flatnonzero((farthest < 2 * size) & (starts + 2 * size <= ends) & (counts[owner] >= 4 * size) & (covered[starts] < np.minimum(starts + 3 * size, ends)))
        stretches: dict[tuple[int, int], tuple[int, int]] = {}
        for part in range(0, len(hopeful), step := max(1, CELLS // (2 * size))):
            which = hopeful[part:part + step]
            s, end = starts[which], ends[which]
            places = s[:, None] + size + np.arange(2 * size)[None, :]
            windows = np.where(places < end[:, None], ids[np.minimum(places, len(ids) - 1)], pad)
            blocks = ids[s[:, None] + np.arange(size)[None, :]]
            row, lag = np.nonzero(squared_differences(blocks, windows) == 0)
            d = lag + size
            stands = (s[row] + d + size <= end[row]) & (covered[s[row]] < s[row] + d + size)
            for at, period, t in zip(s[row][stands].tolist(), d[stands].tolist(), owner[which[row[stands]]].tolist()):
                if covered[at] >= at + period + size:
                    continue
                known = stretches.get((t, period), (0, 0))
                if known[0] <= at and at + size <= known[1]:
                    continue
                a, b = _extended(ids, at, period, first[t], first[t + 1])
                if b < at + size:
                    continue                           # a multiple of the modulus
                stretches[t, period] = (a, b)
                length = b - a + period
                if length >= max(LEAST_WORDS, LEAST_TIMES * period):
                    place = (int(a - first[t]), int(length))
                    found[t][place] = min(period, found[t].get(place, period))
                    np.maximum(covered[a:a + length], a + length, out=covered[a:a + length])
        # blocks of twice the size
        halves = n_blocks // 2
        after = np.concatenate(([0], np.cumsum(halves)))
        owner = np.repeat(np.arange(len(counts)), halves)
        left = begin[owner] + 2 * (np.arange(after[-1]) - after[owner])
        farthest, n_blocks, size = np.maximum(farthest[left], farthest[left + 1]), halves, 2 * size
    return [sorted((start, length, period) for (start, length), period in runs.items()) for runs in found]


def _joined(pieces: H.Pieces, gone: np.ndarray) -> pa.Array:
    """The texts' words that are not gone, joined by one space."""
    text = np.repeat(np.arange(len(pieces.first) - 1), pieces.counts())[~gone]
    starts, sizes = pieces.starts[~gone], (pieces.ends - pieces.starts)[~gone]
    space = np.ones(len(text), dtype=np.int64)
    space[np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))[:len(text)]] = 0
    bounds = np.concatenate(([0], np.cumsum(sizes + space)))
    source = np.repeat(starts - space - bounds[:-1], sizes + space) + np.arange(bounds[-1])
    data = pieces.data[np.maximum(source, 0)]
    data[bounds[:-1][space == 1]] = 0x20
    offsets = bounds[np.searchsorted(text, np.arange(len(pieces.first)))]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, pieces in H.slices(batch.column(1), H.SPACED, H.EXACT_VALUES):
            ids = np.unique(pieces.hashes, return_inverse=True)[1].astype(np.int64)
            runs, gone = find_runs(ids, pieces.first), np.zeros(len(ids), dtype=bool)
            for t, own in enumerate(runs):
                for start, length, period in own:
                    gone[pieces.first[t] + start + period:pieces.first[t] + start + length] = True
            flat = [r for own in runs for r in own]
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32))
            nested = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_RUNS)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(pieces.counts().astype(np.int64)), nested, _joined(pieces, gone)],
                                             ["id", "n_words", "runs", "text"])


def collapsed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, runs (array of start, length, period in words, by start then period), and the text's words without
    those that a run repeats, each run keeping its first period, joined by one space."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_collapsed, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
