"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: lower case, look-alike letters of other scripts and full-width letters become Latin, accents go, digits and signs that stand for letters
become these letters, zero-width characters go; i and l are one letter. Entries are whole words or word beginnings. Of the entries that match at
one place the heaviest counts; a match inside an exception phrase does not count. The sum of the weights is divided by 1 + ln(1 + words / 50), and a
logistic curve turns that into a score from 0 to 1.

The lexicon is learned from labelled texts: weight = log odds of the share of toxic and of clean training texts that have the entry, the toxic
count lowered by its uncertainty. It is fitted on a bounded sample, MAX_TRAINING labelled rows (chosen by a hash of their id; near-copies, by one
MinHash, once), so what the driver and each task hold has a bound: at most MAX_TRAINING texts' words.

Nulls: a null or empty text scores as a text without matches; null ids and labels are not learned from. A labelled id given twice is toxic if one
of its labels says so. Repeated documents score alike. Without labels of both kinds there is no lexicon and every score is 0.
"""

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .runtime import kept

MAX_TRAINING = 8_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
LEAST_TOXIC, LEAST_WEIGHT = 3, 2.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "idiot proof", "scum line", "stupid pet tricks")

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
              "ԁ": "d", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
              "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
ZERO_WIDTH = "​‌‍⁠﻿­"


def folding() -> tuple[str, str]:
    """The two arguments of translate(): characters, and what they become; the last ones become nothing."""
    pairs = {**LOOKALIKES, **SUBSTITUTES}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code).lower())[0]
        if base.isascii() and base.isalpha():
            pairs.setdefault(chr(code).lower(), base)
    for i in range(26):
        pairs[chr(0xFF41 + i)] = chr(97 + i)
    for i in range(10):
        pairs[chr(0xFF10 + i)] = SUBSTITUTES.get(str(i), str(i))
    pairs = {a: "i" if b == "l" else b for a, b in pairs.items()} | {"l": "i"}
    return "".join(pairs) + ZERO_WIDTH, "".join(pairs.values())


def folded(text: Column) -> Column:
    source, target = folding()
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), source, target)


def folded_text(text: str) -> str:
    """The same for one Python string: entries and exception phrases."""
    source, target = folding()
    return text.lower().translate({ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)})


@dataclass(frozen=True)
class Model:
    """entries: (folded text, whole word or word beginning, weight); score = 1 / (1 + exp(-(slope * x + start)))."""
    entries: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    start: float

    def automaton(self):
        key = hash(self)
        if key not in _BUILT:
            built = ahocorasick.Automaton()
            values: dict[str, dict] = {}
            for text, whole, weight in self.entries:
                values.setdefault(text, {})["whole" if whole else "start"] = weight
            for text in self.exceptions:
                values.setdefault(text, {})["except"] = 0.0
            for text, kinds in values.items():
                built.add_word(text, (len(text), kinds))
            if values:
                built.make_automaton()
            _BUILT.clear()
            _BUILT[key] = built if values else None
        return _BUILT[key]


_BUILT: dict[int, object] = {}


def raw_score(text: str, automaton) -> float:
    """Weights of the matches in a folded text over its length."""
    if automaton is None or not text:
        return 0.0
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    for last, (n, kinds) in automaton.iter(text):
        first = last + 1 - n
        if first and text[first - 1].isalpha():
            continue
        closed = last + 1 == len(text) or not text[last + 1].isalpha()
        if closed and "except" in kinds:
            spared.append((first, last))
        weight = max(kinds.get("start", 0.0), kinds.get("whole", 0.0) if closed else 0.0)
        if weight > best.get(first, (0.0, 0))[0]:
            best[first] = (weight, last)
    total = sum(w for first, (w, last) in best.items() if not any(a <= first and last <= b for a, b in spared))
    return total / (1 + math.log1p((text.count(" ") + text.count("\n") + 1) / 50))


def _raw(model: Model):
    @F.arrow_udf("double")
    def raw(texts: pa.Array) -> pa.Array:
        automaton = model.automaton()
        return pa.array([raw_score(t.as_py() or "", automaton) for t in texts], pa.float64())
    return raw


def score(text: Column, model: Model) -> Column:
    x = _raw(model)(folded(text))
    return F.lit(0.0) if not model.entries else 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.start))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of the text's 5-word shingles, which most near-copies share."""
    for batch in batches:
        for low, high, pieces in H.slices(batch.column(1), H.SPACED):
            h, bounds = H.shingles(pieces, 5)
            least = np.zeros(high - low, dtype=np.uint64)
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                least[full] = np.minimum.reduceat(h, bounds[:-1][full])
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), batch.column(1).slice(low, high - low), batch.column(2).slice(low, high - low)], ["sign", "text", "toxic"])


def _entries_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of a task have each word and word beginning."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    words = regex.compile(r"\p{L}+")
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set(words.findall(text))
            seen[toxic].update("=" + w for w in found)
            seen[toxic].update({"^" + w[:n] for w in found for n in PREFIXES if len(w) > n})
    entries = [*(seen[0].keys() | seen[1].keys())]
    yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([seen[1][e] for e in entries], pa.int64()), pa.array([seen[0][e] for e in entries], pa.int64())],
                                     ["entry", "toxic", "clean"])


def weight(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    sure = max(toxic - math.sqrt(toxic), 0)
    return math.log((sure + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> tuple[float, float]:
    """Slope and start of a logistic curve with both classes weighing the same and a small penalty on the slope (Newton steps)."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([penalty, penalty / 10])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (share * (p - y)) + ridge @ beta
        beta = beta - np.linalg.solve((design * (share * p * (1 - p))[:, None]).T @ design + ridge, gradient)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS,
        max_training: int = MAX_TRAINING) -> Model:
    """Learn entries and curve from the labelled rows (at most about max_training of them)."""
    spared = tuple(folded_text(e) for e in exceptions)
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg((F.max(label_column) > 0).cast("int").alias("toxic"))
    n = known.count()
    share = 2**20 if n <= max_training else int(2**20 * max_training / n)
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(2**20)) < share))       # max_training rows, give or take a few hundred
    texts = docs.select(F.col(id_column).cast("long").alias("id"), folded(F.col(text_column)).alias("text"))
    sample = kept(texts.join(chosen, "id").select("id", "text", "toxic").mapInArrow(_signed, "sign long, text string, toxic int").dropDuplicates(["sign"]).select("text", "toxic"), "training")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model((), spared, 0.0, 0.0)
    seen = (sample.mapInArrow(_entries_seen, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * sizes[0] > F.col("clean") * sizes[1]))).collect()
    weighed = sorted((r.entry, weight(r.toxic, r.clean, sizes[1], sizes[0])) for r in seen)
    entries = tuple((e[1:], e[0] == "=", w) for e, w in weighed if w >= LEAST_WEIGHT)
    model = Model(entries, spared, 0.0, 0.0)
    points = sample.select(_raw(model)(F.col("text")).alias("x"), "toxic").collect()
    slope, start = fit_curve(np.array([p.x for p in points]), np.array([p.toxic for p in points], dtype=np.float64))
    return Model(entries, spared, slope, start)


def held_out(id_column: Column) -> Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(3)) == 1, F.lit(False))
