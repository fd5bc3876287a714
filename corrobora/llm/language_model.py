"""Scores of whole texts under a log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

Tokens are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased, then one end token for each text. The network predicts symbols: the end, the FREQUENT most
frequent words, and CLASSES classes of all other words, told by their first letters. The two symbols before a token (ends before the first) give
h = r[w1] C1 + r[w2] C2; a symbol's score is h . q[s] + b[s] and its probability the softmax over all symbols, taken from batched matrix products over
all pairs of symbols. A word of a class has the class's probability times its own share of the class, (c + 0.1) / (sum of c + 0.1, and 0.1 for all words that training did
not see), c being its count in training. So the probabilities of all words, seen or not, sum to one after every history.

Training: every training text's symbol triples are counted. Noise-contrastive estimation needs no more than these counts, and there are at most
SYMBOLS**3 of them however large the corpus is. Each of SHARES tasks trains on its share of the triples, drawn by their counts, with NOISE draws from the unigram distribution shared by a batch; after
each round the tasks' parameters are averaged by weight, parameter by parameter, and the next round starts from there.

`base_score` is the unigram score: log10((c + 0.1) / (N + 0.1 * (V + 1))) summed over tokens.

Nulls: a null text is empty and has the end token only. Rows with a null id count as training rows and keep their null. Rows that share an id are rows of their own.
Other columns are ignored. An empty table gives an empty result; without training rows every symbol is equally likely and each word unseen.

Scale: word counts are combined in the tasks and summed by a shuffle. Words at least as frequent as a threshold, chosen from a histogram so that there are at most
LOOKUP, go to every task (some 2 MB whatever the input); all other words meet their counts in a join by word. No text is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .runtime import discard, kept

FREQUENT, CLASSES = 95, 32
SYMBOLS = 1 + FREQUENT + CLASSES
WIDTH, NOISE, BATCH, STEPS, ROUNDS, RATE = 24, 64, 1024, 500, 4, 0.12
SHARES = 6                    # tasks that train; the triples are a table of bounded size
SMOOTH = 0.1
LOOKUP = 131_072
GATHERED = 2_000_000          # distinct words that a task holds before it passes their counts on
END = np.int64(-1)            # stands for the end token among the words' hashes
SEED = 11

Counted = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts (low, high): token hashes, their classes (-1 for ends) and the text that each is in."""
    folded = np.arange(256, dtype=np.int64)
    folded[65:91] += 32
    for low, high, pieces in H.slices(texts, H.SPACED):
        data, size = np.append(pieces.data, [0, 0]), pieces.ends - pieces.starts
        letters = sum(np.where(size > i, folded[data[pieces.starts + i]], 0) << (8 * i) for i in range(3))
        classes = (H.mixed(letters.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int64)
        at = np.arange(len(size)) + np.repeat(np.arange(high - low), pieces.counts())      # one end for each text before
        n = len(size) + high - low
        hashes, own, text = np.full(n, END), np.full(n, -1), np.repeat(np.arange(high - low), pieces.counts() + 1)
        hashes[at], own[at] = pieces.hashes.view(np.int64), classes
        yield low, high, hashes, own, text


def _merged(parts: Counted) -> Counted:
    words, counts, classes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    words, first, group = np.unique(words, return_index=True, return_inverse=True)
    return [(words, np.bincount(group, counts).astype(np.int64), classes[first])]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: Counted) -> Iterator[pa.RecordBatch]:
        for words, counts, classes in _merged(parts) if parts else ():
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts), pa.array(classes.astype(np.int32))], ["word", "n", "class"])

    parts: Counted = []
    for batch in batches:
        for _, _, words, classes, _ in _words(batch.column(0)):
            found, first, counts = np.unique(words, return_index=True, return_counts=True)
            parts.append((found, counts, classes[first]))
            if sum(len(p[0]) for p in parts) > 2 * GATHERED:
                parts = _merged(parts)
                if len(parts[0][0]) > GATHERED:
                    yield from out(parts)
                    parts = []
    yield from out(parts)


class Vocabulary:
    """What every task knows of the words: counts of the frequent ones, symbols and the classes' masses."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray, class_counts: np.ndarray, class_words: np.ndarray, total: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct = total, distinct
        top = np.lexsort((words, -counts))
        top = top[words[top] != END][:FREQUENT]
        self.symbol_of = np.full(len(words), -1)
        self.symbol_of[np.searchsorted(self.words, words[top])] = 1 + np.arange(len(top))
        self.mass = np.zeros(SYMBOLS)
        self.mass[0] = counts[words == END].sum() + SMOOTH
        self.mass[1:1 + len(top)] = counts[top] + SMOOTH
        taken, many = np.bincount(classes[top], counts[top], CLASSES), np.bincount(classes[top], minlength=CLASSES)
        self.mass[1 + FREQUENT:] = class_counts - taken + SMOOTH * (class_words - many) + SMOOTH

    def base(self) -> float:
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))

    def look_up(self, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count, whether the count is known here) of each token."""
        if not len(self.words):
            return np.where(classes < 0, 0, 1 + FREQUENT + classes), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        here = self.words[at] == words
        frequent = np.where(here, self.symbol_of[at], -1)
        symbols = np.where(classes < 0, 0, np.where(frequent > 0, frequent, 1 + FREQUENT + classes))
        return symbols, np.where(here, self.counts[at], 0), here


def _histories(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each token and the one before that; ends before a text begins."""
    out = []
    for back in (1, 2):
        before = np.zeros_like(symbols)
        before[back:] = np.where(text[back:] == text[:-back], symbols[:-back], 0)
        out.append(before)
    return out[0], out[1]


def _triples(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, _, words, classes, text in _words(batch.column(0)):
                symbols = vocabulary.look_up(words, classes)[0]
                one, two = _histories(symbols, text)
                np.add.at(seen, (two * SYMBOLS + one) * SYMBOLS + symbols, 1)
        cells = np.flatnonzero(seen)
        for low in range(0, len(cells), 1 << 17):
            part = cells[low:low + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], ["cell", "n"])
    return run


class Network:
    """Parameters of the log-bilinear model in one flat array."""

    SHAPES = (("r", (SYMBOLS, WIDTH)), ("q", (SYMBOLS, WIDTH)), ("c1", (WIDTH, WIDTH)), ("c2", (WIDTH, WIDTH)), ("b", (SYMBOLS,)))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(shape)) for _, shape in cls.SHAPES)

    @classmethod
    def first(cls, noise: np.ndarray) -> "Network":
        net = cls(np.random.Generator(np.random.PCG64(SEED)).normal(0, 0.1, cls.size()))
        net.c1[:], net.c2[:], net.b[:] = np.eye(WIDTH), np.eye(WIDTH), np.log(noise)
        return net

    def log_probabilities(self) -> np.ndarray:
        """log10 P(symbol | one back, two back) as an array [two, one, symbol]; every row is normalised."""
        one, two = self.r @ self.c1, self.r @ self.c2
        out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS))
        for w in range(SYMBOLS):
            scores = (one + two[w]) @ self.q.T + self.b
            scores -= scores.max(axis=1, keepdims=True)
            out[w] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)
        return out


def train(net: Network, cells: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int, rate: float, steps: int) -> None:
    """Noise-contrastive estimation with Adagrad; the parameters are changed in place. A batch is a draw of triples by count, so that each stands for equally many tokens."""
    rng, fine = np.random.Generator(np.random.PCG64(seed)), Network(net.flat.astype(np.float32))
    offset, squares, unit = np.log(NOISE * noise).astype(np.float32), np.full(Network.size(), 1e-4, dtype=np.float32), np.eye(SYMBOLS, dtype=np.float32)
    running, every = np.cumsum(counts) / counts.sum(), np.arange(BATCH)
    for _ in range(steps):
        cell = cells[np.minimum(np.searchsorted(running, rng.random(BATCH), "right"), len(cells) - 1)]
        a, b, w = cell // SYMBOLS % SYMBOLS, cell // SYMBOLS**2, cell % SYMBOLS
        drawn = rng.multinomial(NOISE, noise).astype(np.float32)                   # how often each symbol is noise
        ra, rb = fine.r[a], fine.r[b]
        h = ra @ fine.c1 + rb @ fine.c2
        noisy = 1 / (1 + np.exp(np.clip(offset - fine.b - h @ fine.q.T, -30, 30)))  # probability of being data
        g_scores = noisy * (drawn / BATCH)
        g_scores[every, w] -= (1 - noisy[every, w]) / BATCH
        g_h = g_scores @ fine.q
        step = Network(np.empty(Network.size(), dtype=np.float32))
        step.q[:], step.b[:] = g_scores.T @ h, g_scores.sum(axis=0)
        step.c1[:], step.c2[:] = ra.T @ g_h, rb.T @ g_h
        step.r[:] = unit[a].T @ (g_h @ fine.c1.T) + unit[b].T @ (g_h @ fine.c2.T)
        squares += step.flat**2
        fine.flat -= np.float32(rate) * step.flat / np.sqrt(squares)
    net.flat[:] = fine.flat


def _trained(flat: np.ndarray, noise: np.ndarray, round_: int, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()) for batch in batches if len(batch)]
        if parts:
            cells, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(cells)                  # rows come in any order; the result must not
            net = Network(flat.copy())
            train(net, cells[order], counts[order], noise, SEED + 1000 * round_ + int(cells.min()), RATE / 2**round_, steps)
            weight = float(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(net.flat * weight), pa.array(np.full(len(flat), weight))], ["i", "value", "weight"])
    return run


def _scored(vocabulary: Vocabulary, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = None, vocabulary.base()
        share = np.log10(np.maximum(vocabulary.mass, SMOOTH))
        for batch in batches:
            if table is None:
                table = Network(flat).log_probabilities()
            for low, high, words, classes, text in _words(batch.column(2)):
                symbols, counts, here = vocabulary.look_up(words, classes)
                one, two = _histories(symbols, text)
                own, n = np.log10(counts + SMOOTH), high - low
                of_class = symbols > FREQUENT
                model = table[two, one, symbols] - np.where(of_class, share[symbols], 0.0) + np.where(of_class & here, own, 0.0)
                gone = ~here & (classes >= 0)
                # words whose counts are elsewhere, once for each text
                pairs, many = np.unique(np.rec.fromarrays((text[gone], words[gone])), return_counts=True)
                bounds = np.searchsorted(pairs["f0"], np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs["f1"])), pa.array(many.astype(np.int32))], ["word", "n"]))
                total = lambda x: np.bincount(text, x, n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(total(np.ones(len(text))).astype(np.int64)), pa.array(total((counts > 0).astype(float)).astype(np.int64)),
                    pa.array(total(np.where(gone, 0.0, own) - base)), pa.array(total(model)), rest], ["row", "id", "n_tokens", "n_known", "base_score", "score", "rest"])
    return run


def fit(texts: DataFrame) -> tuple[Vocabulary, Network, DataFrame]:
    """The vocabulary and the trained network of a column of training texts, and the counts (word, n, class) of all their words."""
    spark = texts.sparkSession
    counts = kept(texts.mapInArrow(_word_counts, "word long, n long, class int").groupBy("word").agg(F.sum("n").alias("n"), F.min("class").alias("class")), "word-counts")
    bins = counts.groupBy(F.floor(F.log(F.col("n").cast("double")) / np.log(1.05)).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    threshold, words = None, 0
    for b in bins:                                     # some 20 bins for each power of e
        words += b["words"]
        if words > LOOKUP and threshold is not None:
            break
        threshold = b["least"]
    top = counts.where((F.col("n") >= (threshold or 1)) | (F.col("word") == int(END))).toArrow()
    per_class = {r["class"]: (r["n"], r["words"]) for r in counts.where("class >= 0").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    class_counts, class_words = (np.array([per_class.get(c, (0, 0))[i] for c in range(CLASSES)], dtype=float) for i in range(2))
    vocabulary = Vocabulary(*(np.asarray(top[c].combine_chunks().to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("word", "n", "class")), class_counts, class_words, int(totals[0] or 0), int(totals[1]))
    noise = np.maximum(vocabulary.mass, SMOOTH) / np.maximum(vocabulary.mass, SMOOTH).sum()
    triples = kept(texts.mapInArrow(_triples(vocabulary), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "triples")
    shares = kept(triples.repartition(SHARES, "cell"), "shares")
    flat = Network.first(noise).flat
    for round_ in range(ROUNDS):
        mean = shares.mapInArrow(_trained(flat, noise, round_, STEPS), "i int, value double, weight double").groupBy("i").agg((F.sum("value") / F.sum("weight")).alias("value"))
        rows = mean.collect()                          # one number for each parameter
        if rows:
            flat = np.array([r["value"] for r in sorted(rows, key=lambda r: r["i"])])
    discard(triples, shares)
    return vocabulary, Network(flat), counts.where(F.col("n") < (threshold or 1))


def score(docs: DataFrame, is_training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, n_known (tokens that training holds), train_tokens, base_score, score (both log10)."""
    vocabulary, net, others = fit(docs.where(is_training).select(text_column))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = kept(texts.mapInArrow(_scored(vocabulary, net.flat), f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:long,n:int>>"), "scored")
    rest = found.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("many"))
    met = rest.join(others.hint("merge"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    own = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("many")).otherwise(0)).alias("known"), F.sum(F.col("many") * F.log10(F.col("c") + SMOOTH)).alias("logs"))
    joined = found.drop("rest").join(own.hint("merge"), "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select("id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
                         (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
