"""Periodic runs, hard negatives and language model scores against plain versions."""

import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from corrobora.llm import hard_negatives, language_model, periodic, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def bumpy(rng: random.Random, size: int, letters: int) -> list[str]:
    out: list[str] = []
    while len(out) < size:
        out += [rng.choice("abcdefghijklmnop"[:letters]) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 20]))] * rng.choice([1, 1, 2, 3, 4, 5, 9, 40])
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = "x"
    return out[:size]


# --- periodic runs ------------------------------------------------------------------------------------------
def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 16, 128):
        a = rng.integers(0, periodic.PRIME, (3, n))
        assert (periodic.transform(periodic.transform(a), True) * pow(n, -1, periodic.PRIME) % periodic.PRIME == a).all()
    for size in (1, 2, 8, 64):
        x, w = rng.integers(0, 900, (4, size)), rng.integers(0, 900, (4, 2 * size))
        want = [[((x[r] - w[r, lag:lag + size])**2).sum() for lag in range(size)] for r in range(4)]
        assert periodic.squared_differences(x, w).tolist() == want


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        texts = [bumpy(rng, rng.choice([0, 1, 5, 6, 40, 200]), rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 4))]
        ids = np.unique([w for t in texts for w in t] or ["a"], return_inverse=True)[1][:sum(map(len, texts))].astype(np.int64)
        assert periodic.find_runs(ids, np.concatenate(([0], np.cumsum([len(t) for t in texts])))) == [brute.runs(t) for t in texts]


def test_runs_of_very_long_texts():
    for words, want in (([0] * 50_000, [(0, 50_000, 1)]), ([0, 1, 2] * 20_000, [(0, 60_000, 3)]), (list(range(3000)) * 20, [(0, 60_000, 3000)]), (list(range(50_000)), [])):
        assert periodic.find_runs(np.array(words, dtype=np.int64), np.array([0, len(words)])) == [want]


def test_collapsed(docs_frame):
    rng = random.Random(5)
    rows = [(i, " ".join(bumpy(rng, rng.choice([0, 5, 60]), 3))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a b " * 9 + " "), (104, "A a " * 8), (105, " é\té\né é é\x0bé "), (7, rows[7][1]), (None, "a " * 30)]
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic.collapsed(docs_frame(rows)).collect()]
    want = [(i, len(brute.re.findall(brute.SPACED, t or "")), (b := brute.periodic(t))["runs"], b["text"]) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.collapsed(docs_frame(rows).limit(0)).collect() == []


def test_op12(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    for row in rows:
        want, r = brute.periodic(row["text"], row["doc_id"]), got[row["doc_id"]]
        best = min(want["runs"], key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want["runs"]), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{p}\n" for s, n, p in want["runs"])) and r.collapsed_sha256 == brute.sha(want["text"])


# --- hard negatives ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block,part", [(4096, 1024), (40, 2)])
def test_hard_negatives(spark, block, part):
    rng = np.random.default_rng(4)
    vectors = [(int(i), int(rng.integers(0, 4)), rng.normal(0.2, 0.4, 6).tolist()) for i in range(600)]
    vectors += [(i, 1, vectors[i % 50][2]) for i in range(600, 700)]                         # ties
    vectors += [(800, 1, [0.0] * 6), (900, 2, [-0.5] * 6), (901, 2, [1.0, 2.0]), (1000, 1, [1.0, -2.0])]
    odd = [(701, 1, None), (702, None, [1.0] * 6), (703, 1, []), (704, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (705, 1, [float("nan")] * 6), (706, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    frame = spark.createDataFrame([(i, y, v, 1, 2) for i, y, v in [*vectors, *odd, vectors[0]]], "vec_id long, label int, embedding array<double>, block int, anchor int")
    rows = hard_negatives.scaled(frame, "vec_id", F.col("label"), "embedding")
    got = hard_negatives.mine(rows, F.col("id") % 100 == 0, block=block, part=part).collect()
    want = brute.hard_negatives([(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in vectors])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert hard_negatives.mine(rows.limit(0), F.col("id") % 100 == 0).collect() == []


def test_descent_stops_early():
    rng = np.random.default_rng(6)
    x = rng.integers(-200, 200, (4000, 4))
    block, anchor = hard_negatives.Lists(np.arange(4000), x), np.array([500, -20, 3, 0])
    rows, scores = block.descend(anchor, lambda r, s, t: len(s) >= 5 and t < np.sort(s)[-5])
    every = x @ anchor
    assert len(rows) < 1000 and sorted(np.sort(scores)[-5:]) == sorted(np.sort(every)[-5:])


# --- language model ------------------------------------------------------------------------------------------
def test_probabilities_are_normalised():
    net = language_model.Network(np.random.default_rng(0).normal(0, 1, language_model.Network.size()))
    assert np.allclose((10**net.log_probabilities()).sum(axis=2), 1)


def sentences(n: int) -> list[tuple]:
    """Texts of two kinds, each with words of its own in a fixed order."""
    rng = random.Random(8)
    kinds = (["the", "big", "dog", "saw", "a", "Cat"], ["der", "hund", "ist", "sehr", "alt", "und"])
    return [(i, " ".join(w for _ in range(rng.randint(3, 30)) for w in kinds[i % 2]) + f" rare{i}") for i in range(n)]


def test_language_model(spark, docs_frame, monkeypatch):
    rows = sentences(200) + [(1000, None), (1001, ""), (1002, "\t unseen words only"), (1003, "the " * 30_000), (5, "the dog"), (None, "the big dog")]
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    monkeypatch.setattr(language_model, "STEPS", 150)
    monkeypatch.setattr(language_model, "ROUNDS", 2)
    results = []
    for limit in (language_model.LOOKUP, 20):          # all words looked up, and rare ones joined
        monkeypatch.setattr(language_model, "LOOKUP", limit)
        results.append(sorted(language_model.score(docs_frame(rows), ~held_out).collect(), key=str))
    for a, b in zip(*results):
        assert a[:4] == b[:4] and a.base_score == pytest.approx(b.base_score, rel=1e-9)      # the model has fewer words of its own then
    got = {r.id: r for r in results[0] if r.id != 5}
    want = brute.unigram(rows)
    for i, (n_tokens, n_known, total, base) in want.items():
        if i != 5:
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n_tokens, n_known, total) and got[i].base_score == pytest.approx(base, rel=1e-9)
            assert got[i].score < 0
    learned = [i for i, _ in sentences(200) if brute.zlib.crc32(str(i).encode()) % 10 == 0]
    assert learned and sum(got[i].score for i in learned) > 0.9 * sum(got[i].base_score for i in learned)
    assert language_model.score(docs_frame(rows).limit(0), ~held_out).collect() == []
    vocabulary, _, others = language_model.fit(docs_frame(rows).select("text"))
    monkeypatch.setattr(language_model, "LOOKUP", 131_072)
    whole, _, none = language_model.fit(docs_frame(rows).select("text"))
    assert others.count() > 100 and none.count() == 0 and vocabulary.total == whole.total
    for v in (vocabulary, whole):                      # shares of a class sum to one
        assert v.mass.sum() == pytest.approx(v.total + language_model.SMOOTH * (v.distinct + language_model.CLASSES))
    nothing = language_model.score(docs_frame(rows[:3]), F.lit(False)).collect()
    assert len(nothing) == 3 and all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
