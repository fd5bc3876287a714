"""Dense ranking over cells equals the full product and skips what cannot be reached."""

import numpy as np
from corrobora.operators import retrieval, vector_cells
from pyspark.sql import functions as F


def test_cells_are_exact_and_skip(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.04, (4000, 16))
    rows = [("a" if i % 10 else "b", i // 2, i % 2, [float(x) for x in v[i]]) for i in range(4000)]
    rows += [("a", 9000 + i, 0, [float(x) for x in v[0]]) for i in range(30)]                  # ties
    vectors = spark.createDataFrame(rows, "scope string, doc_id long, ordinal int, vector array<float>")
    asked = [(i, "a" if i % 3 else "b", [float(x) for x in centres[i] + rng.normal(0, 0.02, 16)]) for i in range(20)] + [(50, "a", [0.0] * 16), (51, "none", [1.0] * 16), (52, "a", [float(x) for x in v[0]])]
    questions = spark.createDataFrame(asked, "question_id long, scope string, vector array<float>")
    found, looked = vector_cells.dense_top(questions, vector_cells.cells(vectors))
    want = retrieval.dense_top(questions, vectors)
    columns = ["question_id", "doc_id", "ordinal", "score", "dense_rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    share = looked.filter("question_id < 50").agg(F.sum("scored") / F.sum("vectors")).first()[0]
    assert share < 0.4, share


def test_few_vectors(spark):
    vectors = spark.createDataFrame([("a", 1, 0, [1.0, 0.0]), ("a", 2, 0, [0.0, 1.0])], "scope string, doc_id long, ordinal int, vector array<float>")
    questions = spark.createDataFrame([(1, "a", [1.0, 0.5])], "question_id long, scope string, vector array<float>")
    assert [(r.doc_id, r.score) for r in vector_cells.dense_top(questions, vector_cells.cells(vectors))[0].orderBy("dense_rank").collect()] == [(1, 1.0), (2, 0.5)]
    assert vector_cells.dense_top(questions, vector_cells.cells(vectors.limit(0)))[0].count() == 0
