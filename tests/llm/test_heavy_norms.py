"""Neighbours of vectors whose norms differ widely."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import nn_descent


def test_one_huge_vector_and_heavy_tails_leave_the_others_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, 900)]
    x *= rng.lognormal(0, 0.5, (900, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    x[450] *= 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nn_descent.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9
