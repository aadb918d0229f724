import math

import numpy as np
import pytest

from evispark.llm import embedding_dedup
from evispark.llm.embedding_dedup import link_vectors, op4_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    width = max([len(r[1]) for r in rows if r[1]], default=0)
    at = [i for i, (_, v, l) in enumerate(rows) if l is not None and fine(v)]
    x = np.array([[*rows[i][1], *[0] * (width - len(rows[i][1]))] for i in at], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([rows[i][2] for i in at])
    near = (x @ x.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(at))
    while True:
        low = np.where(near, root[None], root[:, None]).min(1)
        low = np.minimum(low, root)
        if (low == root).all():
            break
        root = low
    links, comp = {}, {}
    for p, i in enumerate(at):
        keys = [rows[at[q]][0] for q in np.flatnonzero(root == root[p]) if rows[at[q]][0] is not None]
        links[i], comp[i] = int(near[p].sum()), min(keys, default=None)
    return sorted(((k, links.get(i, 0), comp.get(i, k), k == comp.get(i, k)) for i, (k, *_) in enumerate(rows)), key=str)


def clustered(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = centres[i % 12]
        v = c + rng.normal(size=dim) * rng.choice([0.01, 0.1, 1.0])
        if rows and i % 5 == 0:
            v = np.array(rows[-3][1] if len(rows) > 3 else v) * rng.choice([1, 2])
        rows.append((i * 2, [float(x) for x in v.astype(np.float32)], int(i % 3) if i % 11 else None))
    return rows


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None, 1.0], 1), (904, [], 1), (905, [float("inf"), 1.0], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1), (None, [5.0, -9.0], 2), (908, [1.0, 2.0], 1), (908, [1.0, 2.0], 1)]


@pytest.mark.parametrize("block", [1024, 5])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clustered(240) + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS n_links")
    got = sorted((tuple(r) for r in link_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 50


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in op4_embedding_dedup(spark, sf).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
