"""Vector and keyword search against plain scans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bourse.operators import search


def _vectors(n, width, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, width))
    x = centres[rng.integers(0, groups, n)] + rng.normal(0, 0.5, (n, width))
    x[: n // 3] = x[0]  # a third of all vectors are one
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


def _plain(rows, asked, k):
    out = set()
    for qid, q in asked:
        scored = []
        for vid, v in rows:
            below = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
            s = round(sum(a * b for a, b in zip(v, q, strict=True)) / below, 9) if below else -math.inf
            scored.append((-s, vid))
        out |= {(qid, vid, rank) for rank, (_, vid) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("tile", "asked"), [(4096, 1024), (50, 7)])
def test_topk_by_tiles_is_a_scan(spark, monkeypatch, tile, asked):
    monkeypatch.setattr(search, "TILE", tile)
    monkeypatch.setattr(search, "ASKED", asked)
    monkeypatch.setattr(search, "AT_ONCE", 3)
    rows = _vectors(300, 8) + [(900, [0.0] * 8)]
    vectors = spark.createDataFrame([*rows, (901, None)], "vec_id long, v array<float>")
    exact = [(r.vec_id, [float(x) for x in r.v]) for r in vectors.where("v is not null").collect()]
    ask = [r for r in exact if r[0] % 13 == 0]
    queries = vectors.where("v is not null and vec_id % 13 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    got = {(r.qid, r.vec_id, r["rank"]) for r in search.vector_topk(queries, vectors, 5).collect()}
    assert got == _plain(exact, ask, 5)
    live = spark.createDataFrame([(k,) for k in range(150, 300)], "vec_id long")
    got = {(r.qid, r.vec_id, r["rank"]) for r in search.vector_topk(queries, vectors, 5, live=live).collect()}
    assert got == _plain([r for r in exact if 150 <= r[0] < 300], ask, 5)
    assert search.vector_topk(queries.limit(0), vectors, 5).count() == search.vector_topk(queries, vectors.limit(0), 5).count() == 0


def test_inverted_file_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = _vectors(4000, 16, seed=5, groups=40)
    rows = [(k, v) if k >= 1333 else (k, [float(x) for x in rng.normal(0, 1, 16)]) for k, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    folder = str(tmp_path / "index")
    search.write_vector_index(vectors, folder, lists=32)
    assert spark.read.parquet(f"{folder}/lists").count() == 4000
    near = {(r.qid, r.vec_id) for r in search.search_vector_index(spark, folder, queries, 10, probes=10).collect()}
    exact = {(r.qid, r.vec_id) for r in search.vector_topk(queries, vectors, 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    every = {(r.qid, r.vec_id) for r in search.search_vector_index(spark, folder, queries, 10, probes=32).collect()}
    assert every == exact


def _bm25(docs, queries, weights, k, k1=1.2, b=0.75):
    import re

    terms = lambda s: [t for t in re.sub("[^a-z0-9&]+", " ", (s or "").lower()).strip().split(" ") if t]
    bags = {d: ({f: terms(x) for f, x in zip(weights, fields, strict=True)}) for d, *fields in docs}
    length = {d: max(1, sum(map(len, bag.values()))) for d, bag in bags.items()}
    mean = sum(length.values()) / len(length)
    tf = lambda d, t: sum(w * bags[d][f].count(t) for f, w in weights.items())
    out = set()
    for qid, asked in queries.items():
        scores = {}
        for t in set(asked):
            hit = [d for d in bags if tf(d, t) > 0]
            for d in hit:
                scores[d] = scores.get(d, 0) + math.log(1 + (len(bags) - len(hit) + 0.5) / (len(hit) + 0.5)) * tf(d, t) * (k1 + 1) / (tf(d, t) + k1 * (1 - b + b * length[d] / mean))
        best = sorted((-round(s, 9), d) for d, s in scores.items())[:k]
        out |= {(qid, d, rank) for rank, (_, d) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_keyword_index_is_a_scan(spark, tmp_path, k):
    rng = random.Random(2)
    words = ["the", "of"] * 20 + [f"w{j}" for j in range(60)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["the press", "w3", None])) for d in range(200)] + [(900, None, None), (901, "the the the", "")]
    frame = spark.createDataFrame(docs, "doc long, text string, source string")
    queries = {q: rng.sample(sorted(set(words)), 4) + ["the", "none"] for q in range(15)}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts + ts[:1]], "qid long, term string")
    folder = str(tmp_path / "index")
    search.write_text_index(frame, folder, {"text": 1.0, "source": 3.0}, "doc")
    got = {(r.qid, r.doc, r["rank"]) for r in search.search_text_index(spark, folder, asked, k).collect()}
    assert got == _bm25(docs, queries, {"text": 1.0, "source": 3.0}, k)
