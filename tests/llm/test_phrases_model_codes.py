import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from bourse.llm import neural_lm, phrases, vector_codes  # noqa: E402

ROWS = plain.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, plain.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def _table(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("minimum", "longest", "sample"), [(10, 3, 8), (2, 3, 1), (3, 4, 1 << 40), (2, 2, 3)])
def test_phrases_whatever_the_sample_held(docs, minimum, longest, sample):
    clash = docs.withColumn("phrase", F.lit("x")).withColumn("words", F.lit(1))
    counts = phrases.phrase_counts
    try:  # a sample of nothing, of all, and of some propose different phrases and end with the same table
        phrases.phrase_counts = lambda *a: counts(*a, sample=sample)
        got = _table(phrases.collocations(clash, minimum=minimum, longest=longest, first=50))
    finally:
        phrases.phrase_counts = counts
    assert got == plain.phrase_table([(r[1], r[2]) for r in ROWS], minimum, longest, 50)


def test_phrases_across_slices_and_languages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 7)
    monkeypatch.setattr(phrases, "GULP", 60)
    monkeypatch.setattr(phrases, "FLUSH", 20)
    monkeypatch.setattr(phrases, "RANGE", 500)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("a b c É d. e,f A\tb x;y".split(" ")) for _ in range(rng.randint(0, 40))), rng.choice(["p", "q", None])) for k in range(80)]
    rows += [(k, "a b c " * 300, "hot") for k in range(5)]  # one language, one phrase, most of all words
    got = _table(phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), minimum=4, first=30))
    assert got == plain.phrase_table([r[1:] for r in rows], 4, 3, 30)


def test_phrase_scores_pass_64_bits(spark, monkeypatch):
    counts = [("x", 0, "", 5 * 10**12), ("x", 1, "a", 3 * 10**12), ("x", 1, "b", 10**12 + 7), ("x", 2, "a b", 10**12)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: spark.createDataFrame(counts, "lang string, words int, phrase string, n long"))
    assert [r.score for r in phrases.collocations(None).collect()] == [1_000_000 * 10**24 // (3 * 10**12 * (10**12 + 7))]


def test_phrases_of_empty_tables(none, spark):
    assert phrases.collocations(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x"), (None, " .,\n", "x")], "doc_id long, text string, lang string")
    assert phrases.phrase_counts(blank).count() == 0


def _vectors(seed, n, width, top=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, n)), [float(np.float32(x)) for x in rng.normal(0, top, width)], int(rng.integers(0, 3))) for _ in range(n)]
    rows = [r if k % 3 else (r[0], r[1], 1) for k, r in enumerate(rows)] + [(r[0], r[1], None) for r in rows[:20]]
    rows += [rows[0], rows[0], (None, rows[1][1], 0)]
    return rows + [(1, None, 0), (2, [], 0), (3, [None] * width, 1), (4, [float("nan")] * width, 1), (5, [1.0] * (width - 1) + [float("-inf")], 2)]


def _coded(df):
    rows = df.collect()
    return Counter((r.vec_id, r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


@pytest.mark.parametrize(("width", "parts", "entries", "top"), [(16, 4, 8, 1.0), (12, 4, 5, 0.02), (6, 6, 64, 3.0), (14, 2, 300 - 64, 0.001)])
def test_vector_codes_by_all_distances(spark, width, parts, entries, top):
    rows = _vectors(width, 150, width, top)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("Code", F.lit("clash")).withColumn("_id", F.lit(1)).repartition(3)
    got, digests = _coded(vector_codes.compress(table, parts=parts, entries=entries))
    want, digest = plain.vector_codes(rows, parts, entries, 2)
    assert got == Counter(want) and digests == {digest}


def test_vector_codes_of_huge_components(spark):
    rows = [(k, [x * (-1) ** k, 1.0, -0.5, x / 3], k % 2) for k, x in enumerate([1.0, 3e5, 7e5, 2e6, 1e7, 2.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, digests = _coded(vector_codes.compress(table, parts=2, entries=3))
    want, digest = plain.vector_codes(rows, 2, 3, 2)
    assert got == Counter(want) and digests == {digest}
    held = spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [-1e300, 3e38], 0)], "vec_id long, embedding array<double>, label int")
    assert {r.error for r in vector_codes.compress(held, parts=1, entries=1, rounds=1).collect()} == {vector_codes.LARGEST}


def test_nearest_keeps_ties_and_early_exits_exact():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 8):
        parts, entries = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (40, width))
        far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        at, distance = vector_codes.nearest(parts, entries)
        assert (at == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    rows = vector_codes.walsh_rows(16)
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(16)) and (rows @ rows.T == 16 * np.eye(16)).all()


def test_vector_codes_of_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [], None)], kind)).count() == 0


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def _plain_score(v, model, text):
    """log10 probability of one text, one token after the other."""
    a, b, z = (x.astype(float) for x in neural_lm.Model(model).scores())
    x = y = 0
    total = 0.0
    for w in [*(w.encode() for w in plain.lower_words(text)), None]:
        t = 0 if w is None else v.output(w)
        total += (a[x, t] + b[y, t] - z[x, y]) / math.log(10)
        if w is not None and w not in v.frequent:
            total += math.log10((ALL[w] + 0.5) / (v.tokens[t] + 0.5 * (v.distinct[t] + 1)))
        x, y = t, x
    return total


ALL = Counter(w.encode() for r in ROWS if not _held(r[0]) for w in plain.lower_words(r[1]))


@pytest.mark.parametrize("table", [1 << 18, 40])
def test_model_scores_token_by_token(docs, monkeypatch, table):
    monkeypatch.setattr(neural_lm, "TABLE", table)
    got = neural_lm.lm_scores(docs.withColumn("word", F.lit("x")).withColumn("_row", F.lit(1)), held()).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r[:5])
    mine = sorted(((r.doc_id, r.held_out, r["n_tokens"], r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for m, w in zip(mine, sorted(plain.base_scores([r[:2] for r in ROWS], _held), key=key), strict=True):
        assert m[:5] == w[:5] and m[5] == pytest.approx(w[5], rel=1e-9)
    training = docs.where(~F.coalesce(held(), F.lit(False))).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    v = neural_lm.vocabulary(neural_lm.word_counts(training), training.count())
    assert v.tokens.sum() == v.train_tokens and v.distinct.sum() == v.train_words and len(v.counts) <= table
    model = neural_lm.trained(training, v)
    texts = {r[0]: r[1] for r in ROWS if r[0] not in (None, 5)}
    for r in got:
        if r.doc_id in texts and r["n_tokens"] < 2000:
            assert r.score == pytest.approx(_plain_score(v, model, texts[r.doc_id]), rel=1e-4, abs=1e-3)


def test_model_is_normalised_over_all_words():
    rng = np.random.default_rng(2)
    model = neural_lm.Model(rng.normal(0, 0.7, 2 * neural_lm.OUTPUTS * neural_lm.WIDTH + neural_lm.OUTPUTS + 2 * neural_lm.WIDTH).astype(np.float32))
    a, b, z = model.scores()
    for x, y in rng.integers(0, neural_lm.OUTPUTS, (50, 2)):
        assert np.exp((a[x] + b[y]).astype(float) - z[x, y]).sum() == pytest.approx(1, abs=1e-4)
    words = {b"zoning": 5, b"moning": 2, b"x": 1}
    tokens, distinct = np.zeros(neural_lm.OUTPUTS, np.int64), np.zeros(neural_lm.OUTPUTS, np.int64)
    v = neural_lm.Vocabulary(words, {}, {"ing": 1 + neural_lm.FREQUENT}, tokens, distinct, 8, 3)
    for w, c in words.items():
        tokens[v.output(w)] += c
        distinct[v.output(w)] += 1
    for place in {v.output(w) for w in words}:
        share = [math.log10(c + 0.5) - v.within()[place] for w, c in words.items() if v.output(w) == place] + [math.log10(0.5) - v.within()[place]]
        assert sum(10**s for s in share) == pytest.approx(1)


def test_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in neural_lm.lm_scores(docs, held()).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)  # on 200 documents by a percent, on 10,000 by a tenth


def test_model_of_empty_tables(spark, none, docs):
    assert neural_lm.lm_scores(none, held()).count() == 0
    alone = neural_lm.lm_scores(docs.limit(5), F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in alone] == [(0, 0, pytest.approx(0, abs=1e-9))] * 5
