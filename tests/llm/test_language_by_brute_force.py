"""The language query against its method done in full: all trigrams, all set sizes, no bounds."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from bourse.llm import language, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_query_over_its_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    names, table = plain.language_model([(r["text"], r.lang) for r in rows if not plain.held_out(r.doc_id)], language.BUCKETS, language.PRIOR)
    got = {r.doc_id: r for r in queries.language_mixtures(spark, FOLDER).collect()}
    for r in rows:
        said, score = plain.language_mixture(r["text"], names, table, language.STEPS)
        assert got[r.doc_id].lang_pred == said and abs(got[r.doc_id].score - score) < 2e-3, r.doc_id


def test_mixed_texts_of_many_languages(spark):
    rng = random.Random(3)
    words = {name: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)] for name, letters in zip("pqrstu", ("abcde", "cdefg", "efghi", "ghijk", "ijklm", "klmno"), strict=True)}
    said = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    training = [(said(name, 300), name) for name in words for _ in range(3)] + [("ignored", None)]
    asked = []
    for _ in range(60):
        parts = rng.sample(sorted(words), rng.randint(1, 4))
        asked.append((len(asked), " ".join(said(name, rng.choice([1, 3, 10, 60])) for name in parts)))
    asked += [(900, None), (901, "12 !"), (902, "zzz")]
    names, table = plain.language_model(training, language.BUCKETS, language.PRIOR)
    found = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(training, "text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    mixed = 0
    for i, text in asked:
        want, score = plain.language_mixture(text, names, table, language.STEPS)
        assert got[i][0] == want and abs(got[i][1] - score) < 2e-3, (i, text)
        mixed += 0 < score < 1
    assert mixed > 10  # sets of several languages are chosen
