import os
import sys
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from bourse.llm import mixing, near_copies, quality, simhash  # noqa: E402
from bourse.llm.shared import stored  # noqa: E402

ROWS = plain.documents(seed=8)


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(ROWS, plain.SCHEMA), "test-docs")


def test_stages_against_plain_loops(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality_rules"](spark, docs, ""), "t")
    mask = quality.mask_of(quality.CURRENT)
    judged = {(r.doc_id, r.t): r.failed & mask for r in quality.ledger(docs.withColumn("x", F.struct("doc_id", F.col("text").alias("t"))), id="x").select("x.*", "failed").collect()}
    assert Counter((r.doc_id, r["text"]) for r in good.collect()) == Counter((r[0], r[1]) for r in ROWS if not judged[r[0], r[1]])

    cleaned = stored(stages["line_dedup"](spark, good, ""), "t")
    want = plain.without_windows([tuple(r) for r in good.collect()])
    assert cleaned.columns == docs.columns
    assert Counter((r.doc_id, r["text"]) for r in cleaned.collect()) == Counter((r.doc_id, want[r.doc_id, r["text"]]) for r in good.collect())

    near = stored(stages["simhash_near_dedup"](spark, cleaned, ""), "t")
    rows = cleaned.collect()
    group = _jaccard_groups([set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows])
    kept = Counter(group[[(r.doc_id, r["text"]) for r in rows].index((k.doc_id, k["text"]))] for k in near.collect())
    assert set(kept) == set(group) and set(kept.values()) == {1} and near.columns == docs.columns

    mixed = stored(stages["mix_sources"](spark, near, ""), "t")
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix_sources(near.withColumn("k", corpus_pipeline._key()), id="k", key=F.col("k.k1")).collect():
        want[r.k] += r.copies
    assert Counter(r.k for r in mixed.withColumn("k", corpus_pipeline._key()).collect()) == Counter({k: n for k, n in want.items() if n})

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = stages["sentence_pieces"](spark, mixed, "")
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((r.doc_id, tuple(sp.encode(r["text"] or "", add_eos=True))) for r in mixed.collect())


def _jaccard_groups(sets):
    """Index of the group of each set, all pairs of Jaccard 0.8 or more being joined; empty sets are alike to each other."""
    low = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if low[i] != low[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = min(low[i], low[j]), max(low[i], low[j])
                low = [a if x == b else x for x in low]
    return low


def test_near_stage_finds_what_a_jaccard_join_finds(spark):
    """On the driver's documents: every pair of Jaccard 0.8 or more is joined, and no other."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_want", F.lit(1)).withColumn("_Id", F.lit("x"))
    rows = docs.select("doc_id", "text").collect()
    sets = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    holders = {}
    for k, s in enumerate(sets):
        for h in s or {None}:
            holders.setdefault(h, []).append(k)
    low = list(range(len(rows)))

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    common = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), n in common.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])) and top(a) != top(b):
            low[max(top(a), top(b))] = min(top(a), top(b))
    want = sorted(min(rows[j].doc_id for j in range(len(rows)) if top(j) == k) for k in {top(j) for j in range(len(rows))})
    assert sorted(r.component_id for r in near_copies.near_keepers(docs).collect()) == want and len(want) < len(rows)


def test_stages_on_workers_without_the_package(tmp_path):
    """Every stage in a session whose workers can't import the package: another folder, no path to it."""
    import subprocess

    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {os.path.dirname(corpus_pipeline.__file__)!r})\n"
        "import corpus_pipeline\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "words = ' '.join(f'w{k}' for k in range(60))\n"
        "docs = spark.createDataFrame([(k, words + ('' if k % 2 else ' z') + f' {k // 2}' * 3, 'en', 's', 9) for k in range(12)], 'doc_id long, text string, lang string, source string, n_chars long')\n"
        "for name, stage in corpus_pipeline.STAGES:\n"
        "    docs = corpus_pipeline.stored(stage(spark, docs, ''), name)\n"
        "    print(name, docs.count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) > 5


def test_quality_keeps_scripts_without_spaces(spark):
    zh = "這是一個關於城市歷史的長句子沒有空格但是內容完全正常"
    many = " ".join(zh[k % 7 :] + str(k) for k in range(30))
    rows = spark.createDataFrame([(1, many), (2, " ".join("x" * 40 + str(k) for k in range(30)))], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(rows).collect()] == [1]
    assert quality.unspaced("กข漢字かなabc") == 6 and quality.unspaced("Straße") == 0


def test_near_copies_meet_and_unlike_texts_do_not():
    import random

    rng = random.Random(2)
    prints = lambda t: sum((x & (2**64 - 1)) << 64 * w for w, x in enumerate(simhash.fingerprint(simhash.shingle_hashes(t, 5), 4)))
    for _ in range(40):
        words = plain.prose(rng, 300).split()
        near = list(words)
        for k in rng.sample(range(len(near)), 4):
            near[k] = "other"
        a, b, c = prints(" ".join(words)), prints(" ".join(near)), prints(plain.prose(rng, 300))
        assert (a ^ b).bit_count() <= corpus_pipeline.RADIUS < (a ^ c).bit_count()


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def _jaccard_keepers(rows):
    """Smallest id of each group of rows (id, text) that pairs of Jaccard 0.8 or more join, all pairs compared."""
    sets = [_shingles(t) for _, t in rows]
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if low[i] != low[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = min(low[i], low[j]), max(low[i], low[j])
                low = [a if x == b else x for x in low]
    return sorted(rows[k][0] for k in set(low))


def _pairs_from(share, rng, count):
    """Texts in pairs whose first `share` is common, so that Jaccard runs about from 0.70 to 0.90."""
    rows = []
    for _ in range(count):
        n = rng.randint(60, 400)
        a, b = plain.prose(rng, n).split(), plain.prose(rng, n).split()
        keep = round(n * share(rng))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a[:keep] + b[keep:]))]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_near_copies_are_those_of_a_jaccard_join(spark, block):
    import random

    rng = random.Random(12)
    rows = _pairs_from(lambda r: r.uniform(0.82, 0.95), rng, 150)
    base = plain.prose(rng, 150).split()
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(60)]
    tail = plain.prose(rng, 110).split()
    rows += [(2000 + k, " ".join(tail + plain.prose(rng, 40).split())) for k in range(40)]  # all alike to about 0.55
    got = near_copies.near_keepers(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(r.component_id for r in got) == _jaccard_keepers(rows)


def test_repeated_lines_neither_join_nor_part_texts(spark):
    import random

    rng = random.Random(4)
    line = " all rights reserved by the press of this town since long ago"
    rows = []
    for k in range(8):  # copies of one text that end in the line once and a hundred times
        own = plain.prose(rng, 300)
        rows += [(2 * k, own + line), (2 * k + 1, own + line * 100)]
    rows += [(100 + k, plain.prose(rng, 200) + line * 100) for k in range(8)]  # texts that share nothing else
    got = near_copies.near_keepers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == _jaccard_keepers(rows) == [*range(0, 16, 2), *range(100, 108)]


def test_empty_table(spark):
    out = spark.createDataFrame([], plain.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, ""), name)
        assert out.count() == 0


def test_run_over_the_driver_table(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    assert corpus_pipeline.run(spark, folder).count() > 100
