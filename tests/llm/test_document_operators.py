import os
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from bourse.llm import components, exact_dedup, language, license_scan, line_dedup, mixing, piece_bpe, quality, queries, simhash, token_counts, token_store  # noqa: E402
from bourse.llm.oracles import ORACLES  # noqa: E402
from bourse.llm.shared import new_path  # noqa: E402
from tools.check import canon, connect  # noqa: E402

ROWS = plain.documents()
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, plain.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], plain.SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rel = connect(FOLDER).execute(ORACLES[name])
    names, rows = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, df.collect()) == canon(names, rows)


def test_exact_dedup(docs, none):
    want = plain.exact_keepers(ROWS)
    got = exact_dedup.exact_dedup(docs, carry={"t": F.col("text")}).collect()
    assert len(got) == len(ROWS)
    kept = Counter()
    for r in got:
        assert (r.group_size, r.keep_id) == want[r.t or ""]
        kept[r.t or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_quality_measures_policies_and_ablations(docs, none):
    book = quality.ledger(docs).cache()
    key = lambda r: (r[0] is not None, r)
    got = sorted(((r.doc_id, (r["n_words"], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in book.collect()), key=key)
    assert got == sorted(((r[0], plain.quality(r[1])) for r in ROWS), key=key)
    base, now = quality.mask_of(quality.BASE), quality.mask_of(quality.CURRENT)
    judged = quality.verdicts(book, {"base": base, "kept": now}).collect()
    for r in judged:
        assert r.base == (r["n_words"] >= 20 and 100 * r.n_repeat_words <= 30 * r["n_words"])
        assert not r.kept or r.base
    table = {(r.version, r.rule): r for r in quality.ablations(book).collect()}
    for p in quality.POLICIES:
        mask = quality.mask_of(p)
        for rule in quality.RULES:
            if rule.name in p.rules:
                bit, row = 1 << rule.bit, table[p.version, rule.name]
                assert row.rejected == sum(bool(r.failed & mask) for r in judged)
                assert row.failed == sum(bool(r.failed & bit) for r in judged)
                assert row.only_this == sum(r.failed & mask == bit for r in judged)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in judged)
    assert quality.ledger(none).count() == quality.keep_good(none).count() == quality.ablations(quality.ledger(none)).count() == 0


def test_repeated_windows_need_equal_words():
    a = [b"w%d" % k for k in range(40)]
    assert quality.repeated_words(a) == 0
    assert quality.repeated_words(a[:7] + a[:7]) == 0
    assert quality.repeated_words(a[:8] + a[:8]) == 16
    assert quality.repeated_words([b"x"] * 9) == 9


def test_simhash_prints_and_components(docs, none):
    got = simhash.near_groups(docs).select("doc_id", simhash.hex_fingerprint(F.col("_fp")).alias("f"), "component_id").collect()
    prints = [plain.simhash(r[1]) for r in ROWS]
    group = plain.linked_groups(prints, 3)
    lowest = defaultdict(list)
    for r, g in zip(ROWS, group, strict=True):
        lowest[g].append(r[0])
    want = Counter((r[0], f"{p:016x}", min((i for i in lowest[g] if i is not None), default=None)) for r, p, g in zip(ROWS, prints, group, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize(("words", "radius", "segments", "coarse", "tile"), [(1, 3, 4, 1, 16), (1, 3, 1, 1, 8), (2, 9, 2, 2, 16), (4, 20, 1, 16, 32), (1, 3, 8, 1, 50)])
def test_tiles_lose_no_link(spark, words, radius, segments, coarse, tile):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    rows = []
    for k in range(300):
        base = seeds[k % 40].copy()
        for b in rng.integers(0, 64 * words, rng.integers(0, radius + 2)):
            base[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append([int(x) for x in base.view(np.int64)])
    rows = [list(x) for x in {tuple(r) for r in rows}]
    reps = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "_node long, _fp array<bigint>")
    found = {r.node: r.root for r in components.components(simhash.near_links(reps, words, radius, segments, coarse, tile)).collect()}
    whole = [sum((x & (2**64 - 1)) << 64 * w for w, x in enumerate(r)) for r in rows]
    assert [found.get(k, k) for k in range(len(rows))] == plain.linked_groups(whole, radius)


def test_components_of_chain_star_and_cycle(spark):
    chain = [(k, k + 1) for k in range(100, 250)]
    star = [(900, k) for k in range(400, 440)]
    cycle = [(20, 21), (21, 22), (22, 20), (22, 20), (30, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star + cycle, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 251)} | {k: 400 for k in [*range(400, 440), 900]} | {20: 20, 21: 20, 22: 20, 30: 30}


def test_line_dedup(docs, none):
    want = plain.without_windows(ROWS)
    old = docs.withColumn("old", F.col("text"))
    out = line_dedup.line_dedup(old.withColumn("N_Removed", F.lit("clash")))
    got = out.collect()
    assert len(got) == len(ROWS) and out.columns[-2:] == ["n_lines", "n_removed"]
    for r in got:
        assert r["text"] == want[r.doc_id, r["old"]]
        assert r["n_lines"] == len((r["old"] or "").split("\n"))
    assert line_dedup.line_dedup(none).count() == 0


def test_mixing_meets_targets(docs, none):
    got = mixing.mix_sources(docs.withColumn("id", F.struct("doc_id", F.monotonically_increasing_id().alias("k"))), id="id").collect()
    size = lambda t: len(plain.WORD.findall(t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in ROWS)
    totals = defaultdict(int)
    for r in ROWS:
        totals[r[3]] += size(r[1])
    want = plain.targets(dict(totals))
    assert sorted(totals.values()) == sorted({r.source_size: 0 for r in got})
    by_total = {totals[s]: (s, want[s]) for s in totals}
    for total, (s, target) in by_total.items():
        mine = [r for r in got if r.source_size == total]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) for r in mine)
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mine)
        filled = [r for r in mine if r["size"]]
        rates = plain.tilt([r["size"] for r in filled], target, 3.0) if target < 3 * total else [3.0] * len(filled)
        assert all(abs(r.rate - x) < 1e-3 for r, x in zip(filled, rates, strict=True))
        off = abs(sum(r.taken for r in mine) - target)
        assert off <= max(2, 0.02 * target) or off <= max(r["size"] for r in filled) / 2  # one document may be longer than the target
    again = mixing.mix_sources(docs)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_targets_stop_at_cap(spark):
    sizes = {"a": 10, "b": 0, "c": 500, "d": 3, "é": 40, "😀": 7, None: 5}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "_source string, _tokens long, _docs long")
    got = {r._source: r._target for r in mixing.source_targets(rows).collect()}
    want = plain.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_licences(spark, none):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "p/LICENSE", mit), (2, "p/a/x.c", "code"), (3, "p/a/b/y.c", f"head\n{apache}\ncode"), (4, "p/a/b/z.c", None), (5, "q/n.c", ""), (6, None, mit), (7, "top.c", "x"),
        (8, "p/a/b/LICENSE", f"{mit}\n{apache}"), (9, "p/a/b/LICENSE", "nothing"), (10, "pp/x", "by the way, see the version under the bridge"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.inherited, r.from_dir) for r in license_scan.license_scan(files, licensing="^LICENSE$").collect()}
    both = ("Apache-2.0", False, "p/a/b")
    assert got == {1: ("MIT", False, "p"), 2: ("MIT", True, "p"), 3: both, 4: ("Apache-2.0", True, "p/a/b"), 5: (None, False, None), 6: (None, False, None), 7: (None, False, None), 8: both, 9: both, 10: (None, False, None)}
    assert license_scan.license_scan(none.withColumn("path", F.col("text"))).count() == 0


def test_pieces_as_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = piece_bpe.encode_pieces(docs, PIECES, digests=True)
    got = Counter((r.doc_id, tuple(r.ids), r["n_tokens"], r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = Counter()
    for r in ROWS:
        ids = sp.encode(r[1] or "", add_eos=True)
        want[r[0], tuple(ids), len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(sp.decode(ids))] += 1
    assert got == want
    back = piece_bpe.decode_pieces(out, PIECES)
    assert all(r["text"] == sp.decode(list(r.ids)) for r in back.collect())
    assert piece_bpe.encode_pieces(none, PIECES).count() == 0


def test_pieces_of_random_characters():
    import random

    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    encoder = piece_bpe.Encoder(piece_bpe.read_model(PIECES))
    texts = ["".join(rng.choice("abcdeéèß tion\n▁  thé漢🎉.,s") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert list(encoder.encode(texts)) == [sp.encode(t, add_eos=True) for t in texts]


def test_token_store_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    folder = new_path(spark, "test-tokens")
    token_store.write_tokens(docs, folder, WORDS, end=2)
    got = token_store.read_tokens(spark, folder, digests=True).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    before = 0
    for r, g in zip(order, got, strict=True):
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        assert (g.id, g.start, g["n_tokens"], list(g.ids), g.ids_crc32) == (r[0], before, len(ids), ids, plain.crc_of(ids))
        before += len(ids)
    few = token_store.read_documents(spark, folder, [3, 7])
    assert few == [(i, whole.encode(ROWS[i][1], add_special_tokens=False).ids + [2]) for i in (3, 7)]
    empty = new_path(spark, "test-tokens")
    token_store.write_tokens(none, empty, WORDS, end=2)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_token_counts(docs, none):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = token_counts.read_encoding(ranks, pattern)
    counts = [len(encoding.encode_ordinary(r[1] or "")) for r in ROWS]
    table = token_counts.length_table(token_counts.encoded_lengths(docs, ranks, pattern)).cache()
    assert sorted((r["n_tokens"], r.n_docs, r.docs_longer, r.truncated_total) for r in table.collect()) == plain.lengths(counts)
    for r in token_counts.at_limits(table, [0, 3, 100, 10**6]).collect():
        assert (r.docs_longer, r.truncated_total) == (sum(c > r.context_limit for c in counts), sum(min(c, r.context_limit) for c in counts))
    assert token_counts.quantile(table, 0.5).first()["n_tokens"] == sorted(counts)[(len(counts) - 1) // 2]
    assert token_counts.length_table(token_counts.encoded_lengths(none, ranks, pattern)).count() == 0


def test_texts_of_a_million_characters():
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = token_counts.read_encoding(ranks, pattern)
    run = " " * 1_000_000
    whole = len(encoding._core_bpe.encode_single_piece(run[1:].encode()))
    assert token_counts.count_tokens(encoding, run + "x") == whole + len(encoding.encode_ordinary(" x"))
    assert token_counts.count_tokens(encoding, run[:5000] + "x y") == len(encoding.encode_ordinary(run[:5000] + "x y"))
    store = token_store.WordEncoder(WORDS)
    assert len(store.encode(["7" * 300_000])[0]) == 2 * 300_000
    pieces = piece_bpe.Encoder(piece_bpe.read_model(PIECES))
    assert len(next(pieces.encode(["ab" * 300_000]))) > 100_000
    assert quality.measure("a " * 300_000)[4] == 300_000
    assert simhash.fingerprint(simhash.shingle_hashes("a b " * 100_000, 3))[0] == simhash.fingerprint(simhash.shingle_hashes("a b a b", 3))[0]


def test_a_long_text_counts_as_its_slices():
    import random

    letter = language.letters_table()
    text = plain.prose(random.Random(1), 900_000)
    assert len(text) > 2 * language.GULP
    whole = np.bincount(language.trigrams(f"\n{text.lower()}\n", letter)[1], minlength=language.BUCKETS)
    _, bucket, n = language.trigram_counts([text], letter)
    assert dict(zip(bucket.tolist(), n.tolist())) == {k: c for k, c in enumerate(whole.tolist()) if c}
    some = ["Der Tag", None, "1 x", text[:5000], ""]
    got = list(zip(*(x.tolist() for x in language.trigram_counts(some, letter))))
    assert got == [(d, int(b), int(c)) for d, t in enumerate(some) for _, b, c in zip(*language.trigram_counts([t], letter))]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in queries.language_mixtures(spark, FOLDER).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == true.keys()
    assert all(r.held_out == plain.held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == true[i] for i in held) >= 0.95 * len(held)


def test_language_mixtures_and_edges(spark, docs, none):
    train = spark.createDataFrame([("the thing and the other " * 40, "en"), ("der die und das ist " * 40, "de"), ("x", None)], "text string, lang string")
    mixed = "the thing and the other " * 3 + "und das ist der " * 12
    ask = spark.createDataFrame([(1, "the thing"), (2, "die und"), (3, mixed), (4, None), (5, "123 !?"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(ask, train).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3][0] == "de" and 0.5 < got[3][1] < 1
    assert {got[k] for k in (4, 5, 6)} == {("und", 0.0)}
    assert language.identify(docs, train).count() == len(ROWS)
    assert {r.lang_pred for r in language.identify(ask, train.where("lang is null")).collect()} == {"und"}
    assert language.identify(none, train).count() == 0
