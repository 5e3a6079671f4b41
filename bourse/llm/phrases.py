"""Phrase collocations by Toivonen mining.

A sample of documents proposes words and phrases. One full pass counts every proposed phrase and the negative border:
phrases that were not proposed but whose parts, without the first or without the last word, all were (of single words
all others). Where a phrase of the border turns out frequent, the border was not closed: it is added to the proposals
and a further pass counts what that opens, until a pass brings nothing new. A phrase is never more frequent than its
parts, so nothing frequent is missed, whatever the sample held.

Proposals grow with the corpus, so passes get them as a Bloom filter of bounded size; what it admits wrongly is counted
like the rest and changes no result. Passes count 61-bit keys of phrases: each task folds the keys of a million
phrases, ships them in blocks by key range, and the ranges are added up. Keys only select: the phrases whose key is
frequent are then counted again as the words themselves, and those counts decide.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted, stored

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BREAKS = b".,;:!?\n\x0b\x0c\r"
GULP = 1 << 20  # characters of one language that are cut into words at a time
SLICE = 1 << 18  # words that are numbered at a time
FLUSH = 1 << 20  # keys that are folded before they are shipped
RANGE = 1 << 24  # bytes of text for each range of keys, about
FILTER = 28  # the Bloom filter has at most 2 to this many bits
SAMPLE, SAMPLE_MINIMUM = 8, 2  # one document in SAMPLE proposes what it holds SAMPLE_MINIMUM times or more
SALTS = 8  # keys over which phrases with the same part are dealt while its count is looked up

_ONE_BREAK = bytes.maketrans(BREAKS, b"." * len(BREAKS))


def words_and_breaks(text: str) -> list[bytes]:
    """Words in order, A-Z lower-cased, with b"." where pieces end."""
    return text.encode().lower().translate(_ONE_BREAK).replace(b".", b" . ").split()


class Filter:
    """A Bloom filter of 64-bit keys: two places, in the upper and the lower half of a key."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.shift = np.uint64(64 - int(math.log2(8 * len(bits))))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), np.uint8)
        for place in (keys >> self.shift, (keys << np.uint64(29)) >> self.shift):
            found &= self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)
        return found.astype(bool)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Slice:
    """Numbered words of one language. Phrases that begin in the first `own` places are this slice's; the rest is for their ends."""

    def __init__(self, lang: str, tokens: list[bytes], own: int, longest: int):
        self.lang, self.tokens, self.own, self.longest = lang, tokens, own, longest
        self.vocabulary = list(dict.fromkeys(tokens))
        number = dict(zip(self.vocabulary, range(len(self.vocabulary)), strict=True))
        self.ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        self.word = self.ids != number.get(b".", -1)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, which places begin a phrase of so many, keys): a key's last three bits are the number of words."""
        first = found = self.hashes[self.ids]
        valid = self.word
        for k in range(1, longest + 1):
            if k > 1:
                found = _mixed(found[:-1], first[k - 1 :])
                valid = valid[:-1] & self.word[k - 1 :]
            yield k, valid, (found & ~np.uint64(7)) | np.uint64(k)

    def opened(self, known: Filter | None, before: Filter | None) -> Iterator[np.ndarray]:
        """Keys of the phrases to count: those whose parts are all in `known`, without those whose parts were all in `before`; all without filters."""
        now = old = None
        for k, valid, keys in self.grams(self.longest):
            admitted = valid if now is None else valid & now[:-1] & now[1:]
            done = None if before is None else valid if old is None else valid & old[:-1] & old[1:]
            new = admitted if done is None else admitted & ~done
            yield keys[: self.own][new[: self.own]]
            if known is not None and k < self.longest:
                now, old = admitted.copy(), None if done is None else done.copy()
                at = np.flatnonzero(admitted)
                now[at] = known.has(keys[at])
                if old is not None:
                    at = np.flatnonzero(done)
                    old[at] = before.has(keys[at])

    def exact(self, frequent: Filter) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(words, phrases, their counts here) for the phrases whose key is in the filter."""
        for k, valid, keys in self.grams(self.longest):
            at = np.flatnonzero(valid[: self.own])
            at = at[frequent.has(keys[at])]
            code = self.ids[at]
            for j in range(1, k):  # names of the first j + 1 words; equal names are equal words
                code = np.unique(code * len(self.vocabulary) + self.ids[at + j], return_inverse=True)[1]
            _, where, n = np.unique(code, return_index=True, return_counts=True)
            yield k, [b" ".join(self.tokens[p : p + k]).decode() for p in at[where].tolist()], n


def slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Slice]:
    """The texts by language, about GULP characters at a time, in slices of at most SLICE words."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> Iterator[Slice]:
        sizes.pop(lang)
        tokens = words_and_breaks("\n".join(held.pop(lang)))
        for at in range(0, len(tokens), SLICE):
            yield Slice(lang, tokens[at : at + SLICE + longest - 1], min(SLICE, len(tokens) - at), longest)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
            if sizes[lang] >= GULP:
                yield from cut(lang)
            elif sum(sizes.values()) >= 4 * GULP:
                for name in list(held):
                    yield from cut(name)
    for name in list(held):
        yield from cut(name)


def frequent_keys(texts: DataFrame, ranges: int, minimum: int, longest: int, known: bytes | None = None, before: bytes | None = None) -> DataFrame:
    """(key, n, words, proposed) of the phrases that this pass opens and finds `minimum` times or more; proposed: the filter holds it."""
    context = texts.sparkSession.sparkContext
    held = context.broadcast((known, before))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if f is None else Filter(f) for f in held.value]
        waiting, size = [], 0

        def shipped() -> pa.RecordBatch:
            every = np.concatenate(waiting)
            waiting.clear()
            every.sort()
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            keys, n = every[starts], np.diff(np.append(starts, len(every)))
            home = (keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)
            cuts = np.searchsorted(home, np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            parts = [[x[cuts[b] : cuts[b + 1]].astype(kind).tobytes() for b in full] for x, kind in ((keys, "<u8"), (n, "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], names=["_range", "_keys", "_n"])

        for part in slices(batches, longest):
            for keys in part.opened(*filters):
                waiting.append(keys)
                size += len(keys)
                if size >= FLUSH:
                    yield shipped()
                    size = 0
        if size:
            yield shipped()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if held.value[0] is None else Filter(held.value[0])
        home, keys, n = None, [], []

        def added() -> pa.RecordBatch:
            every, weight = np.concatenate(keys), np.concatenate(n).astype(np.int64)
            order = np.argsort(every, kind="stable")
            every = every[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            total = np.add.reduceat(weight[order], starts)
            some = total >= minimum
            own = every[starts][some]
            proposed = np.zeros(len(own), bool) if known is None else known.has(own)
            columns = [own.view(np.int64), total[some], (own & np.uint64(7)).astype(np.int32), proposed]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "words", "proposed"])

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(0)[r].as_py() != home and keys:
                    yield added()
                    keys, n = [], []
                home = batch.column(0)[r].as_py()
                keys.append(np.frombuffer(batch.column(1)[r].as_py(), "<u8"))
                n.append(np.frombuffer(batch.column(2)[r].as_py(), "<u4"))
        if keys:
            yield added()

    dealt = texts.mapInArrow(blocks, "_range int, _keys binary, _n binary").repartition(ranges, "_range").sortWithinPartitions("_range")
    return stored(dealt.mapInArrow(sums, "key bigint, n bigint, words int, proposed boolean"), "phrase-keys")


def filter_bits(n: int) -> int:
    """The logarithm of a filter's size for n keys: 16 to 32 bits a key up to the bound, beyond it fewer."""
    return min(FILTER, max(16, math.ceil(math.log2(16 * max(1, n)))))


def filter_of(keys: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the column `key`, 2 to `bits` bits. Segments are made in tasks; the whole is bounded."""
    shift, segment = 64 - bits, 16
    places = F.array(F.shiftrightunsigned("key", shift), F.shiftrightunsigned(F.shiftleft("key", 29), shift))
    placed = keys.select(F.explode(places).alias("p"))
    sets = placed.groupBy(F.shiftright("p", segment).alias("segment")).agg(F.collect_set(F.col("p").bitwiseAND(F.lit((1 << segment) - 1)).cast("int")).alias("places"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(1):
                flags = np.zeros(1 << segment, np.uint8)
                flags[p.values.to_numpy(zero_copy_only=False)] = 1
                rows.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["segment", "bits"])

    whole = bytearray(1 << bits - 3)
    for row in sets.mapInArrow(packed, "segment bigint, bits binary").collect():
        at = row.segment << segment - 3
        whole[at : at + len(row.bits)] = row.bits
    return bytes(whole)


def _either(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def phrase_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", minimum: int = 10, longest: int = 3, sample: int = SAMPLE, sample_minimum: int = SAMPLE_MINIMUM) -> DataFrame:
    """(lang, words, phrase, n): words and phrases of up to `longest` (7 at most) words that a language holds `minimum` times or more.

    One row more per language, with words 0 and an empty phrase, counts all its words. Words are runs of anything but
    space and tab in pieces of the lower-cased (A-Z) text that end at any of BREAKS; null texts are empty, null
    languages are `und`. Rows count as often as they stand there. Languages without words give no row.
    """
    texts = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("_lang"), body(text).alias("_text"))
    picked = docs.where(F.pmod(F.xxhash64(quoted(id)), F.lit(sample)) == 0).select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("_lang"), body(text).alias("_text"))
    ranges = 1 + docs.agg(F.coalesce(F.sum(F.octet_length(body(text))), F.lit(0))).first()[0] // RANGE

    proposals = frequent_keys(picked, 1 + ranges // sample, sample_minimum, longest - 1) if longest > 1 else None
    bits = filter_bits(2 * proposals.count()) if proposals is not None else 16
    known = filter_of(proposals.select("key"), bits) if proposals is not None else bytes(1 << bits - 3)
    before, found = None, []
    while True:
        found.append(frequent_keys(texts, ranges, minimum, longest, known, before))
        failed = found[-1].where(~F.col("proposed") & (F.col("words") < longest)).select("key")
        if failed.isEmpty():
            break
        before, known = known, _either(known, filter_of(failed, bits))

    every = found[0].select("key")
    for more in found[1:]:
        every = every.union(more.select("key"))
    context = docs.sparkSession.sparkContext
    held = context.broadcast(filter_of(every, filter_bits(every.count())))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Filter(held.value)
        for part in slices(batches, longest):
            rows = [(0, [""], np.array([np.count_nonzero(part.word[: part.own])])), *part.exact(frequent)]
            for k, phrases, n in rows:
                columns = [pa.array([part.lang] * len(n), pa.string()), pa.array([k] * len(n), pa.int32()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])

    exact = texts.mapInArrow(counted, "lang string, words int, phrase string, n bigint").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(exact.where((F.col("n") >= minimum) | ((F.col("words") == 0) & (F.col("n") > 0))), "phrase-counts")


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", minimum: int = 10, longest: int = 3, first: int = 2000, share: int = 50, scale: int = 1_000_000) -> DataFrame:
    """Each language's `first` phrases of 2 to `longest` words by how much more often they stand together than apart.

    Columns: lang, rank (from 1), phrase, a (times found), l and r (those of the two parts of its worst cut), n (words
    of the language), score = floor(scale * a * a / (l * r)), the least over all cuts (the earliest of equals), in
    exact integers. A phrase inside a longer candidate that is found at least `share` per cent as often is left out.
    Order: score and a descending, phrase ascending by UTF-8 bytes. See `phrase_counts` for words, nulls and repeated
    rows. Other columns are not read, so clashing names do no harm. Empty in, empty out.
    """
    counts = phrase_counts(docs, id, text, lang, minimum, longest)
    long = counts.where("words > 1").withColumn("_w", F.split("phrase", " "))
    inner = [F.struct(_part(F.col("_w"), s, k).alias("phrase"), ((F.col("words") > k) & (F.col("words") >= s + k - 1)).alias("_fits")) for k in range(2, longest) for s in range(1, longest - k + 2)]
    rivals = None
    if inner:
        parts = long.select("lang", "n", F.explode(F.array(*inner)).alias("_p"), F.size("_w").alias("_size"), "_w").where("_p._fits")
        rivals = parts.groupBy("lang", F.col("_p.phrase").alias("phrase")).agg(F.max("n").alias("_rival"))
    kept = long if rivals is None else long.join(rivals, ["lang", "phrase"], "left").where(F.col("_rival").isNull() | (100 * F.col("_rival") < share * F.col("n"))).drop("_rival")

    # A frequent word begins or ends a large share of all phrases: counts of parts are looked up under salted keys.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("_k"), salt.alias("_salt"))
    cuts = cuts.select("lang", "phrase", "a", "_k", "_salt", _part(F.col("_w"), F.lit(1), F.col("_k")).alias("_left"), _part(F.col("_w"), F.col("_k") + 1, F.size("_w")).alias("_right"))
    sides = counts.where(F.col("words").between(1, longest - 1)).select("lang", F.col("phrase").alias("_side"), F.col("n").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    named = lambda part, n: sides.select("lang", "_salt", F.col("_side").alias(part), F.col("_n").alias(n))
    scored = cuts.join(named("_left", "l"), ["lang", "_salt", "_left"]).join(named("_right", "r"), ["lang", "_salt", "_right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    scored = scored.withColumn("_top", F.lit(scale).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("_under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("_top div _under"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_x")).select("lang", "phrase", "a", "_x.l", "_x.r", "_x.score")
    # The first of each share of a language's phrases, then the first of those: a language is never ranked whole in one task.
    order = lambda *keys: Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    shares = worst.withColumn("_share", F.pmod(F.xxhash64("phrase", F.lit(1)), F.lit(SALTS)).cast("int"))
    some = shares.withColumn("_place", F.row_number().over(order("_share"))).where(F.col("_place") <= first)
    top = some.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= first)
    totals = counts.where("words = 0").select("lang", F.col("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
