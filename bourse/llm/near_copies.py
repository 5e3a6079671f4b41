"""Near copies by the Jaccard similarity of their shingle sets: fingerprints find candidates, the sets decide.

Texts with equal sets are folded first. Fingerprints of distinct sets that differ in a wide radius of bits are linked as
in bourse.llm.simhash, where tiles of sets whose sizes rule out that they are alike do not meet; their components hold
every pair that may be alike. Only there are sets built again and compared.
A component is dealt into blocks of bounded size. Blocks link their own sets first, then pairs of blocks link what is not
yet in one group; a link counts where the intersection says so, so one group of many copies costs little more than one
comparison each, and what is not alike is compared in full.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm.components import components
from bourse.llm.shared import quoted, stored
from bourse.llm.simhash import SALTS, fingerprint, near_links, shingle_hashes

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Sets = tuple[np.ndarray, np.ndarray]  # the sets' hashes one after the other, and their sizes


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes in order."""
    x = np.frombuffer(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()), "<i8")
    return int(x[0]), int(x[1])


def _prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(_id, _a, _b, _n, _fp): key, size and fingerprint of each row's shingle set, from (_id, _text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                own = np.unique(shingle_hashes(t.as_py(), shingle))  # repeats would outweigh all others in the votes
                rows.append((*set_key(own), len(own), fingerprint(own, words)))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["_id", "_a", "_b", "_n", "_fp"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(task, f"_id {kind}, _a bigint, _b bigint, _n bigint, _fp array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(_a, _b, _set), from (_id, _text): key and ordered hashes of each row's shingle set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                own = np.unique(shingle_hashes(t.as_py(), shingle))
                a, b = set_key(own)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["_a", "_b", "_set"])

    return docs.select("_text").mapInArrow(task, "_a bigint, _b bigint, _set array<bigint>")


def alike_labels(labels: np.ndarray, prints: np.ndarray, sets: Sets, split: int, radius: int, alike: tuple[int, int]) -> np.ndarray:
    """Labels after joining the groups of all pairs within the radius whose Jaccard similarity is alike[0] / alike[1] or more.

    Rows before `split` meet rows from it on; with split 0 each row meets all later ones.
    """
    labels = labels.copy()
    hashes, sizes = sets
    num, den = alike
    ends = np.cumsum(sizes)
    _, codes = np.unique(hashes, return_inverse=True)
    flags = np.zeros(len(hashes) + 1, bool)
    for i in range(split or len(labels)):
        low = split or i + 1
        j = np.flatnonzero(labels[low:] != labels[i]) + low
        j = j[(np.minimum(sizes[j], sizes[i]) * den >= num * np.maximum(sizes[j], sizes[i])) & (sizes[j] > 0)]
        if len(j):
            far = np.zeros(len(j), np.uint16)
            for w in range(prints.shape[1]):
                far += np.bitwise_count(prints[j, w] ^ prints[i, w])
            j = j[far <= radius]
        if not len(j):
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        flags[own] = True
        if 2 * len(j) > len(labels):  # most rows: one pass over all their hashes
            sums = np.concatenate([[0], np.cumsum(flags[codes])])
            common = sums[ends[j]] - sums[ends[j] - sizes[j]]
        else:
            common = np.array([np.count_nonzero(flags[codes[ends[k] - sizes[k] : ends[k]]]) for k in j.tolist()])
        flags[own] = False
        joined = np.unique(labels[j[common * (num + den) >= num * (sizes[i] + sizes[j])]])
        if len(joined):
            joined = np.append(joined, labels[i])
            labels[np.isin(labels, joined)] = joined.min()
    return labels


def _arrays(batch: pa.RecordBatch, row: int, at: int, words: int) -> tuple[np.ndarray, np.ndarray, Sets]:
    nodes, bits, sizes, hashes = (batch.column(at + k)[row].values.to_numpy(zero_copy_only=False) for k in range(4))
    return nodes, bits.view(np.uint64).reshape(-1, words), (hashes, sizes)


def alike_links(blocks: DataFrame, words: int, radius: int, alike: tuple[int, int]) -> DataFrame:
    """(a, b): links that join exactly the sets of blocks (_root, _block, _blocks, _nodes, _bits, _sizes, _hashes) that alike pairs of one root join."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                nodes, prints, sets = _arrays(batch, r, 2, words)
                labels = alike_labels(nodes, prints, sets, 0, radius, alike)
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (nodes, labels)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), *lists], names=["_root", "_block", "_in", "_labels"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, p1, (h1, s1) = _arrays(batch, r, 0, words)
                _, p2, (h2, s2) = _arrays(batch, r, 5, words)
                old = np.concatenate([batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (4, 9)])
                new = alike_labels(old, np.concatenate([p1, p2]), (np.concatenate([h1, h2]), np.concatenate([s1, s2])), len(s1), radius, alike)
                moved = np.flatnonzero(new != old)
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(old[moved]), pa.array(new[moved])], names=["a", "b"])

    parts = ["_nodes", "_bits", "_sizes", "_hashes"]
    own = stored(blocks.select("_root", "_block", *parts).mapInArrow(inside, "_root bigint, _block int, _in array<bigint>, _labels array<bigint>"), "own-links")
    links = own.select(F.explode(F.arrays_zip("_in", "_labels")).alias("x")).select(F.col("x._in").alias("a"), F.col("x._labels").alias("b")).where("a <> b")

    many = blocks.where("_blocks > 1")
    names = many.select("_root", F.col("_block").alias("_left"), "_blocks")
    meet = names.select("_root", "_left", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_right")).where("_left < _right")
    full = many.join(own.select("_root", "_block", "_labels"), ["_root", "_block"])
    side = lambda name: full.select("_root", F.col("_block").alias(name), *[F.col(c).alias(c + name) for c in [*parts, "_labels"]])
    pairs = meet.join(side("_left"), ["_root", "_left"]).join(side("_right"), ["_root", "_right"])
    return links.union(pairs.select(*[c + name for name in ("_left", "_right") for c in [*parts, "_labels"]]).mapInArrow(between, "a bigint, b bigint"))


def near_keepers(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, alike: tuple[int, int] = (4, 5), words: int = 4, radius: int = 72, tile: int = 1 << 12, block: int = 1 << 20) -> DataFrame:
    """One row (component_id) per group of near copies, the smallest id in it; a row without any is its own group.

    Rows are linked where the Jaccard similarity of their sets of `shingle`-word shingles (as XXH64 values; words as in
    bourse.llm.simhash, texts with fewer are one shingle) is alike[0] / alike[1] or more, and groups are what links join.
    Texts without words are alike to each other only. Pairs whose fingerprints differ in more than `radius` of
    64 * `words` bits are not looked at, nor are sets of which one has too few members to be alike. Null ids count only
    where a group has no other. Other columns are not read, so clashing names do no harm. Empty in, empty out.
    """
    docs = docs.select(quoted(id).alias("_id"), quoted(text).alias("_text"))
    prints = stored(_prints(docs, shingle, words), "set-prints")
    folded = prints.groupBy("_a", "_b").agg(F.min("_id").alias("_low"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"))
    reps = stored(folded.withColumn("_node", F.monotonically_increasing_id()), "distinct-sets")
    # Sets alike to this share have sizes within it, so their logarithms to a base a little above its inverse lie in one or in neighbouring cells.
    step = math.log(alike[1] / alike[0]) + 1e-6
    scale = F.floor(F.log(F.greatest(F.col("_n"), F.lit(1))) / F.lit(step))
    wide = components(near_links(reps.select("_node", "_fp", "_n"), words, radius, 1, 16, tile, scale))

    # A component may hold a third of all sets: its size is looked up under salted keys, so that no task meets a whole one.
    # Components of one block, nearly all, need no look-up: Spark sizes the table before it is salted and would broadcast a row per salt and component.
    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")
    seen = stored(wide.join(reps, wide["node"] == reps["_node"]).select("node", F.col("root").alias("_root"), "_a", "_b", "_n", "_low", "_fp").withColumn("_salt", salt), "candidates")
    totals = seen.groupBy("_root").agg(F.ceil(F.sum("_n") / F.lit(block)).cast("int").alias("_blocks")).where("_blocks > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = seen.join(totals, ["_root", "_salt"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))

    lows = seen.select(F.col("_low").alias("_want")).distinct()
    sets = _sets(docs.join(lows, F.col("_id").eqNullSafe(F.col("_want")), "left_semi"), shingle).dropDuplicates(["_a", "_b"])
    rows = placed.join(sets, ["_a", "_b"]).groupBy("_root", "_block").agg(F.first("_blocks").alias("_blocks"), F.collect_list(F.struct("node", "_fp", "_n", "_set")).alias("_has"))
    blocks = stored(rows.select("_root", "_block", "_blocks", F.col("_has.node").alias("_nodes"), F.flatten("_has._fp").alias("_bits"), F.col("_has._n").alias("_sizes"), F.flatten("_has._set").alias("_hashes")), "blocks")

    roots = components(alike_links(blocks, words, radius, alike))
    ends = reps.select("_node", "_low").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    return ends.groupBy(F.coalesce("root", "_node").alias("_root")).agg(F.min("_low").alias("component_id")).select("component_id")
