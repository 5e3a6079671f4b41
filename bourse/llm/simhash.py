"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are folded first. The distinct ones are dealt into cells by the population counts of equal segments
of their bits, cells into tiles of bounded size. Two fingerprints within the radius have population counts within it
too (the differences over all segments add up to no more than the differing bits), so only tiles of such cells are
paired; each pair is compared exactly with numpy exclusive-or and bit counts. A pair of tiles returns, for each
fingerprint that it links, the smallest of its group there, not all pairs. Components of these links are exact.

The comparison is quadratic in the distinct fingerprints by design; more segments skip more of it (see README).
"""

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.components import components
from bourse.llm.shared import quoted, stored

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 15  # shingles whose bits are counted at once
PAIRS = 24  # pairs of tiles for each task
SALTS = 64  # keys over which a cell's fingerprints are dealt while its size is looked up


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, joined by spaces; of all words where there are fewer; none without words."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z fall, only the six ASCII spaces split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    widths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(widths + 1) - 1
    starts = ends - widths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """`words` 64-bit words whose bits are set where over half the hashes have them set; word 0 is of the hashes themselves, others of mixes of them.

    With several words, a bit that exactly half the hashes set is set at odd places, so that few shingles don't drift
    towards the fingerprint zero.
    """
    ties = np.arange(64) % 2 if words > 1 and len(hashes) else np.zeros(64, np.int64)
    out = []
    for k in range(words):
        h = hashes
        if k:  # an odd multiple and two shift-multiply steps give bits of their own
            h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), PIECE):
            octets = h[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts + ties > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id: str, text: str, shingle: int, words: int) -> DataFrame:
    """(_id, _fp): one array of `words` 64-bit words per row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), shingle), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_id", "_fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")).mapInArrow(task, f"_id {kind}, _fp array<bigint>")


def _segment_counts(words: int, segments: int) -> Column:
    """Population counts of `segments` equal runs of the fingerprint's bits; a segment is whole words, or an equal part of one word."""
    if segments <= words:
        per = words // segments
        return F.array(*[sum((F.bit_count(F.element_at("_fp", s * per + k + 1)) for k in range(per)), F.lit(0)) for s in range(segments)])
    per, width = segments // words, 64 * words // segments
    mask = (1 << width) - 1
    return F.array(*[F.bit_count(F.shiftrightunsigned(F.element_at("_fp", w + 1), p * width).bitwiseAND(F.lit(mask).cast("long"))) for w in range(words) for p in range(per)])


def _neighbours(segments: int, radius: int, coarse: int) -> list[list[int]]:
    """Half of the offsets between cells that may hold linked fingerprints: those not below zero in lexicographic order.

    A step of d cells of `coarse` counts means that the counts differ by (|d| - 1) * coarse + 1 at least.
    """

    def within(n: int, left: int) -> Iterator[tuple[int, ...]]:
        if n == 0:
            yield ()
            return
        most = (left + coarse - 1) // coarse
        for d in range(-most, most + 1):
            yield from ((d, *rest) for rest in within(n - 1, left - max(0, (abs(d) - 1) * coarse + 1 if d else 0)))

    zero = (0,) * segments
    return [list(o) for o in within(segments, radius) if o >= zero]


def spanning_links(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, at_b: int, radius: int, rows: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) of the pairs a[i], b[j] within the radius; nodes holds a's, then from at_b on b's."""
    label = np.arange(len(nodes))
    step = max(1, rows // max(1, len(b)))
    for top in range(0, len(a), step):
        far = np.bitwise_count(a[top : top + step, None, 0] ^ b[None, :, 0])
        if a.shape[1] > 1:
            far = far.astype(np.uint16)
            for w in range(1, a.shape[1]):
                far += np.bitwise_count(a[top : top + step, None, w] ^ b[None, :, w])
        i, j = np.nonzero(far <= radius)
        i = i + top
        j = j + at_b
        if same:
            i, j = i[i < j], j[i < j]
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_links(reps: DataFrame, words: int, radius: int, segments: int, coarse: int, tile: int, scale: Column | None = None) -> DataFrame:
    """(a, b): links among distinct fingerprints (_node, _fp) that join exactly those that pairs within the radius join.

    With `scale`, a whole number per row, only pairs whose numbers differ by one at most are asked for; others may be skipped.
    """
    counts = F.transform(_segment_counts(words, segments), lambda c: F.floor(c / F.lit(coarse)).cast("int"))
    offsets = _neighbours(segments, radius, coarse)
    if scale is not None:
        counts = F.concat(F.array(scale.cast("int")), counts)
        both = offsets + [[-x for x in o] for o in offsets if any(o)]
        offsets = [[0, *o] for o in offsets] + [[1, *o] for o in both]
    # A cell may hold a third of all fingerprints: its size is looked up under SALTS keys, so that no task meets a whole cell.
    # Cells of one tile need no look-up, so there are at most SALTS rows for each tile's worth of fingerprints, and a broadcast of them stays small.
    cells = reps.withColumn("_cell", counts).withColumn("_salt", F.pmod(F.xxhash64("_node", F.lit(1)), F.lit(SALTS)).cast("int"))
    sizes = cells.groupBy("_cell").agg(F.count("*").alias("_in")).where(F.col("_in") > tile).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = cells.join(sizes, ["_cell", "_salt"], "left").withColumn("_tile", F.pmod(F.xxhash64("_node"), F.coalesce(F.ceil(F.col("_in") / F.lit(tile)), F.lit(1))).cast("int"))
    tiles = stored(cut.groupBy("_cell", "_tile").agg(F.collect_list(F.struct("_node", "_fp")).alias("_has")).select("_cell", "_tile", F.col("_has._node").alias("_nodes"), F.flatten("_has._fp").alias("_bits")), "tiles")

    # Which tiles meet is settled on their names alone; their contents join afterwards.
    steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])
    homes = tiles.select(F.col("_cell").alias("_home"), F.col("_tile").alias("_left"), F.explode(steps).alias("_step"))
    homes = homes.withColumn("_cell", F.zip_with("_home", "_step", lambda x, y: x + y)).drop("_step")
    meet = homes.join(tiles.select("_cell", "_tile"), "_cell").where("_home <> _cell or _left <= _tile")
    left = tiles.select(F.col("_cell").alias("_home"), F.col("_tile").alias("_left"), F.col("_nodes").alias("_ln"), F.col("_bits").alias("_lb"))
    pairs = meet.join(left, ["_home", "_left"]).join(tiles, ["_cell", "_tile"]).select("_ln", "_lb", "_nodes", "_bits", F.expr("_home = _cell and _left = _tile").alias("_same"))
    if scale is not None:  # few large tiles: their pairs are dealt out evenly, as each takes long for its few bytes
        pairs = pairs.repartition(1 + meet.count() // PAIRS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n1, b1, n2, b2 = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(4))
                same = batch.column(4)[r].as_py()
                a = b1.view(np.uint64).reshape(-1, words)
                b = a if same else b2.view(np.uint64).reshape(-1, words)
                u, v = spanning_links(n1 if same else np.concatenate([n1, n2]), a, b, same, 0 if same else len(n1), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return pairs.mapInArrow(task, "a bigint, b bigint")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, words: int = 1, radius: int = 3, segments: int = 4, coarse: int = 1, tile: int = 4096) -> DataFrame:
    """One row per input row: `id`, `_fp` (the fingerprint's words), component_id, the smallest id reachable by links.

    Text is whole, A-Z lower-cased; words end at the six ASCII spaces. Shingles are `shingle` words, repeats count;
    shorter texts are one shingle; null, empty and blank texts have fingerprint zero, which links like any other.
    Fingerprints link at `radius` or fewer differing bits. Null ids never become a component's id unless all of it are
    null. Repeated rows each get a row. Other columns are not passed on. Empty in, empty out.
    """
    prints = stored(fingerprints(docs, id, text, shingle, words), "fingerprints")
    folded = prints.groupBy("_fp").agg(F.min("_id").alias("_low"))
    reps = stored(folded.withColumn("_node", F.monotonically_increasing_id()), "distinct-fingerprints")
    roots = components(near_links(reps.select("_node", "_fp"), words, radius, segments, coarse, tile))
    placed = reps.join(roots.withColumnRenamed("node", "_node"), "_node", "left").select("_fp", "_low", F.coalesce("root", "_node").alias("_root"))
    lows = placed.groupBy("_root").agg(F.min("_low").alias("component_id"))
    of_print = stored(placed.join(lows, "_root").select("_fp", "component_id"), "print-components")
    return prints.join(of_print, "_fp").select(F.col("_id").alias(id), "_fp", "component_id")


def hex_fingerprint(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
