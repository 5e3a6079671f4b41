"""Codes for vectors: a codebook per part, nearest entries found exactly in the Walsh-Hadamard domain.

Components become integers, vectors are cut into equal parts. The transform of a part, padded with zeros to a power of
two, keeps squared distances up to the factor of its length, and gathers most of a difference in few coefficients. So
differences are summed coefficient by coefficient in order of sequency (changes of sign of the basis): each partial sum
bounds the whole from below, and entries whose sum passes the whole of a likely one are out. All arithmetic is on
integers. Vectors stay where they lie; a task folds its share into one sum per part and entry, and only those travel.
"""

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import quoted, stored

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 80  # components beyond this are held there
LARGEST = (1 << 63) - 1  # errors beyond this are held there
ROWS = 1 << 12  # vectors that are compared at a time
SALTS = 16  # keys over which rows of one label are dealt while its sum is looked up


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; machine integers where they hold it, else Python's."""
    wide = flat.astype(np.float64)
    if len(flat) == 0 or np.abs(wide).max() < 2.0**40:
        return np.floor(wide * scale).astype(np.int64)  # a power of two moves no digit
    whole = [max(-HELD, min(HELD, math.floor(scale * x) if abs(x) < 2.0**40 else scale * int(x))) for x in wide.tolist()]
    return np.array(whole, object)


def walsh_rows(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows in order of sequency."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Sequency-ordered coefficients of the last axis, padded with zeros to a power of two."""
    width = parts.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    return parts @ walsh_rows(size)[:, :width].T.astype(parts.dtype)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, the first of equals. Integers only."""
    size = 1 << max(0, parts.shape[1] - 1).bit_length()
    most = max((int(np.abs(x).max()) for x in (parts, entries) if x.size), default=0)
    if 4 * size**3 * most * most >= 1 << 56:  # sums could pass 64 bits
        parts, entries = parts.astype(object), entries.astype(object)
    a, b = transformed(parts), transformed(entries)
    rows = np.arange(len(a))
    sums = (a[:, :1] - b[None, :, 0]) ** 2
    likely = np.argmin(sums, axis=1)
    bound = ((a - b[likely]) ** 2).sum(axis=1)  # the whole of the likeliest
    r, e = np.nonzero(sums <= bound[:, None])
    left = sums[r, e]
    for c in range(1, size):
        left = left + (a[r, c] - b[e, c]) ** 2
        stay = left <= bound[r]
        r, e, left = r[stay], e[stay], left[stay]
    order = np.lexsort((e, left, r)) if left.dtype != object else np.array(sorted(range(len(r)), key=lambda k: (r[k], left[k], e[k])), int)
    at = order[np.searchsorted(r[order], rows)]
    return e[at], left[at] // size


def codes_and_errors(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and part: the nearest entry and its squared distance."""
    width = vectors.shape[1] // len(books)
    found = [nearest(vectors[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1].astype(object) if any(g[1].dtype == object for g in found) else f[1] for f in found], 1)


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat, scale).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def sound(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def refined(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry becomes the floor of its parts' mean; unused ones stay."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        width, many = books[0].shape[1], len(books[0])
        total = np.zeros((len(books), many, width), object)
        count = np.zeros((len(books), many), np.int64)
        for batch in _blocks(batches):
            vectors = _matrix(batch.column(0), scale)
            codes = codes_and_errors(vectors, books)[0]
            small = vectors.dtype != object and np.abs(vectors).max() < 1 << 40
            for p in range(len(books)):
                parts = vectors[:, p * width : (p + 1) * width]
                own = np.zeros((many, width), np.int64 if small else object)
                np.add.at(own, codes[:, p], parts)
                total[p] += own
                count[p] += np.bincount(codes[:, p], minlength=many)
        p, e = np.nonzero(count)
        values = [[str(x) for x in total[i, j]] for i, j in zip(p, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(values, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    width = books[0].shape[1]
    shares = rows.select("_vector").mapInArrow(sums, "part int, entry int, n bigint, sums array<string>")
    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(width)]
    new = [book.copy() for book in books]
    for row in shares.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts times entries rows
        mean = [int(row[f"s{k}"]) // row.n for k in range(width)]
        if max(map(abs, mean)) >= 1 << 62:
            new[row.part] = new[row.part].astype(object)
        new[row.part][row.entry] = mean
    return new


def train_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """A codebook per part, from the first vectors of rows (_id, _vector) in order of id (null last), then of components."""
    seeds = rows.orderBy(F.asc_nulls_last("_id"), "_vector").limit(entries).collect()
    if not seeds:
        return []
    flat = integers(np.array([x for s in seeds for x in s._vector], np.float64), scale).reshape(len(seeds), -1)
    if flat.shape[1] % parts:
        raise ValueError(f"{flat.shape[1]} components can't be cut into {parts} equal parts")
    books = np.split(flat, parts, axis=1)
    for _ in range(rounds):
        books = refined(rows, books, scale)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row per kept row: `id`, code (two hex digits per part), error, label_error, codebooks_sha256.

    Rows are dropped whose vector is null, empty, or holds null, NaN or infinite components. Vectors have one length, a
    multiple of `parts`. error is the squared distance of the integer vector to its entries, label_error its sum over
    rows of the same label (nulls together), the digest that of all final entries as decimal numbers. Fewer rows than
    `entries` give shorter codebooks. Integers beyond HELD and errors beyond LARGEST are held there; else all is exact.
    Repeated ids and rows each get a row. Other columns are not passed on. Empty in, empty out.
    """
    if entries > 256 or scale & (scale - 1):
        raise ValueError("two hex digits name 256 entries, and the scale is a power of two")
    rows = table.where(sound(quoted(vector))).select(quoted(id).alias("_id"), quoted(label).alias("_label"), quoted(vector).alias("_vector"))
    books = train_codebooks(rows.select("_id", "_vector"), parts, entries, rounds, scale)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            codes, errors = codes_and_errors(_matrix(batch.column(2), scale), held.value)
            digits = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            code = [digits[k : k + step] for k in range(0, len(digits), step)]
            error = [min(LARGEST, int(x)) for x in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error, pa.int64())], names=["_id", "_label", "code", "error"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_id", "_label")]
    coded = stored(rows.mapInArrow(task, ", ".join([*kinds, "code string", "error bigint"])), "vector-codes")
    # A label may hold a third of all rows: its sum is looked up under salted keys.
    held_sum = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(held_sum.alias("label_error")).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, dealt["_label"].eqNullSafe(sums["_of"]) & (dealt["_salt"] == sums["_deal"]))
    return joined.select(F.col("_id").alias(id), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
