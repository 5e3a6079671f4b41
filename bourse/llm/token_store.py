"""Token ids in compressed files with access to single documents.

Documents are put in order of their ids by a range shuffle; each task encodes its range and packs it. A pack is one row
of a Parquet folder (Spark's committer keeps files of failed or repeated tasks out, on any file system): one zstandard
frame per document, all with one shared dictionary, and the offsets of the frames. Short documents repeat little within
themselves, so the dictionary, trained on serialised id arrays of short documents, holds what they have in common. Its
hash stands in every pack and is checked before a frame is opened.

    <folder>/dictionary  hash, content
    <folder>/packs       shard, pack, hash, width, payload; per document: ids, offsets (bytes), sizes (tokens), starts (in the shard)
    <folder>/index       per document: id, start (ids before it in the whole store), n_tokens, shard, pack, place, offset, bytes
"""

import gc
import hashlib
import itertools
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = 700_000  # chunks that a task remembers; then it starts anew
GULP = 1 << 22  # characters of whole texts that are cut into chunks at a time
SHARD = 1 << 25  # bytes of text that a shard holds, about: a task that sees more text meets fewer new chunks in it
PACK = 1 << 20  # bytes of ids after which a pack is closed; a longer document has a pack of its own
DICTIONARY = 1 << 16  # bytes of the dictionary at most
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 14  # documents that train the dictionary, about, and the longest text among them
LEVEL = 3
# The pattern by which the public word tokenizer cuts.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_PLAIN = re.compile("[^!-\u024f\u2010-\u2027\u2030-\u205e]").search


def is_letters_and_marks(path: str) -> bool:
    """Whether the tokenizer composes and lower-cases texts, cuts them by LETTERS, and gives the pieces' bytes to its model in the printable alphabet."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": r"\s+"}:
        return False
    return [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[0]["pattern"] == {"Regex": LETTERS} and not (cuts[1]["use_regex"] or cuts[1]["add_prefix_space"])


class Remembered(dict):
    """A table that asks `make` for what it lacks, and keeps the answer."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so that what stands between spaces encodes alone; each such chunk once while remembered.

    Of a tokenizer as `is_letters_and_marks` says, plain chunks are cut as it cuts them and each piece goes to its model
    once; other chunks, and those with an added token, go through the library's whole encoder. Plain are printable
    characters below U+0250 and general punctuation: they are in composed form and their classes are settled.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.octets = [i.to_bytes(self.width, "little") for i in range(self.whole.get_vocab_size())]
        self.find = regex.compile(LETTERS).findall
        self.plain = is_letters_and_marks(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from U+0100 on
        self.alphabet = {x: x for x in shown} | {x: 256 + k for k, x in enumerate(sorted(set(range(256)) - set(shown)))}
        self.forget()

    def forget(self) -> None:
        self.chunks, self.pieces = Remembered(self.chunk), Remembered(self.piece)
        self.chunks[""] = b""

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def chunk(self, c: str) -> bytes:
        if not self.plain or not c.isprintable() or NOT_PLAIN(c) or any(a in c for a in self.added):
            return self.packed(self.whole.encode(c, add_special_tokens=False).ids)
        lowered = c.lower()
        if lowered.isalpha():
            return self.pieces[lowered]
        if lowered[:-1].isalpha() and lowered[-1] in ".,;:!?":
            return self.pieces[lowered[:-1]] + self.pieces[lowered[-1]]
        return b"".join([self.pieces[p] for p in self.find(lowered)])

    def piece(self, p: str) -> bytes:
        shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.octets[t.id] for t in self.whole.model.tokenize(shown)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The serialised ids of each text; no text gives none."""
        if len(self.chunks) > KEPT:
            self.forget()
        found = self.chunks.__getitem__
        return [b"".join(map(found, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


def gulps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts in lists of about GULP characters; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= GULP:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _dictionary(content: bytes | None):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def train_dictionary(docs: DataFrame, rows: int, tokenizer: str, end: int, id: str, text: str) -> bytes:
    """The dictionary's content, trained in one task on a bounded sample: about SAMPLE_DOCS rows picked by a hash of their id, none over SAMPLE_BYTES.

    It steers how small frames get, never what they hold. Where the sample is too small to train on, its own last
    bytes serve; an empty sample gives an empty dictionary, and frames are then written without one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = WordEncoder(tokenizer)
        last = encoder.packed([end])
        samples = [b + last for _, texts in gulps(batches) for b in encoder.encode(texts)]
        try:
            content = zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            content = b"".join(samples)[-DICTIONARY:]
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

    picked = docs.where((F.pmod(F.xxhash64(quoted(id).cast("string")), F.lit(max(1, rows))) < SAMPLE_DOCS) & (F.octet_length(body(text)) <= SAMPLE_BYTES)).limit(2 * SAMPLE_DOCS)
    made = picked.select(quoted(id).alias("_id"), body(text).alias("_text")).coalesce(1).mapInArrow(task, "content binary").collect()
    return max((bytes(r.content) for r in made), key=len, default=b"")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append `end` to each, and write the store in ascending order of `id` (null first, rows of equal id by text).

    Null and empty texts hold the end id alone. Repeated rows are each stored. Other columns are not read. An empty
    table gives a store without packs.
    """
    spark = docs.sparkSession
    facts = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(body(text))), F.lit(0)).alias("size")).first()
    content = train_dictionary(docs, facts["rows"], tokenizer, end, id, text)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    kind = docs.schema[id].dataType.simpleString()
    held = spark.sparkContext.broadcast(content)
    schema = f"shard int, pack int, hash string, width int, ids array<{kind}>, offsets array<bigint>, sizes array<bigint>, starts array<bigint>, payload binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        gc.disable()  # the tables hold no cycles, and walking them again and again is dear; the task's process is its own
        encoder = WordEncoder(tokenizer)
        last = encoder.packed([end])
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(held.value)).compress
        shard, pack, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, raw = [], [], [], 0

        def closed():
            nonlocal pack, before, ids, sizes, frames, raw
            offsets = [0, *itertools.accumulate(map(len, frames))]
            starts = [before, *itertools.accumulate(sizes, initial=before)][1:-1] if sizes else []
            row = {"shard": shard, "pack": pack, "hash": digest, "width": encoder.width, "ids": ids, "offsets": offsets, "sizes": sizes, "starts": starts, "payload": b"".join(frames)}
            before, pack = before + sum(sizes), pack + 1
            ids, sizes, frames, raw = [], [], [], 0
            return row

        for some, texts in gulps(batches):
            for i, data in zip(some, encoder.encode(texts), strict=True):
                data += last
                ids.append(i)
                sizes.append(len(data) // encoder.width)
                frames.append(press(data))
                raw += len(data)
                if raw >= PACK:
                    yield pa.RecordBatch.from_pylist([closed()], schema=arrow)
        if ids:
            yield pa.RecordBatch.from_pylist([closed()], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ordered = docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")).repartitionByRange(1 + facts["size"] // SHARD, "_id").sortWithinPartitions("_id", "_text")
    ordered.mapInArrow(task, schema).write.parquet(f"{folder}/packs")

    packs = spark.read.parquet(f"{folder}/packs")
    rows = packs.select("shard", "pack", F.posexplode(F.arrays_zip("ids", "sizes", "starts")).alias("place", "d"), "offsets")
    offset = F.element_at("offsets", F.col("place") + 1)
    indexed = rows.join(_bases(packs), "shard").select(
        F.col("d.ids").alias("id"), (F.col("base") + F.col("d.starts")).alias("start"), F.col("d.sizes").alias("n_tokens"), "shard", "pack", "place", offset.alias("offset"), (F.element_at("offsets", F.col("place") + 2) - offset).alias("bytes")
    )
    indexed.write.parquet(f"{folder}/index")


def _bases(packs: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before it. One row per shard meets in the running sum."""
    totals = packs.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _open(hash: str, content: bytes):
    import zstandard

    if hashlib.sha256(content).hexdigest() != hash:
        raise ValueError("the pack was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress


def read_tokens(spark: SparkSession, folder: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per stored document, from the packs: id, start, n_tokens, by choice ids (array) and ids_crc32 (of the ids as little-endian 32-bit integers)."""
    content = bytes(spark.read.parquet(f"{folder}/dictionary").first().content)
    held = spark.sparkContext.broadcast(content)
    packs = spark.read.parquet(f"{folder}/packs")
    kind = packs.schema["ids"].dataType.elementType.simpleString()
    schema = f"shard int, id {kind}, _start bigint, n_tokens bigint" + ", ids array<bigint>" * ids + ", ids_crc32 bigint" * digests

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, hash, width, names, offsets, starts, payload = (batch.column(c)[r] for c in range(7))
                unpress, data, cuts = _open(hash.as_py(), held.value), payload.as_buffer(), offsets.as_py()
                rows = [np.frombuffer(unpress(data[a:b]), "<u2" if width.as_py() == 2 else "<u4") for a, b in itertools.pairwise(cuts)]
                columns = [pa.array([shard.as_py()] * len(rows), pa.int32()), names.values, starts.values, pa.array(list(map(len, rows)), pa.int64())]
                titles = ["shard", "id", "_start", "n_tokens"]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in rows], pa.list_(pa.int64())))
                    titles.append("ids")
                if digests:
                    columns.append(pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64()))
                    titles.append("ids_crc32")
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    found = packs.select("shard", "hash", "width", "ids", "offsets", "starts", "payload").mapInArrow(task, schema)
    rest = ["n_tokens", *["ids"] * ids, *["ids_crc32"] * digests]
    return found.join(_bases(packs), "shard").select("id", (F.col("base") + F.col("_start")).alias("start"), *rest)


def read_documents(spark: SparkSession, folder: str, ids: list) -> list[tuple]:
    """(id, token ids) of the named documents: the index names the pack and the bytes, only those frames are opened."""
    content = bytes(spark.read.parquet(f"{folder}/dictionary").first().content)
    wanted = spark.read.parquet(f"{folder}/index").where(F.col("id").isin(ids))
    packs = spark.read.parquet(f"{folder}/packs").select("shard", "pack", "hash", "width", "payload")
    frame = F.expr("substring(payload, cast(offset + 1 as int), cast(bytes as int))")
    rows = wanted.join(packs, ["shard", "pack"]).orderBy("start").select("id", "hash", "width", frame.alias("frame")).collect()
    return [(r.id, np.frombuffer(_open(r.hash, content)(bytes(r.frame)), "<u2" if r.width == 2 else "<u4").tolist()) for r in rows]
