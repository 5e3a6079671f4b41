"""SentencePiece BPE encoding with a table of every prefix's last token, and decoding.

The encoding of a prefix ends in one token that is determined by the prefix alone. A token that ends there, found by an
Aho-Corasick automaton over all pieces, is that one if it is compatible with the last token of what stands before it:
merging their characters together must leave the two as they are. Reading the table backwards gives the ids, in time
proportional to the text, however long it is without a space.

Pieces hold the mark of a space only at their start, so a text falls into chunks that no merge crosses, and a task
encodes each different chunk once while its table of chunks lasts.
"""

import gc
import hashlib
import itertools
import re
import sys
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from bourse.llm.shared import quoted

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"  # stands for a space
KEPT = 600_000  # chunks that a task remembers; then it starts anew
GULP = 1 << 22  # characters of whole texts that are cut into chunks at a time
LEAST = float("-inf")


def read_model(path: str) -> dict:
    """What the encoder needs of a model: pieces, scores, each piece's last merge, byte ids, the end id. Its size is the vocabulary's.

    A higher score merges first. Models whose pieces are not made of pieces with higher scores, that mark spaces within
    a piece, or that lack byte pieces are refused, as the tables would not hold for them.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): i for i in normal}
    score = {i: sp.get_score(i) for i in normal}
    octets = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(sp.is_byte, octets)):
        raise ValueError("the model has no byte pieces")
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds the mark of a space after other characters")
    halves = {i: split for piece, i in pieces.items() if len(piece) > 1 and (split := last_merge(piece, pieces, score))}
    if any(h in halves and score[h] < score[i] for i, split in halves.items() for h in split):
        raise ValueError("a piece merges before its parts")
    return {"pieces": pieces, "score": score, "halves": halves, "bytes": octets, "end": sp.eos_id()}


def last_merge(piece: str, pieces: dict[str, int], score: dict[int, float]) -> tuple[int, int] | None:
    """The two tokens whose merge completes the piece when its characters are merged by score, leftmost first; None if they never do."""
    parts = list(piece)
    while len(parts) > 2:
        made = [(score[i], -k) for k in range(len(parts) - 1) if (i := pieces.get(parts[k] + parts[k + 1])) is not None]
        if not made:
            return None
        k = -max(made)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    a, b = (pieces.get(p) for p in parts)
    return None if a is None or b is None else (a, b)


class PieceTable:
    """Encodes chunks; the table of one chunk's prefixes serves the next chunk as far as both begin alike."""

    def __init__(self, model: dict):
        self.pieces, self.score, self.halves, self.bytes = model["pieces"], model["score"], model["halves"], model["bytes"]
        self.name = {i: p for p, i in self.pieces.items()}
        self.made = {p: i for p, i in self.pieces.items() if len(p) == 1 or i in self.halves}  # tokens that merges can give
        self.prefixes = {p[:k] for p in self.made for k in range(1, len(p) + 1)}
        self.states = {"": 0}  # the automaton: a state is the longest end of what was read that begins a piece
        self.text_of = [""]
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}  # state and character: next state, pieces that end there, longest first
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.chunk, self.at, self.last, self.size = "", [0], [0], [0]

    def step(self, state: int, ch: str) -> tuple[int, tuple[tuple[int, int], ...]]:
        read = self.text_of[state] + ch
        while read and read not in self.prefixes:
            read = read[1:]
        to = self.states.setdefault(read, len(self.text_of))
        if to == len(self.text_of):
            self.text_of.append(read)
        ends = tuple((len(read) - k, self.made[read[k:]]) for k in range(len(read)) if read[k:] in self.made)
        found = self.steps[state << 21 | ord(ch)] = (to, ends)
        return found

    def spine(self, token: int, side: int) -> list[tuple[str, float]]:
        """From the character at the border (the right end of side 0, the left of 1) up to the token: each part, and the score of the merge that takes it."""
        found = self.spines[side].get(token)
        if found is None:
            found, i, up = [], token, LEAST
            while True:
                found.append((self.name[i], up))
                if i not in self.halves:
                    break
                up, i = self.score[i], self.halves[i][1 - side]
            found.reverse()
            self.spines[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens gives the two again.

        From the two characters at the border, their tokens grow by the merges that made them, the earlier merge
        first; at no time may the tokens that then meet at the border have a merge that comes before both next ones.
        Of equal merges the one further left comes first.
        """
        lefts, rights, pieces, score = self.spine(left, 0), self.spine(right, 1), self.pieces, self.score
        i = j = 0
        fine = True
        while True:
            (a, up), (b, over) = lefts[i], rights[j]
            across = pieces.get(a + b)
            if across is not None and (s := score[across]) > up and s >= over:
                fine = False
                break
            if up == over == LEAST:
                break
            if up >= over:
                i += 1
            else:
                j += 1
        self.pairs[left << 20 | right] = fine
        return fine

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk in which spaces are already marks."""
        at, last, size, pairs, steps, n = self.at, self.last, self.size, self.pairs, self.steps, len(chunk)
        same, most = 0, min(n, len(self.chunk))
        while same < most and chunk[same] == self.chunk[same]:
            same += 1
        del at[same + 1 :], last[same + 1 :], size[same + 1 :]
        state = at[same]
        for end in range(same + 1, n + 1):
            ch = chunk[end - 1]
            state, ends = steps.get(state << 21 | ord(ch)) or self.step(state, ch)
            for length, i in ends:
                start = end - length
                if start == 0 or (before := last[start]) < 0:
                    break
                fine = pairs.get(before << 20 | i)
                if fine or (fine is None and self.compatible(before, i)):
                    break
            else:
                length, i = 1, -1  # a character that no piece has
            at.append(state)
            last.append(i)
            size.append(length)
        self.chunk = chunk
        out, end = [], n
        while end:
            if last[end] < 0:
                out += [self.bytes[b] for b in reversed(chunk[end - 1].encode())]
            else:
                out.append(last[end])
            end -= size[end]
        return tuple(out[::-1])


class Encoder:
    """Encodes whole texts, remembering chunks."""

    def __init__(self, model: dict):
        self.table, self.end = PieceTable(model), model["end"]
        self.ids: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """Chunks of the text, without the one mark that each starts with; none of no text."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text with the end id; no text gives the end id alone."""
        cut = [self.chunks(t) for t in texts]
        if len(self.ids) > KEPT:
            self.ids = {}
        new = set().union(*cut).difference(self.ids)
        for c in sorted(new):  # in order, so that neighbours begin alike
            self.ids[c] = self.table.encode_chunk(MARK + c)
        for chunks in cut:
            ids = list(chain.from_iterable(map(self.ids.__getitem__, chunks)))
            ids.append(self.end)
            yield ids


def gulps(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of about GULP characters; a longer text stands alone."""
    some: list[str | None] = []
    size = 0
    for t in column:
        text = t.as_py()
        some.append(text)
        size += len(text or "")
        if size >= GULP:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_pieces(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per input row: `id`, n_tokens, and by choice ids, ids_sha256 and decoded_sha256.

    Whole texts are encoded as the model's own library does without sampling, with an end id only; null and empty texts
    give the end id alone. ids_sha256 is of the decimal ids joined by a space; decoded_sha256 of the library's decoding
    of the ids. Repeated rows are each encoded; other columns are not passed on. Empty in, empty out.
    """

    held = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        gc.disable()  # the tables hold no cycles, and walking them again and again is dear; the task's process is its own
        encoder = Encoder(held.value)
        decode = sentencepiece.SentencePieceProcessor(model_file=model).decode
        names = list(map(str, range(1 + max(max(held.value["score"]), *held.value["bytes"]))))
        for batch in batches:
            at = 0
            for texts in gulps(batch.column(1)):
                counts, rows, shas, back = [], [], [], []
                for found in encoder.encode(texts):
                    counts.append(len(found))
                    if ids:
                        rows.append(pa.array(found, pa.int32()))
                    if digests:
                        shas.append(hashlib.sha256(" ".join(map(names.__getitem__, found)).encode()).hexdigest())
                        back.append(hashlib.sha256(decode(found).encode()).hexdigest())
                columns, titles = [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64())], ["_id", "n_tokens"]
                at += len(texts)
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), pa.concat_arrays(rows)))
                    titles.append("ids")
                if digests:
                    columns += [pa.array(shas, pa.string()), pa.array(back, pa.string())]
                    titles += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"_id {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")).mapInArrow(task, schema).withColumnRenamed("_id", id)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """encoded with a column `text`, decoded from its ids by the model's library; null ids give null. A column of that name is replaced."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        return pa.array([None if r is None else sp.decode(r) for r in rows.to_pylist()], pa.string())

    return encoded.select(*[quoted(c) for c in encoded.columns if c.lower() != "text"], decoded(quoted(ids)).alias("text"))
