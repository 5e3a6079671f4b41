"""A log-bilinear language model, trained with noise-contrastive estimation, and its normalised scores of whole texts.

The model predicts an output from the two outputs before it: the end of a text, one of the most frequent words, or the
ending (last characters) of any other word. Within an ending a word has its smoothed share of that ending's words, so
every word has a probability and all of them, with one place for unseen words per ending, add up to one. The
predicted vector is the sum of the context's vectors, each weighted by its place; an output's score is its product with
the output's vector plus a bias. Such scores are sums of one term per context place, so the normalisers of all pairs of
contexts are one matrix product of exponentials, and no text pays for them.

Every training word is counted, and every training token is a step of the model. One task trains a start on a bounded
sample; from there tasks train on their own part of all texts, and their models are averaged, weighted by tokens. Counts
grow with the corpus and are never gathered: a bounded table of the frequent words' counts goes to the tasks, all other
words are looked up by a join.
"""

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted, stored

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FREQUENT, ENDINGS, OVERFLOW = 1023, 960, 64  # outputs besides the end: words, endings, and places for all other endings
OUTPUTS = 1 + FREQUENT + ENDINGS + OVERFLOW
TAIL = 3  # characters of an ending
WIDTH, NOISE, BATCH = 32, 64, 4096  # of the vectors; noise outputs and tokens per step
START = 4_000_000  # tokens of the bounded sample on which the common start is trained
START_RATE, RATE, SEEN = 0.1, 0.02, 30.0  # learning rates there and over all texts, and what a row's steps are damped by at first
TABLE, SPELLED = 1 << 18, 64  # most words whose counts go to all tasks, and the longest such word in bytes
KEPT = 1 << 18  # words that a task counts before it ships them
GULP = 1 << 22  # characters whose tokens are shuffled together in training
CUT = 1 << 20  # characters that are cut into words at a time
SEGMENTS = 64  # parts in which models are averaged


def words_of(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words, lengths): the lower-cased words of all texts in order, each distinct one held once, and how many each text has."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    cut = pc.ascii_split_whitespace(bare)
    lengths = np.where(pc.binary_length(bare).to_numpy() > 0, pc.list_value_length(cut).to_numpy(), 0)
    words = cut.flatten()  # an empty text gives one empty word
    return words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode(), lengths.astype(np.int64)


def gulps(batches: Iterator[pa.RecordBatch], at: int, most: int = CUT) -> Iterator[tuple[list, list[str]]]:
    """Rows' first columns and their texts (column `at`), about `most` characters at a time; a longer text stands alone."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for k, text in enumerate(batch.column(at)):
            rows.append((batch, k))
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= most:
                yield rows, texts
                rows, texts, size = [], [], 0
                pa.default_memory_pool().release_unused()
    if rows:
        yield rows, texts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all of `_text`; tasks fold what they meet first."""

    def folded(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"])
        return sums.rename_columns(["word", "c"]).to_batches(max_chunksize=1 << 16)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for _, some in gulps(batches, 0):
            words, _ = words_of(some)
            c = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held.append(pa.RecordBatch.from_arrays([words.dictionary, pa.array(c, pa.int64())], names=["word", "c"]))
            size += len(c)
            if size > 2 * KEPT:
                held = folded(held)
                size = sum(map(len, held))
                if size > KEPT:
                    yield from held
                    held, size = [], 0
        if held:
            yield from folded(held)

    return stored(texts.select("_text").mapInArrow(task, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """What all tasks know: counts of the most frequent words, the outputs, and each output's training tokens and distinct words."""

    counts: dict[bytes, int]
    frequent: dict[bytes, int]
    endings: dict[str, int]
    tokens: np.ndarray
    distinct: np.ndarray
    train_tokens: int
    train_words: int

    def output(self, word: bytes) -> int:
        found = self.frequent.get(word)
        if found is None:
            tail = word.decode()[-TAIL:]
            found = self.endings.get(tail)
            if found is None:
                found = 1 + FREQUENT + ENDINGS + zlib.crc32(tail.encode()) % OVERFLOW
        return found

    def within(self) -> np.ndarray:
        """log10 of what a word's count plus a half is divided by within its output; words with an output of their own need none."""
        out = np.zeros(OUTPUTS)
        out[1 + FREQUENT :] = np.log10(self.tokens[1 + FREQUENT :] + 0.5 * (self.distinct[1 + FREQUENT :] + 1))
        return out


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From all words' counts and the number of training texts, each of which ends once."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The count from which on words number at most TABLE: a running sum over the distinct counts, which are few.
    steps = counts.where(F.octet_length("word") <= SPELLED).groupBy("c").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = steps.withColumn("_sum", running).where(F.col("_sum") <= TABLE).agg(F.min("c")).first()[0]
    table = counts.where((F.octet_length("word") <= SPELLED) & (F.col("c") >= F.lit(least if least is not None else 1 << 62))).toArrow()
    known = {w.encode(): c for w, c in zip(table.column("word").to_pylist(), table.column("c").to_pylist(), strict=True)}
    first = sorted(known, key=lambda w: (-known[w], w))[:FREQUENT]
    frequent = {w: 1 + k for k, w in enumerate(first)}

    own = spark.createDataFrame([(w.decode(),) for w in first], "word string")
    others = counts.join(F.broadcast(own), "word", "left_anti").select(F.right("word", F.lit(TAIL)).alias("tail"), "c")
    tails = stored(others.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")), "word-endings")
    top = tails.orderBy(F.desc("c"), "tail").limit(ENDINGS).collect()
    tokens, distinct = np.zeros(OUTPUTS, np.int64), np.zeros(OUTPUTS, np.int64)
    tokens[0], distinct[0] = texts, 1
    for w, k in frequent.items():
        tokens[k], distinct[k] = known[w], 1
    endings = {r.tail: 1 + FREQUENT + k for k, r in enumerate(top)}
    for r in top:
        tokens[endings[r.tail]], distinct[endings[r.tail]] = r.c, r.v
    named = spark.createDataFrame([(r.tail,) for r in top], "tail string")
    place = F.pmod(F.crc32("tail"), F.lit(OVERFLOW)).cast("int").alias("place")
    for r in tails.join(F.broadcast(named), "tail", "left_anti").groupBy(place).agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        tokens[1 + FREQUENT + ENDINGS + r.place], distinct[1 + FREQUENT + ENDINGS + r.place] = r.c, r.v
    return Vocabulary(known, frequent, endings, tokens, distinct, int(total[0]) + texts, int(total[1]) + (texts > 0))


class Model:
    """Vectors of contexts and outputs, weights of the two context places, biases; one flat array to travel."""

    def __init__(self, flat: np.ndarray):
        cut = OUTPUTS * WIDTH
        self.flat = flat
        self.inner, self.outer = flat[:cut].reshape(OUTPUTS, WIDTH), flat[cut : 2 * cut].reshape(OUTPUTS, WIDTH)
        self.bias, self.place = flat[2 * cut : 2 * cut + OUTPUTS], flat[2 * cut + OUTPUTS :].reshape(2, WIDTH)

    @classmethod
    def start(cls, noise: np.ndarray) -> "Model":
        rng = np.random.default_rng(7)
        made = cls(rng.normal(0, 0.1, 2 * OUTPUTS * WIDTH + OUTPUTS + 2 * WIDTH).astype(np.float32))
        made.bias[:] = np.log(noise)
        made.place[:] = [[1.0], [0.5]]
        return made

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, z): ln P(output t after x, and y before x) = a[x, t] + b[y, t] - z[x, y]. Sums over all outputs are products of matrices."""
        a, b = self.terms()
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        a -= top_a
        b -= top_b
        z = np.exp(a, out=a) @ np.exp(b, out=b).T
        del a, b  # each table takes 16 MB in every worker: no copies
        z += np.float32(1e-30)
        np.log(z, out=z)
        z += top_a
        z += top_b.T
        return *self.terms(), z

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        a = (self.inner * self.place[0]) @ self.outer.T
        a += self.bias
        return a, (self.inner * self.place[1]) @ self.outer.T


def noise_of(v: Vocabulary) -> np.ndarray:
    """Noise: each output as often as in the training tokens, none impossible."""
    mass = v.tokens + 0.5
    return mass / mass.sum()


def _climb(rows: np.ndarray, seen: np.ndarray, summed: np.ndarray, rate: float) -> None:
    """Add each row's summed steps (zeros move nothing), scaled by what the row has moved before (one scale per row)."""
    seen += np.einsum("ij,ij->i", summed, summed) / WIDTH
    rows += summed * (rate / np.sqrt(seen + 1e-6))[:, None]


class Trainer:
    """Noise-contrastive steps: tell each true output from NOISE others drawn for the whole batch."""

    def __init__(self, model: Model, noise: np.ndarray, rate: float, seed: int):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.upto = np.cumsum(noise)
        self.odds = np.log(NOISE * noise).astype(np.float32)
        self.seen = [np.full(OUTPUTS, SEEN, np.float32) for _ in range(3)] + [np.full(2, SEEN, np.float32)]
        self.places = np.arange(OUTPUTS * WIDTH).reshape(OUTPUTS, WIDTH)

    def summed(self, ids: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The sums of the steps of each output, in one pass without a sort."""
        return np.bincount(self.places.take(ids, axis=0).ravel(), steps.ravel(), OUTPUTS * WIDTH).astype(np.float32).reshape(OUTPUTS, WIDTH)

    def steps(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        order = self.rng.permutation(len(t))
        for k in range(0, len(t), BATCH):
            some = order[k : k + BATCH]
            self.step(x[some], y[some], t[some])

    def step(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        m = self.model
        n = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), OUTPUTS - 1)
        rx, ry, qt, qn = (rows.take(ids, axis=0) for rows, ids in ((m.inner, x), (m.inner, y), (m.outer, t), (m.outer, n)))
        p = rx * m.place[0] + ry * m.place[1]
        true = 1 / (1 + np.exp(np.einsum("ij,ij->i", p, qt) + m.bias[t] - self.odds[t]))  # how far from certain
        false = p @ qn.T
        np.subtract(self.odds[n] - m.bias[n], false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(-1, false, out=false)
        up = true[:, None] * qt
        up += false @ qn
        _climb(m.outer, self.seen[0], self.summed(np.concatenate([t, n]), np.concatenate([true[:, None] * p, false.T @ p])), self.rate)
        wide = up.astype(np.float64)
        _climb(m.inner, self.seen[1], self.summed(x, wide) * m.place[0] + self.summed(y, wide) * m.place[1], self.rate)
        pull = np.bincount(t, true, OUTPUTS) + np.bincount(n, np.ones(len(t), np.float32) @ false, OUTPUTS)
        self.seen[2] += (pull * pull).astype(np.float32)
        m.bias += (self.rate * pull / np.sqrt(self.seen[2])).astype(np.float32)
        for k, r in enumerate((rx, ry)):
            turn = np.einsum("ij,ij->j", up, r)
            self.seen[3][k] += (turn * turn).mean()
            m.place[k] += self.rate * turn / np.sqrt(self.seen[3][k])


class Encoder:
    """Outputs of the words of many texts; distinct words and endings are looked up once for all their places."""

    def __init__(self, v: Vocabulary):
        self.frequent, self.endings = pa.array([w.decode() for w in v.frequent], pa.string()), pa.array(list(v.endings), pa.string())
        self.own, self.ended = np.fromiter(v.frequent.values(), np.int64), np.fromiter(v.endings.values(), np.int64)

    def outputs(self, words: pa.Array) -> np.ndarray:
        """As `Vocabulary.output` has it, word by word."""
        found = pc.fill_null(pc.index_in(words, self.frequent), -1).to_numpy()
        out = np.zeros(len(words), np.int64)
        out[found >= 0] = self.own[found[found >= 0]]
        tails = pc.utf8_slice_codeunits(words.filter(pa.array(found < 0)), -TAIL).dictionary_encode()
        ending = pc.fill_null(pc.index_in(tails.dictionary, self.endings), -1).to_numpy()
        places = np.zeros(len(ending), np.int64)
        places[ending >= 0] = self.ended[ending[ending >= 0]]
        rest = tails.dictionary.filter(pa.array(ending < 0)).cast(pa.binary()).to_pylist()
        places[ending < 0] = [1 + FREQUENT + ENDINGS + zlib.crc32(tail) % OVERFLOW for tail in rest]
        out[found < 0] = places[tails.indices.to_numpy()]
        return out

    def stream(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """(words, tokens, ends): the outputs of all texts, each after an end and with its own end; ends[k] is where text k ends. The stream begins with two ends."""
        words, lengths = words_of(texts)
        ends = np.cumsum(lengths + 1) + 1
        tokens = np.zeros(2 + len(words) + len(texts), np.int64)
        inside = np.ones(len(tokens), bool)
        inside[:2] = False
        inside[ends] = False
        tokens[inside] = self.outputs(words.dictionary)[words.indices.to_numpy()]
        return words, tokens, ends

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) as in `stream`, for many texts: the words of about CUT characters are held at a time."""
        parts, ends, at = [np.zeros(2, np.int64)], [], 0
        first, size = 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= CUT or k == len(texts):
                _, some, stops = self.stream(texts[first:k])
                parts.append(some[2:])
                ends.append(stops + at)
                at, first, size = at + len(some) - 2, k, 0
        return np.concatenate(parts), np.concatenate(ends)


def contexts(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, t): the output before, the one before that, and the output; before a text's first word stand two ends."""
    x, y, t = tokens[1:-1], tokens[:-2].copy(), tokens[2:]
    y[np.append(0, ends[:-1] - 1)] = 0  # where texts begin
    return x, y, t


def _models(texts: DataFrame, v: Vocabulary, start: np.ndarray, rate: float, most: int | None = None) -> DataFrame:
    """(_segment, _part, _weight, _values): the model of each task after its texts, or after about `most` tokens, in segments, and its tokens."""
    held = texts.sparkSession.sparkContext.broadcast((replace(v, counts={}), start))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = held.value
        part = TaskContext.get().partitionId()
        encoder, own, weight = Encoder(v), Model(start.copy()), 0
        trainer = Trainer(own, noise_of(v), rate, part)
        for _, some in gulps(batches, 0, GULP):
            tokens, ends = encoder.tokens(some)
            trainer.steps(*contexts(tokens, ends))
            weight += len(tokens) - 2
            if most is not None and weight >= most:
                break
        if weight:
            values = [s.astype("<f4").tobytes() for s in np.array_split(own.flat, SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([part] * SEGMENTS, pa.int32()), pa.array([float(weight)] * SEGMENTS), pa.array(values, pa.binary())], names=["_segment", "_part", "_weight", "_values"])

    return texts.select("_text").mapInArrow(task, "_segment int, _part int, _weight double, _values binary")


def averaged(models: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """The mean of the models by weight, segment by segment; `otherwise` where there is none."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # at most SEGMENTS
        for batch in batches:
            for s, w, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sums.setdefault(s, [0.0, 0.0])
                found[0] += w
                found[1] = found[1] + w * np.frombuffer(b, "<f4").astype(np.float64)
        for s, (w, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(x / w).astype("<f4").tobytes()], pa.binary())], names=["_segment", "_values"])

    dealt = models.repartition(SEGMENTS, "_segment").sortWithinPartitions("_segment", "_part")
    found = {r._segment: np.frombuffer(bytes(r._values), "<f4") for r in dealt.select("_segment", "_weight", "_values").mapInArrow(mean, "_segment int, _values binary").collect()}
    return np.concatenate([found[s] for s in range(SEGMENTS)]) if found else otherwise


def trained(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """The model's flat array: a start from a sample by a hash of ids, about START tokens, then one pass over all texts."""
    model = Model.start(noise_of(v)).flat
    share = min(1.0, START / max(1, v.train_tokens))
    sample = texts.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    model = averaged(_models(sample.coalesce(1), v, model, START_RATE, START), model)
    return averaged(_models(texts, v, model, RATE), model)


def _partial_scores(texts: DataFrame, v: Vocabulary, model: np.ndarray) -> DataFrame:
    """Per row: tokens, known ones, sums over what tasks know, and the other words with their counts in the text."""
    # The words' counts travel as columns: as a dictionary they take many times that in every worker.
    counted = pa.array([w.decode() for w in v.counts], pa.string()), np.append(np.fromiter(v.counts.values(), np.int64), 0)
    held = texts.sparkSession.sparkContext.broadcast((replace(v, counts={}), counted, model))
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("_id", "_held"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (counted, times), flat = held.value
        encoder = Encoder(v)
        a, b, z = Model(flat).scores()
        within = v.within()
        end = np.log10(v.tokens[0] + 0.5)
        for rows, some in gulps(batches, 2):
            words, tokens, ends = encoder.stream(some)
            x, y, t = contexts(tokens, ends)
            score = (a.take(x * OUTPUTS + t).astype(np.float64) + b.take(y * OUTPUTS + t) - z.take(x * OUTPUTS + y)) / np.log(10) - within[t]
            vocab = words.dictionary
            ids = np.full(len(t), -1)
            is_word = np.ones(len(t), bool)
            is_word[ends - 2] = False
            ids[is_word] = words.indices.to_numpy()
            c = times[pc.fill_null(pc.index_in(vocab, counted), len(counted)).to_numpy()]
            logs = np.append(np.where(c > 0, np.log10(c + 0.5), 0.0), end)  # the last place is the end's
            known = np.append(c > 0, v.tokens[0] > 0)
            starts = np.append(0, ends[:-1] - 1)
            sums = [np.add.reduceat(s, starts) for s in (known[ids].astype(np.int64), logs[ids], score + np.where(t > FREQUENT, logs[ids], 0.0))]
            text = np.repeat(np.arange(len(ends)), np.diff(np.append(starts, len(t))))
            other = np.flatnonzero(is_word & ~known[ids])
            pairs, n = np.unique(text[other] * (len(vocab) + 1) + ids[other], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(ends) + 1) * (len(vocab) + 1))
            named = vocab.take(pa.array(pairs % (len(vocab) + 1)))
            others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([named, pa.array(n, pa.int64())], names=["word", "n"]))
            given = [pa.concat_arrays([batch.column(k).slice(r, 1) for batch, r in rows]) for k in (0, 1)]
            columns = [*given, pa.array(np.diff(np.append(starts, len(t)))), *[pa.array(s) for s in sums], others]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_held", "n_tokens", "_known", "_base", "_score", "_others"])

    return texts.select("_id", "_held", "_text").mapInArrow(task, f"{kinds}, n_tokens bigint, _known bigint, _base double, _score double, _others array<struct<word:string,n:bigint>>")


def lm_scores(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: `id`, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the words of the lower-cased (A-Z) text, then one end; null texts are empty. The model learns from the
    rows for which held_out is not true. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over all tokens, c being
    a token's count among the training tokens, N their number, V the distinct ones; n_known are tokens with c > 0. score
    is the model's, normalised over all words and one unseen word per ending. Without training rows both rest on the
    halves alone. Repeated rows each count and get a row. Other columns are not read. Empty in, empty out.
    """
    held = F.coalesce(held_out, F.lit(False))
    texts = docs.select(quoted(id).alias("_id"), held.alias("_held"), body(text).alias("_text"))
    training = texts.where(~F.col("_held"))
    counts = word_counts(training)
    v = vocabulary(counts, training.count())
    scored = stored(_partial_scores(texts, v, trained(training, v)).withColumn("_row", F.monotonically_increasing_id()), "partial-scores")

    # Words outside the table are rare in the training texts, and unseen ones can't be frequent, as rows are held out by chance.
    others = scored.select("_row", F.explode("_others").alias("_o")).select("_row", "_o.word", "_o.n")
    logs = others.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("_more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("_logs")
    )
    whole = float(np.log10(v.train_tokens + 0.5 * (v.train_words + 1)))
    extra = F.coalesce("_logs", F.lit(0.0))
    return scored.join(logs, "_row", "left").select(
        F.col("_id").alias(id), F.col("_held").alias("held_out"), "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + extra - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("_score") + extra).alias("score"),
    )
