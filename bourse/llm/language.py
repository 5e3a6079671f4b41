"""Language identification by multilingual mixtures.

A language is a distribution over hashed letter trigrams, counted over all training documents. A document is a mixture
of languages: expectation-maximisation estimates the proportions from the likelihoods of its trigrams, and the set of
languages is the one of highest likelihood after a penalty per proportion (half the logarithm of the trigrams each).
The prediction is the language of the largest proportion in that set.

The likelihood is concave in the proportions, so the expectation step bounds what any mixture can still gain. Where
that is less than the penalty of a second language, the best single language is the answer without further fits.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import quoted

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16  # the model's size is at most this times the number of languages
GULP = 1 << 21  # characters of whole texts that are counted at a time
STEPS = 16  # expectation-maximisation steps of a fit
PRIOR = 0.1  # added to each count


def letters_table() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def trigrams(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of each letter but the first and last character: its trigram with its neighbours, others than letters being one sign."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    is_letter = np.zeros(len(points), bool)
    low = points < (1 << 16)
    is_letter[low] = letter[points[low]]
    for c in np.unique(points[~low]):
        is_letter[points == c] = chr(int(c)).isalpha()
    points = np.where(is_letter, points, np.uint32(32))
    at = np.flatnonzero(is_letter[1:-1]) + 1
    h = points[at - 1] * np.uint32(0x9E3779B1) + points[at] * np.uint32(0x85EBCA77) + points[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return at, (h >> np.uint32(16)).astype(np.int64)


def trigram_counts(texts: list[str | None], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the lower-cased texts, in order; a single long text is counted slice by slice."""
    lowered = [(t or "").lower() for t in texts]
    if len(texts) == 1:
        whole, sums = f"\n{lowered[0]}\n", np.zeros(BUCKETS, np.int64)
        for k in range(1, len(whole) - 1, GULP):
            sums += np.bincount(trigrams(whole[k - 1 : k + GULP + 1], letter)[1], minlength=BUCKETS)
        bucket = np.flatnonzero(sums)
        return np.zeros(len(bucket), np.int64), bucket, sums[bucket]
    at, bucket = trigrams("\n" + "\n".join(lowered) + "\n", letter)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    keys, n = np.unique(np.searchsorted(ends, at - 1, side="right") * BUCKETS + bucket, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, n


def gulps(*columns: pa.Array, most: int = GULP) -> Iterator[list[tuple]]:
    """Rows of a batch in lists of at most about `most` characters of the first column; a longer text stands alone."""
    rows: list[tuple] = []
    size = 0
    for values in zip(*columns, strict=True):
        row = tuple(v.as_py() for v in values)
        length = len(row[0] or "")
        if rows and size + length > most:
            yield rows
            rows, size = [], 0
        rows.append(row)
        size += length
    if rows:
        yield rows


def train(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-ready probabilities of shape languages x BUCKETS) from all rows whose lang is not null.

    Tasks add up their counts before they are shuffled; the driver gets at most languages x BUCKETS sums.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, sums = letters_table(), {}
        for batch in batches:
            for rows in gulps(batch.column(0), batch.column(1)):
                doc, bucket, n = trigram_counts([r[0] for r in rows], letter)
                names = sorted({r[1] for r in rows})
                code = np.array([names.index(r[1]) for r in rows])
                counts = np.bincount(code[doc] * BUCKETS + bucket, n, len(names) * BUCKETS).astype(np.int64).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums[name] + counts[k] if name in sums else counts[k]
        for name, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"])

    rows = docs.where(quoted(lang).isNotNull()).select(quoted(text).alias("_text"), quoted(lang).alias("_lang"))
    sums = rows.mapInArrow(task, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    place = {n: k for k, n in enumerate(names)}
    counts = np.full((len(names), BUCKETS), PRIOR)
    if names:
        codes = np.array([place[n] for n in sums.column("lang").to_pylist()])
        counts[codes, sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    return names, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0, dtype=np.float64)


def fit(p: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log likelihood and the most that any allowed proportions can add to it, per document.

    p: likelihoods of each trigram (rows) in each language; n: its count; starts: the first row of each document;
    allowed: which languages a document may hold.
    """
    lengths = np.diff(np.append(starts, len(n)))
    totals = _sums(n, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(STEPS + 1):
        mix = np.einsum("ij,ij->i", p, np.repeat(share.astype(np.float32), lengths, axis=0))
        gain = _sums(p * (n / mix)[:, None], starts) / totals[:, None]
        if step == STEPS:
            break
        share = share * gain
        share /= share.sum(axis=1, keepdims=True)
    fitted = _sums(n * np.log(mix), starts)
    more = totals * np.log(np.maximum(1.0, np.where(allowed, gain, 0).max(axis=1)))
    return share, fitted, more


def proportions(owner: np.ndarray, bucket: np.ndarray, n: np.ndarray, docs: int, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language of each document or -1, its proportion) by the penalised likelihood over sets of languages."""
    best, score = np.full(docs, -1), np.zeros(docs)
    langs = len(model)
    if not len(owner) or not langs:
        return best, score
    n = n.astype(np.float32)
    p = np.ascontiguousarray(model[:, bucket].T)
    here, starts = np.unique(owner, return_index=True)
    totals = _sums(n, starts)
    penalty = 0.5 * np.log(totals + 1)
    single = _sums(np.log(p) * n[:, None], starts)
    first = single.argmax(axis=1)
    top, best[here], score[here] = single.max(axis=1), first, 1.0
    share, fitted, more = fit(p, n, starts, np.ones((len(here), langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    open_ = np.flatnonzero(fitted + more - penalty > top)
    value = top.copy()
    lengths = np.diff(np.append(starts, len(n)))
    for k in range(2, langs + 1):  # the k largest proportions, while k of them can pay
        open_ = open_[(fitted + more)[open_] - (k - 1) * penalty[open_] > value[open_]]
        if not len(open_):
            break
        rows = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in open_])
        own = np.concatenate([[0], np.cumsum(lengths[open_])[:-1]])
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1, axis=1)
        part, likely, _ = fit(p[rows], n[rows], own, allowed)
        paid = likely - (k - 1) * penalty[open_]
        better = paid > value[open_]
        won = open_[better]
        value[won] = paid[better]
        best[here[won]], score[here[won]] = part[better].argmax(axis=1), part[better].max(axis=1)
    return best, score


def is_held_out(id: Column) -> Column:
    """True for ids whose CRC-32 (of the id as text) leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of `docs`: `id`, lang_pred, score (the proportion of that language, 0 to 1).

    The model is counted on all of `training` (columns text and lang; null langs teach nothing). `und` with score 0
    where the text is null or has no letter, or where nothing was learned. Equal proportions go to the first language
    by name. Repeated rows each get a row; other columns are not passed on. Empty in, empty out.
    """
    names, model = train(training, text, lang)
    held = docs.sparkSession.sparkContext.broadcast((names, model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters_table()
        names, model = held.value
        for batch in batches:
            said, scores = [], []
            for rows in gulps(batch.column(1), most=GULP * 8 // max(8, len(names))):
                best, score = proportions(*trigram_counts([r[0] for r in rows], letter), len(rows), model)
                said += ["und" if b < 0 else names[b] for b in best]
                scores += np.clip(score, 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["_id", "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")).mapInArrow(task, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id)
