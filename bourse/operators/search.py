"""Search: nearest vectors by tiles, an inverted-file index over vectors, an inverted index over texts.

Vectors and queries travel as tiles of a bounded number of rows. A pair of tiles is one matrix product, and leaves at
most k candidates per query; those are merged by a ranked window that cuts each task's rows before they are shuffled.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.functions.scalar import norm

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE, ASKED = 4096, 1024  # vectors and queries of a tile
AT_ONCE = 256  # queries whose similarities to a tile are held at a time
SALTS = 8  # keys over which the rows of a group are dealt
COUNTED = 1024  # documents whose terms are counted at a time
SHARD, BLOCK = 16384, 50_000  # documents of a shard and queries of a block, about


def tiles(rows: DataFrame, id: str, vector: str, size: int, by=(), at_most: int | None = None) -> DataFrame:
    """(*by, _tile, _ids, _flat): rows in tiles of about `size` by a hash of the id; ids in order, vectors one after the other as doubles.

    Groups of `by` of any size are cut; a count per group, under salted keys, says into how many tiles.
    """
    deal = F.xxhash64(id)
    if not by:
        many = 1 + rows.count() // size if at_most is None else at_most
        placed = rows.withColumn("_tile", F.pmod(deal, F.lit(many)).cast("int"))
    else:
        salt = F.pmod(F.xxhash64(id, F.lit(1)), F.lit(SALTS)).cast("int")
        sizes = rows.groupBy(*by).agg((1 + F.floor(F.count("*") / size)).alias("_many")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = rows.withColumn("_salt", salt).join(sizes, [*by, "_salt"]).withColumn("_tile", F.pmod(deal, F.col("_many")).cast("int"))
    held = F.array_sort(F.collect_list(F.struct(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))))
    packed = placed.where(F.col(vector).isNotNull()).groupBy(*by, "_tile").agg(held.alias("_h"))
    return packed.select(*by, "_tile", F.col("_h.id").alias("_ids"), F.flatten("_h.v").alias("_flat"))


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the k largest, as a mask; of equal scores the first columns. NaN counts as least."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above, level = scores > bound, scores == bound
    return above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Tile pairs (query ids, query vectors, vector ids, vectors) to (qid, vec_id, similarity), at most k per query and pair."""
    for batch in batches:
        for r in range(batch.num_rows):
            qids, vids = batch.column(0)[r].values, batch.column(2)[r].values
            q, v = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in ((1, len(qids)), (3, len(vids))))
            lengths = np.sqrt((v * v).sum(axis=1))
            for at in range(0, len(q), AT_ONCE):
                some = q[at : at + AT_ONCE]
                below = np.sqrt((some * some).sum(axis=1))[:, None] * lengths
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(below > 0, np.round(some @ v.T / below, 9), -np.inf)
                i, j = np.nonzero(best_columns(s, k))
                known = s[i, j]
                similarity = pa.array(known, pa.float64(), mask=~np.isfinite(known))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i + at)), vids.take(pa.array(j)), similarity], names=["qid", "vec_id", "similarity"])


def _ranked(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double"
    scored = pairs.mapInArrow(lambda batches: _scored(batches, k), kinds)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), F.asc("vec_id")))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """(qid, vec_id, similarity, rank): the k most similar stored vectors per query by cosine, from (qid, q) and (vec_id, v).

    Exact, for any number of queries: tiles of about `block` queries meet all tiles of vectors. Equal similarities (to nine digits) go
    to the smaller vec_id; vectors without length come last with a null. `live` (vec_id) leaves out vectors whose entity
    is gone.
    """
    if live is not None:
        vectors = vectors.join(live.select("vec_id").distinct(), "vec_id", "left_semi")
    block = block or ASKED
    asked = 1 + queries.count() // block
    left = tiles(queries, "qid", "q", block, at_most=asked).select(F.col("_tile").alias("_block"), F.col("_ids").alias("_qids"), F.col("_flat").alias("_q"))
    right = tiles(vectors, "vec_id", "v", TILE).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    return _ranked(right.join(left, "_block").select("_qids", "_q", "_ids", "_flat"), queries, vectors, k)


def fitted_centres(vectors: DataFrame, lists: int, sample: int = 64, rounds: int = 10) -> np.ndarray:
    """Directions of `lists` groups, fitted on about `sample` vectors per list picked by a hash of the id: a bounded sample."""
    want = lists * sample
    total = max(1, vectors.count())
    picked = vectors.where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(total)) < want)).limit(2 * want)
    rows = picked.select("vec_id", F.col("v").cast("array<double>")).toArrow().sort_by("vec_id")
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = np.array(rows.column("v").to_pylist())
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _nearest_lists(rows: DataFrame, id: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """rows with `_list`, one row for each of the `probes` nearest centres."""
    held = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        most = min(probes, len(centres))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most]
                at = pa.array(np.repeat(np.arange(batch.num_rows), most))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=[id, vector, "_list"])

    known = rows.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias(vector))
    return known.mapInArrow(task, f"{id} {kind}, {vector} array<double>, _list int")


def write_vector_index(vectors: DataFrame, folder: str, lists: int, sample: int = 64) -> None:
    """An inverted file of (vec_id, v): every vector in the list of its nearest centre, one directory per list.

    Centres are fitted on a bounded sample (see `fitted_centres`); they steer which vectors a search reads.
    """
    centres = fitted_centres(vectors, lists, sample)
    spark = vectors.sparkSession
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "_list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    _nearest_lists(vectors, "vec_id", "v", centres, 1).repartition("_list", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).write.partitionBy("_list").parquet(f"{folder}/lists")


def search_vector_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """As `vector_topk`, over the vectors of each query's `probes` nearest lists only: approximate, tested for recall."""
    stored = spark.read.parquet(f"{folder}/centres").orderBy("_list").collect()  # a bounded number of centres
    vectors = spark.read.parquet(f"{folder}/lists")
    asked = _nearest_lists(queries, "qid", "q", np.array([r.centre for r in stored]).reshape(len(stored), -1), probes)
    left = tiles(asked, "qid", "q", ASKED, by=["_list"]).select("_list", F.col("_ids").alias("_qids"), F.col("_flat").alias("_q"))
    right = tiles(vectors, "vec_id", "v", TILE, by=["_list"])
    return _ranked(right.join(left, "_list").select("_qids", "_q", "_ids", "_flat"), queries, vectors, k)


def _terms(text) -> F.Column:
    return F.filter(F.split(norm(text), " "), lambda t: t != "")


def _postings(batches: Iterator[pa.RecordBatch], weights: list[float], mean: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(doc, len, terms of each field) to (term, doc, impact), a row per term of a document; rows of one term lie together."""
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED):
            some = batch.slice(at, COUNTED)
            each = [some.column(2 + f) for f in range(len(weights))]
            said = pa.chunked_array([e.flatten() for e in each], pa.string()).combine_chunks().dictionary_encode()
            row = np.concatenate([pc.list_parent_indices(e).to_numpy() for e in each])
            w = np.concatenate([np.full(len(e.flatten()), x) for e, x in zip(each, weights, strict=True)])
            key, place = np.unique(said.indices.to_numpy().astype(np.int64) * COUNTED + row, return_inverse=True)
            tf, row = np.bincount(place, w, len(key)), key % COUNTED
            length = some.column(1).to_numpy()[row]
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(key // COUNTED)), some.column(0).take(pa.array(row)), pa.array(impact)], names=["term", "doc", "impact"])


def write_text_index(docs: DataFrame, folder: str, fields: dict, doc: str, best: int = 100, k1: float = 1.2, b: float = 0.75) -> None:
    """An inverted index of weighted fields: postings by term with their impacts, a table of terms, the scoring constants.

    An impact is what a posting adds to a BM25 score before the term's rarity weighs in. Every task counts the terms of
    its documents and writes a segment of its own, so no posting is shuffled; a search asks for `best` documents at most.
    """
    spark = docs.sparkSession
    terms = [F.coalesce(_terms(f), F.array().cast("array<string>")).alias(f"_t{i}") for i, f in enumerate(fields)]
    size = F.greatest(sum((F.size(f"_t{i}") for i in range(len(fields))), F.lit(0)), F.lit(1)).alias("len")
    said = docs.select(F.col(doc).alias("doc"), *terms).select("doc", size, *[f"_t{i}" for i in range(len(fields))])
    said.agg(F.count("*").alias("docs"), F.avg("len").alias("mean")).withColumns({"k1": F.lit(k1), "b": F.lit(b), "best": F.lit(best)}).coalesce(1).write.parquet(f"{folder}/constants")
    mean, weights = spark.read.parquet(f"{folder}/constants").first().mean, [float(w) for w in fields.values()]
    kind = docs.schema[doc].dataType.simpleString()
    said.mapInArrow(lambda batches: _postings(batches, weights, mean, k1, b), f"term string, doc {kind}, impact double").write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")


def _best_of(postings: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(term, doc, impact) of a shard and (qid, term, idf) of a block of queries to (qid, doc, score), the k best per query."""
    out = [pa.table({"qid": asked["qid"].slice(0, 0), "doc": postings["doc"].slice(0, 0), "score": pa.array([], pa.float64())})]
    if not (postings.num_rows and asked.num_rows):
        return out[0]
    coded = postings["doc"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # documents in order, so that ties go to the first column
    column, names = place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
    held = postings["term"].combine_chunks().dictionary_encode()
    code = held.indices.to_numpy()
    by = np.argsort(code, kind="stable")
    column, impact = column[by], postings["impact"].to_numpy()[by]
    starts = np.searchsorted(code[by], np.arange(len(held.dictionary) + 1))
    asked = asked.sort_by([("qid", "ascending"), ("term", "ascending")])
    term = pc.index_in(asked["term"], held.dictionary).to_numpy(zero_copy_only=False)
    idf, queries = asked["idf"].to_numpy(), asked["qid"].combine_chunks().dictionary_encode()
    line, known = queries.indices.to_numpy(), np.flatnonzero(term == term)
    scores = np.zeros((min(AT_ONCE, len(queries.dictionary)), len(names)))
    for first in range(0, len(queries.dictionary), len(scores)):
        scores[:] = 0.0
        for i in known[slice(*np.searchsorted(line[known], [first, first + len(scores)]))]:
            part = slice(starts[int(term[i])], starts[int(term[i]) + 1])
            scores[line[i] - first, column[part]] += idf[i] * impact[part]  # a document holds a term once
        s = np.round(scores, 9)
        q, d = np.nonzero(best_columns(s, k) & (s > 0))
        out.append(pa.table({"qid": queries.dictionary.take(pa.array(q + first)), "doc": names.take(pa.array(d)), "score": pa.array(s[q, d])}))
    return pa.concat_tables(out)


def search_text_index(spark: SparkSession, folder: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): the k best documents by BM25 for each query of (qid, term), any number of queries; exact.

    Documents are dealt into shards by a hash, and a block of queries meets the postings of a shard that hold its terms.
    A pair of them adds up all its scores and leaves at most k documents per query, so what is shuffled are postings and
    queries, never pairs of query and document.
    """
    c = spark.read.parquet(f"{folder}/constants").first()
    if k > c.best:
        raise ValueError(f"the index bounds searches for at most {c.best} documents")
    postings, terms = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms")
    shards = 1 + c.docs // SHARD
    blocks = 1 + queries.select("qid").distinct().count() // BLOCK
    idf = F.log(1 + (F.lit(c.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.distinct().join(terms, "term").select("qid", "term", idf.alias("idf"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("_block"))
    met = postings.join(asked.select("term").distinct(), "term", "left_semi").withColumn("_shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))
    left, right = met.withColumn("_block", number(blocks)), asked.withColumn("_shard", number(shards))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {postings.schema['doc'].dataType.simpleString()}, score double"
    scored = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(lambda p, q: _best_of(p, q, k), kinds)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc")))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)
