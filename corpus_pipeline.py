"""A training-data pipeline over `documents`: five stages, each an operator of bourse.llm.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs; all but
the last return the columns they were given. Rows that share id and text are one document to the stages that keep or
repeat whole documents. Nulls, empty texts and empty tables are as the operators state.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.llm import line_dedup as lines
from bourse.llm import mixing, near_copies, piece_bpe, quality
from bourse.llm.queries import vocabulary
from bourse.llm.shared import body, quoted, stored

# Near copies: sets of five-word shingles alike to 4/5 (Jaccard). Candidates are told by 256 bits: sets alike to 0.8 have an
# angle of 0.48, which sets about 39 bits apart, give or take 6; unlike texts differ in 128, give or take 8.
SHINGLE, ALIKE, WORDS, RADIUS = 5, (4, 5), 4, 72


def _key() -> Column:
    """128 bits of a row's id and text."""
    return F.struct(F.xxhash64(quoted("doc_id"), body("text"), F.lit(1)).alias("k1"), F.xxhash64(body("text"), F.coalesce(quoted("doc_id").cast("string"), F.lit("")), F.lit(2)).alias("k2"))


def _with_keys(docs: DataFrame) -> DataFrame:
    """(_doc, _k1, _k2): the row as one struct, so that names of any kind travel inside, and its key."""
    key = _key()
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), key["k1"].alias("_k1"), key["k2"].alias("_k2"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages go; n_chars follows the text."""
    cleaned = lines.line_dedup(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(quoted("n_chars")))
    return cleaned.select(*[quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (null first, then by a hash of id and text)."""
    named = docs.select(F.struct(quoted("doc_id").alias("doc_id"), _key().alias("key")).alias("_name"), quoted("text").alias("text"))
    groups = near_copies.near_keepers(named, id="_name", shingle=SHINGLE, alike=ALIKE, words=WORDS, radius=RADIUS)
    stay = groups.select("component_id.key.*").distinct().select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return _with_keys(docs).join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    named = docs.select(_key().alias("_name"), quoted("text").alias("text"), quoted("source").alias("source"))
    taken = mixing.mix_sources(named, id="_name", key=F.col("_name.k1"))
    copies = taken.groupBy(F.col("_name.k1").alias("_k1"), F.col("_name.k2").alias("_k2")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    rows = _with_keys(docs).dropDuplicates(["_k1", "_k2"]).join(copies, ["_k1", "_k2"])
    return rows.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    return piece_bpe.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), ids=True, digests=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mix_sources", mix), ("sentence_pieces", encode)]

# Fingerprints, tilts and merges are beyond SQL; the tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
