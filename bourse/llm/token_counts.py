"""Token counts: an exact histogram of encoded lengths, from which suffix sums answer for every context limit.

Documents are encoded once; what is shuffled is a count per length. The histogram is cut into blocks of lengths, so that
the running sums never meet in one task: only one row per block does.
"""

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm.shared import quoted, stored

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1024


def read_encoding(ranks: str, pattern: str):
    """A byte-level BPE without special tokens, from a file of base64 pieces and ranks."""
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(encoding, text: str | None) -> int:
    """Tokens of one whole text. The library's pattern engine gives up on runs of hundreds of thousands of spaces; such a text is cut by the same pattern in another engine, and the library encodes the pieces."""
    if not text:
        return 0
    try:
        return len(encoding.encode_ordinary(text))
    except BaseException as stopped:
        if type(stopped).__name__ != "PanicException":
            raise
    import regex

    return sum(len(encoding._core_bpe.encode_single_piece(m[0].encode())) for m in regex.finditer(encoding._pat_str, text))


def encoded_lengths(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: `id`, n_tokens of the whole text; null and empty texts have none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = read_encoding(ranks, pattern)
        for batch in batches:
            counts = [count_tokens(encoding, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["_id", "n_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")).mapInArrow(task, f"_id {kind}, n_tokens bigint").withColumnRenamed("_id", id)


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, which is read as a context limit.

    n_tokens; n_docs of this length; docs_longer, tokens_longer (suffix sums); tokens_within (of the documents that
    fit); truncated_total (tokens left when each document is cut at the limit); share_within (the quantile whose value
    n_tokens is). Rows of length 0 count as documents. No documents give no rows.
    """
    histogram = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("_block", F.expr(f"n_tokens div {BLOCK}")), "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = histogram.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    beyond = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy()
    later = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select("_block", later("_docs", beyond).alias("_docs_beyond"), later("_tokens", beyond).alias("_tokens_beyond"), F.sum("_docs").over(everything).alias("_all_docs"), F.sum("_tokens").over(everything).alias("_all_tokens"))
    longer = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    out = histogram.join(blocks, "_block").select(
        "n_tokens", "n_docs", (F.col("_docs_beyond") + later("n_docs", longer)).alias("docs_longer"), (F.col("_tokens_beyond") + later(tokens, longer)).alias("tokens_longer"), "_all_docs", "_all_tokens"
    )
    within = F.col("_all_tokens") - F.col("tokens_longer")
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", within.alias("tokens_within"), (within + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("_all_docs") - F.col("docs_longer")) / F.col("_all_docs")).alias("share_within"),
    )


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total) for any limits, also such as no document has: the next shorter length has the same documents beyond it."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    rows = table.select(asked.alias("context_limit"), "n_tokens", "n_docs")
    over = F.col("n_tokens") > F.col("context_limit")
    return rows.groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit")).alias("truncated_total")
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """One row, n_tokens: the shortest length that at least `share` of the documents do not exceed."""
    return table.where(F.col("share_within") >= F.lit(share)).agg(F.min("n_tokens").alias("n_tokens"))
