"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

A step is a partially aggregated count over keys, and only rows that it leaves in a group of two or more go on to the
next. What travels between machines are keys. Where the caller has a digest of every text anyway, it is taken where the
text lies and no text travels at all; else texts are read a second time, and only those of surviving groups are hashed.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted, stored

SALTS = 8  # keys over which the rows of one group are dealt while the group is looked up


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = 64, carry: Mapping[str, Column] | None = None, digest: str | None = None) -> DataFrame:
    """One row per input row: `id`, keep_id, group_size, kept, and the columns of `carry` (expressions over `docs`).

    Texts are equal when all characters are (their SHA-256 is what is compared); null counts as empty. `digest` names
    the column of `carry` that is the text's SHA-256 in hex, if there is one. Of equal texts the row with the largest id
    stays, a null id being the smallest; of rows that also share the id one stays. `head` characters make the prefix
    hash. Other columns are not passed on, so clashing names do no harm. Empty in, empty out.
    """
    carry = dict(carry or {})
    length, prefix = F.octet_length(body(text)), F.xxhash64(F.substring(body(text), 1, head))
    salt = lambda: F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(SALTS)).cast("int")
    carried = {c: f"_carry_{k}" for k, c in enumerate(carry)}
    keys = [quoted(id).alias("_id"), *[x.alias(carried[c]) for c, x in carry.items()], length.alias("_len"), prefix.alias("_head"), F.monotonically_increasing_id().alias("_row")]
    if digest is not None:
        rows = stored(docs.select(*keys).withColumn("_salt", salt()), "exact-keys")
        open_groups = rows.groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_head")
        full = rows.join(_salted(open_groups), ["_len", "_head", "_salt"], "left_semi").select("_id", "_row", "_len", F.col(carried[digest]).alias("_full"))
        ledger = rows.withColumn("_full", F.col(carried[digest]))
    else:
        open_groups = docs.groupBy(length.alias("_len"), prefix.alias("_head")).agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_head", F.lit(True).alias("_open"))
        opened = docs.select(*keys, body(text).alias("_text")).withColumn("_salt", salt()).join(_salted(open_groups), ["_len", "_head", "_salt"], "left")
        ledger = stored(opened.select("_id", "_row", "_salt", *carried.values(), "_len", F.when(F.col("_open"), F.sha2("_text", 256)).alias("_full")), "exact-keys")
        full = ledger.where("_full is not null").select("_id", "_row", "_len", "_full")
    groups = full.groupBy("_len", "_full").agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")).where("_n > 1")
    single = F.col("_n").isNull()
    return ledger.join(_salted(groups), ["_len", "_full", "_salt"], "left").select(
        F.col("_id").alias(id),
        F.when(single, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        *[F.col(carried[c]).alias(c) for c in carry],
    )
