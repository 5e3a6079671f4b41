"""De-duplication of passages: overlapping windows of consecutive lines that repeat anywhere in the corpus.

Windows travel as two 64-bit hashes and a position; a window's first place is the one that stays, all later ones are
covered. A frequent window is folded to one row before it is shuffled, and the join back to its places is a plain
equality join whose large partitions adaptive execution splits. Only a document's own covered positions meet in one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted, stored


def _lines(text: str) -> Column:
    return F.split(body(text), "\n", -1)


def _windows(width: int) -> Column:
    """(pos, h1, h2) of each window of `_lines` that holds a character other than white space."""
    line = lambda i, k: F.element_at("_lines", i + k)

    def window(i: Column) -> Column:
        parts = [line(i, k) for k in range(width)]
        return F.struct((i - 1).alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(*parts[::-1], F.lit(width)).alias("h2"), F.concat(*parts).rlike(r"[^\x20\x09-\x0D]").alias("said"))

    last = F.size("_lines") - width + 1
    return F.filter(F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), window), lambda w: w["said"])


def covered_positions(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(_k1, _k2, _gone): for each document with later occurrences, the line numbers (from 0) that they cover."""
    keyed = docs.select(quoted(id).alias("_id"), *_keys(id, text), _lines(text).alias("_lines"))
    windows = stored(keyed.select("_id", "_k1", "_k2", F.explode(_windows(width)).alias("_w")).select("_id", "_k1", "_k2", "_w.pos", "_w.h1", "_w.h2"), "line-windows")
    place = F.struct("_id", "_k1", "_k2", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last").select("h1", "h2", "_first")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("_first"))
    return later.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_starts")).select(
        "_k1", "_k2", F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + width - 1)))).alias("_gone")
    )


def _keys(id: str, text: str) -> list[Column]:
    """128 bits that name a document by id and text."""
    return [F.xxhash64(quoted(id), body(text), F.lit(1)).alias("_k1"), F.xxhash64(body(text), F.coalesce(quoted(id).cast("string"), F.lit("")), F.lit(2)).alias("_k2")]


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """All input rows and columns, `text` without repeated passages, with n_lines and n_removed.

    Lines end at "\\n". A window is `width` consecutive lines, at least one with a character other than white space.
    Windows are equal when all their lines are. By id (null first), then place in the text, the first occurrence of a
    window stays; the lines of every later one go, those that another later one covers included, also where it
    overlaps its own first. Documents of fewer lines have no window and stay as they are; null texts stay null. Rows
    that share id and text are one document to the search: each gets the same lines removed. Input columns called
    n_lines or n_removed are replaced. Empty in, empty out.
    """
    gone = covered_positions(docs, id, text, width)
    whole = F.struct(*[quoted(c) for c in docs.columns])  # names of any kind travel inside
    joined = docs.select(whole.alias("_doc"), *_keys(id, text)).join(gone, ["_k1", "_k2"], "left")
    rows = joined.withColumn("_lines", F.split(F.coalesce(F.col("_doc").getField(text), F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    cleaned = F.when(F.col("_gone").isNull(), F.col("_doc").getField(text)).otherwise(F.array_join(F.transform(stay, lambda p: F.element_at("_lines", p + 1)), "\n"))
    own = {"n_lines": F.size("_lines").cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    clash = {c.lower() for c in own}
    return rows.select(*[(cleaned if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns if c.lower() not in clash], *[c.alias(n) for n, c in own.items()])
