"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over the stored results.

The ledger holds a document's measurements and one failure bit per rule. A policy is a named, versioned set of rules;
applying it, or asking what leaving one rule out would change, reads the bits and never the texts again.
"""

import sys
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import quoted, with_own

# Tasks get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_unspaced")
# First and last code points of scripts that put no spaces between words (Thai and Lao, Burmese, Khmer, and
# the Han, kana and related blocks, those beyond the basic plane last).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask, never reused for another rule. fails: true where a document fails it."""

    name: str
    bit: int
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: frozenset[str] = field(default_factory=frozenset)


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 20),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("word_length", 2, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
    Rule("symbols", 3, lambda: 100 * F.col("n_symbols") > 10 * F.col("n_words")),
    Rule("repeated_lines", 4, lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    Rule("shouting", 5, lambda: 100 * F.col("n_capitals") > 50 * F.col("word_chars")),
    # As word_length, but long "words" count against a text only where at most half of it is of scripts without spaces.
    Rule("spaced_word_length", 6, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | ((F.col("word_chars") > 12 * F.col("n_words")) & (2 * F.col("n_unspaced") <= F.col("word_chars")))),
)
BASE = Policy("base", frozenset({"few_words", "repeated_windows"}))
POLICIES = (
    BASE,
    Policy("2", BASE.rules | {"symbols", "word_length", "repeated_lines", "shouting"}),
    Policy("3", BASE.rules | {"symbols", "spaced_word_length", "repeated_lines", "shouting"}),
)
CURRENT = POLICIES[-1]


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in a window of `width` words that is found twice or more.

    Sums of the words' numbers times powers of an odd constant, modulo 2**64, tell windows apart; only where two sums
    are equal are windows compared exactly, by numbering pairs, then pairs of pairs.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    names, span = codes, 1
    while span < width:  # names of windows of `span` words; width is a power of two
        m = len(names) - span
        names = np.unique(names[:m] * np.int64(len(words) + 1) + names[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
    again = np.bincount(names)[names] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def unspaced(text: str) -> int:
    """Characters of scripts without spaces between words."""
    if text.isascii() or max(text) < chr(UNSPACED[0][0]):
        return 0
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(sum(np.count_nonzero((points >= a) & (points <= b)) for a, b in UNSPACED))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; null has no words. Bytes are used: splitting them splits at the six ASCII spaces only."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - spaces, sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), unspaced(text),
    )


def measured(rows: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """rows with the measurements of their column `text`, which stays or goes. Rows are measured where they lie."""
    at = rows.columns.index(text)
    kept = [k for k in range(len(rows.columns)) if keep_text or k != at]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(at)]
            own = [pa.array([r[k] for r in found], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *own], names=[*[batch.schema.names[k] for k in kept], *MEASURES])

    kinds = [f"{rows.columns[k]} {rows.schema[k].dataType.simpleString()}" for k in kept]
    return rows.mapInArrow(task, ", ".join(kinds + [f"{m} bigint" for m in MEASURES]))


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """A bit for each rule that measured rows fail."""
    failed = F.lit(0).cast("long")
    for r in rules:
        failed = failed.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return failed


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: `id`, the measurements, and `failed`, a bit for each rule that the document fails.

    Null and empty texts have no words and fail what such a text fails. Repeated rows are measured each. Other columns
    are not passed on, so clashing names do no harm. Empty in, empty out.
    """
    found = measured(docs.select(quoted(id).alias("_id"), quoted(text).alias("_text")), "_text", keep_text=False)
    return found.select(F.col("_id").alias(id), *MEASURES, failures(rules).alias("failed"))


def verdicts(book: DataFrame, policies: Mapping[str, int]) -> DataFrame:
    """The ledger with a boolean column per policy (name to mask): true where no rule of its mask failed."""
    return with_own(book, **{name: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0 for name, mask in policies.items()})


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents it fails, and documents only it rejects (kept without it).

    Rows are first counted by bit pattern, of which there are at most 2 to the number of rules; all else are sums over
    those few counts. Columns: version, rule, rejected (by the policy), failed, only_this. An empty ledger gives none.
    """
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(mask_of(p, rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit")) for p in policies for r in rules if r.name in p.rules]
    each = patterns.select("failed", "n", F.explode(F.array(*pairs)).alias("x")).select("failed", "n", "x.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(total(hit != 0).alias("rejected"), total(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"), total(hit == F.col("bit")).alias("only_this"))


def alone(policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule that alone rejects a row of the ledger under the policy, so that without it the row would stay; else null."""
    hit = F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long"))
    return F.coalesce(*[F.when(hit == F.lit(1 << r.bit).cast("long"), F.lit(r.name)) for r in rules if r.name in policy.rules])


def keep_good(docs: DataFrame, policy: Policy = CURRENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that the policy keeps, with all their columns: the ledger's rows carry them, its bits decide.

    Nothing is shuffled. Names of any kind travel as places.
    """
    places = [f"_{k}" for k in range(len(docs.columns))]
    rows = measured(docs.toDF(*places), places[docs.columns.index(text)], keep_text=True)
    good = verdicts(rows.select(*places, failures().alias("failed")), {"_kept": mask_of(policy)}).where("_kept")
    return good.select(*[F.col(p).alias(c) for p, c in zip(places, docs.columns, strict=True)])
