"""The registered query of each operator, over the whole table, and its SQL twin where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.llm import exact_dedup, language, license_scan, line_dedup, mixing, neural_lm, phrases, piece_bpe, quality, simhash, token_counts, token_store, vector_codes
from bourse.llm.shared import new_path, quoted, stored


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    out = new_path(spark, "tokens")
    token_store.write_tokens(_documents(spark, folder), out, vocabulary("word_bpe_49k.json"), end=2)
    return token_store.read_tokens(spark, out, ids=False, digests=True).withColumnRenamed("id", "doc_id")


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, folder)).select("doc_id", "text", "n_lines", "n_removed")


def document_path() -> F.Column:
    """A place for each document: its source, then its id's digits but the last as directories, then the id."""
    number = F.col("doc_id").cast("string")
    above = F.expr("regexp_replace(substring(cast(doc_id as string), 1, length(cast(doc_id as string)) - 1), '(.)', '$1/')")
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), above, number)


def licence_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no names, so each is compared as a whole too, as a licence file would be."""
    return license_scan.license_scan(_documents(spark, folder).withColumn("path", document_path()), whole=".*")


def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_bpe.encode_pieces(_documents(spark, folder), vocabulary("piece_bpe_32k.model"), ids=False, digests=True)


def language_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held = language.is_held_out(F.col("doc_id"))
    found = language.identify(docs, docs.where(~held))
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def context_lengths(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.encoded_lengths(_documents(spark, folder), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.length_table(lengths)


def quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger is written once; verdicts and ablations are read from it."""
    book = stored(quality.ledger(_documents(spark, folder)), "quality-ledger")
    judged = quality.verdicts(book, {"base_passed": quality.mask_of(quality.BASE), "kept": quality.mask_of(quality.CURRENT)}).withColumn("only_rule", quality.alone())
    dropped = quality.ablations(book, (quality.CURRENT,)).select(F.col("rule").alias("only_rule"), F.col("only_this").alias("n_only_rule"))
    measured = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.join(F.broadcast(dropped), "only_rule", "left").select(*measured, (~F.col("base_passed")).alias("base_failed"), "kept", "failed", "only_rule", "n_only_rule")  # a row per rule


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(_documents(spark, folder))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("_fp")).alias("fingerprint"), "component_id")


def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    digest = F.sha2(F.coalesce(quoted("text"), F.lit("")), 256)
    return exact_dedup.exact_dedup(docs, carry={"text_sha256": digest}, digest="text_sha256")


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, folder))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_documents(spark, folder))


def language_model(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the documents, by a checksum of their ids, is held out."""
    return neural_lm.lm_scores(_documents(spark, folder), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def compressed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": token_output,
    "op2_line_dedup": line_windows,
    "op3_license_scan": licence_tree,
    "op4_sentence_pieces": sentence_pieces,
    "op5_language_mixtures": language_mixtures,
    "op6_token_counts": context_lengths,
    "op7_quality_ledger": quality_ledger,
    "op8_simhash": simhash_groups,
    "op9_exact_dedup": exact_groups,
    "op10_source_mix": source_mix,
    "op11_phrase_collocations": phrase_collocations,
    "op12_language_model": language_model,
    "op13_vector_codes": compressed_vectors,
}
