"""Queries of the operators over the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.language_id import predict

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return predict(table(spark, sf_dir, "documents"), held_out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.tool_calls import calls_of_chat, link_calls

    out = link_calls(*calls_of_chat(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", F.col("level").cast("long").alias("level"), "linked", "broken", F.sha2("json", 256).alias("json_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.ngram_jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.pii_crf import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.arc_to_warc import pages_to_warc

    return pages_to_warc(table(spark, sf_dir, "pages"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.katz import score_documents

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.fill_middle import fill_middle, restored

    made = fill_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2(c, 256).alias(k) for k, c in (("output_sha256", F.col("output")), ("restored_sha256", restored())))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.merkle import folded, leaf_of, manifest, siblings_digest

    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    rows = manifest(docs, carry=changed)
    back = folded(F.coalesce("carried", "leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_tool_calls, op4_ngram_jaccard, op5_license_scan, op6_decontamination, op7_quality_rules, op8_byte_bpe, op9_pii_crf, op10_arc_to_warc, op11_katz, op12_fill_middle, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    """The other operators' results are not SQL's to give: they are tested against brute force or held-out labels."""
    from foliant.llm import oracles as o

    return {"op3_tool_calls": o.CALLS, "op4_ngram_jaccard": o.JACCARD, "op5_license_scan": o.LICENSES, "op10_arc_to_warc": o.WARC, "op12_fill_middle": o.FILL_MIDDLE, "op13_merkle": o.MERKLE}
