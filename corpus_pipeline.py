"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject, the n-gram Jaccard join keeps the least doc_id of each group,
decontamination drops documents that leak a benchmark item, personal data is masked in the texts, and
the last stage encodes what is left.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_bpe import encode_documents
from foliant.llm.decontamination import leaks
from foliant.llm.ngram_jaccard import jaccard_join
from foliant.llm.pii_crf import mask_documents
from foliant.llm.quality_rules import quality_rules
from foliant.llm.scratch import Scratch, is_empty, small_or_shuffled, temporary

#: Ids to drop that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores more as docs needs not to have it; case doesn't tell columns apart."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with one more column, its own for each row, and its name: the id, or, of rows with a null or repeated one, a number above all ids.

    Only such rows are written; they are numbered once, so the numbers stay. Columns of docs keep their values, whatever their names.
    """
    key, row, other = F.col("doc_id").cast("long"), _free(docs, "_row"), _free(docs, "_id")
    odd = scratch.save(docs.groupBy(key.alias(other)).agg(F.count("*").alias("n")).where(F.col(other).isNull() | (F.col("n") > 1)).select(other), "oddids")
    if is_empty(odd):
        return docs.withColumn(row, key), row
    top = docs.agg(F.max(key)).first()[0]
    small = small_or_shuffled(odd, BROADCAST_ROWS)
    same = key.eqNullSafe(F.col(other))
    rows = scratch.save(docs.join(small, same, "left_semi").withColumn(row, F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)), "oddrows")
    return docs.join(small, same, "left_anti").withColumn(row, key).union(rows), row


def _without(docs: DataFrame, row: str, drop: DataFrame, scratch: Scratch, columns: list[str]) -> DataFrame:
    """docs but for the rows whose number is in drop (doc_id), in the columns named."""
    gone = scratch.save(drop.select(F.col("doc_id").alias(row)).distinct(), "drop")
    return docs.join(small_or_shuffled(gone, BROADCAST_ROWS), row, "left_anti").select(*(f"`{c}`" for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality rules reject, row by row: null and empty texts, repeated and null ids are judged like any other row."""
    scratch = Scratch(spark, "quality-stage")
    rows, row = _numbered(docs, scratch)
    return _without(rows, row, quality_rules(rows, id_col=row).where("not kept"), scratch, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles with a similarity of 0.8 or more connect: the one with the least id.

    Rows whose id is null or stands more than once are kept only where no other row of the group is, and then one of them;
    texts without a word are in no group and stay.
    """
    scratch = Scratch(spark, "near-stage")
    rows, row = _numbered(docs, scratch)
    groups = jaccard_join(rows, k=5, threshold=Fraction(8, 10), id_col=row)
    return _without(rows, row, groups.where("component_id <> doc_id"), scratch, docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that leak an item of benchmark, row by row, whatever their ids; null and empty texts leak nothing."""
    scratch = Scratch(spark, "leaks-stage")
    rows, row = _numbered(docs, scratch)
    found = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return _without(rows, row, found, scratch, docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the personal data of each text masked; every row stays, a null text stays null, n_chars is that of the new text."""
    return mask_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for each row of docs; null and empty texts have no tokens."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("byte_bpe", encoded)]

#: SQL can't express the covariance estimate, the latent space or the random field; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of the documents that all stages keep."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with temporary():  # a stage's own tables go when its result is written, and then the table that it read
            out = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = out
    return docs
