"""Training-data pipeline over `documents`: each stage reads what the stage before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmart.llm import decontaminate, jaccard, language, mixing, token_files
from leafmart.llm.common import staged, unused
from leafmart.llm.queries import table, tokenizer_definition


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; all labelled rows of the input may teach. Texts without a letter go."""
    model = language.learn_dictionaries(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, model)
    return found.where(~F.col("language.rejected")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group, of several texts under this id the one
    with the least hash. Texts without words have groups of their own. Of rows that agree in id and text (told apart by a 64-bit
    hash) the one with the least hash of all columns stays; different texts under one id, or without an id, all stay."""
    groups = jaccard.grouped_rows(docs.select("doc_id", "text"))
    mark, same_doc, same_text, row = unused(docs, "_mark", "_id", "_hash", "_row")
    first = groups.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("key")).select("key.doc_id", "key.mark")
    kept = first.unionByName(groups.where("group is null").select("doc_id", "mark").distinct()).select(F.col("doc_id").alias(same_doc), F.col("mark").alias(same_text))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    keyed = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(same_doc)) & (F.col(mark) == F.col(same_text)), "left_semi")
    return keyed.groupBy("doc_id", mark).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row)).select(f"{row}.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(F.col("contamination.n_hit") == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.materialised(mixing.mix_sources(docs), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files read back, a row a document of the mix."""
    read = token_files.round_trip(docs.select("doc_id", "text"), tokenizer_definition())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Compression, token ids and hashed keys of the mix are beyond SQL; tests run every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
