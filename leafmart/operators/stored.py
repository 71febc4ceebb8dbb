"""Stored tables that later jobs touch in part: upserts by bucket, and a search index beside the offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmart.operators.feed import search
from leafmart.operators.maintenance import upsert
from leafmart.session import dropped_shuffles

#: Turns in which the touched buckets of a table are written.
TURNS = 4
SEARCH_FIELDS = ["name", "brand", "category", "product_subtype", "strain_type"]


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, by: str = "_bucket") -> None:
    """A table in folders by the hash of its keys; the engine sizes the files of a bucket."""
    with dropped_shuffles(rows.sparkSession):
        rows.withColumn(by, bucket_of(keys, buckets)).hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_table(spark: SparkSession, path: str, by: str = "_bucket") -> DataFrame:
    return spark.read.parquet(path).drop(by)


def upsert_buckets(path: str, source: DataFrame, keys: list[str], seq: str, keep: list[str] | None = None, buckets: int = 64, by: str = "_bucket") -> list[int]:
    """Upserts ``source`` into a table of `create_table`; only buckets with incoming keys are read and written again.

    Rules are those of `upsert`. Returns the touched buckets (at most ``buckets`` numbers reach the driver). Null keys have a
    bucket like others. An empty source touches nothing. ``buckets`` must be the number the table was made with.

    Buckets are rewritten in `TURNS` turns, each of which reads the source again and removes its shuffle files, so that the disk
    need not hold those of the whole table. Running again after a failure between turns gives the same table.
    """
    spark = source.sparkSession
    incoming = source.withColumn(by, bucket_of(keys, buckets))
    touched = sorted(r[by] for r in incoming.select(by).distinct().collect())
    if not touched:
        return []
    stored = spark.read.parquet(path)
    with dropped_shuffles(spark):
        for part in filter(None, (touched[i::TURNS] for i in range(TURNS))):
            here = F.col(by).isin(part)
            merged = upsert(stored.filter(here), incoming.filter(here), [*keys, by], seq, keep)
            merged.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return touched


def grams_of(text: Column) -> Column:
    """Runs of three characters of a lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def build_search_index(offers: DataFrame, root: str, blocks: int = 256, shelves: int = 64) -> None:
    """Offers in folders by block (hash of id), and beside them which blocks hold a run of three characters of a searched field.

    The posting table has a row a run and block, not a row a run and offer, so it stays small; its folders are shelves of runs.
    """
    placed = offers.withColumn("_block", bucket_of(["id"], blocks))
    placed.hint("rebalance", "_block").write.mode("overwrite").partitionBy("_block").parquet(f"{root}/offers")
    stored = offers.sparkSession.read.parquet(f"{root}/offers")
    runs = F.array_distinct(F.flatten(F.array(*[grams_of(F.col(f)) for f in SEARCH_FIELDS])))
    postings = stored.select("_block", F.explode(runs).alias("gram")).distinct()
    postings = postings.withColumn("_shelf", bucket_of(["gram"], shelves))
    postings.hint("rebalance", "_shelf").write.mode("overwrite").partitionBy("_shelf").parquet(f"{root}/postings")


def candidate_blocks(spark: SparkSession, root: str, query: str, shelves: int = 64) -> list[int] | None:
    """Blocks that hold every run of three characters of the query; None if it is too short to have one."""
    q = query.strip()[:100].lower()
    runs = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not runs:
        return None
    wanted = spark.createDataFrame([(r,) for r in runs], "gram string").withColumn("_shelf", bucket_of(["gram"], shelves))
    on = sorted({r["_shelf"] for r in wanted.collect()})
    hits = spark.read.parquet(f"{root}/postings").filter(F.col("_shelf").isin(on) & F.col("gram").isin(runs))
    full = hits.groupBy("_block").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs))
    return sorted(r["_block"] for r in full.select("_block").collect())  # at most the number of blocks


def stored_offers(spark: SparkSession, root: str) -> DataFrame:
    """All offers beside the index."""
    return spark.read.parquet(f"{root}/offers").drop("_block")


def pruned_offers(spark: SparkSession, root: str, query: str, shelves: int = 64) -> DataFrame:
    """Stored offers of the blocks that can hold the query's text; other folders are not opened."""
    stored = spark.read.parquet(f"{root}/offers")
    blocks = candidate_blocks(spark, root, query, shelves)
    return (stored if blocks is None else stored.filter(F.col("_block").isin(blocks) if blocks else F.lit(False))).drop("_block")


def search_index(spark: SparkSession, root: str, query: str, region: str, curated: DataFrame | None = None, limit: int = 200, shown: int = 60, shelves: int = 64) -> DataFrame:
    """`search` over the blocks that the index leaves; the same rows, as every hit contains the query and so all its runs."""
    return search(pruned_offers(spark, root, query, shelves), query, region, curated, limit, shown)
