"""Price distributions by exact index percentiles.

Prices are first counted per bucket and cent value (map-side combined), so a bucket with a third of all listings
becomes a short histogram; ranks are then read off its running count. Nothing sorts whole buckets of listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart.functions.numbers import cents, round_dec
from leafmart.functions.pricing import caps_table, strip_shard, weight_tier
from leafmart import lookups as L


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Distinct values per key with counts: ``v``, ``c``, running count before the value ``below`` and total ``n``."""
    counted = df.select(*keys, value.alias("v")).filter(F.col("v").isNotNull()).groupBy(*keys, "v").agg(
        F.count("*").alias("c"))
    running = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return counted.withColumn("below", F.sum("c").over(running) - F.col("c")).withColumn("n", F.sum("c").over(whole))


def at_index(index: Column) -> Column:
    """Value at a 0-based position of the sorted bucket, over ``histogram`` rows."""
    return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("c")), F.col("v")))


def _third(n: Column, num: int, den: int) -> Column:
    return F.floor(n * num / den).cast("long")


def _active_with_tier(products: DataFrame) -> DataFrame:
    live = products.filter(F.col("is_active") & (F.col("sale_price") > 0))
    return (live.withColumn("category", F.coalesce("category", F.lit("other")))
            .withColumn("region", F.coalesce("region", F.lit("unknown")))
            .withColumn("weight_tier", weight_tier(F.col("category"), F.col("weight_value").cast("double")))
            .filter(F.col("weight_tier").isNotNull()))


def _distribution(rows: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    hist = histogram(rows, keys, cents(F.col("sale_price")))
    n = F.col("n")
    lower, upper = F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long")
    stats = hist.groupBy(*keys).agg(
        F.max("n").alias("sample_size"), at_index(_third(n, 1, 4)).alias("_p25"), at_index(lower).alias("_lo"),
        at_index(upper).alias("_hi"), at_index(_third(n, 3, 4)).alias("_p75"), F.min("v").alias("_min"),
        F.max("v").alias("_max")).filter(F.col("sample_size") >= min_n)
    money = lambda c: (F.col(c) / 100).cast("double")
    return stats.select(
        *keys, "sample_size", money("_p25").alias("p25"),
        round_dec((F.col("_lo") + F.col("_hi")) / 200, 2).alias("p50"),
        money("_p75").alias("p75"), money("_min").alias("p_min"), money("_max").alias("p_max"))


def price_distribution(products: DataFrame, min_n: int = 5) -> DataFrame:
    """Per region, category and weight tier: positions n//4, true median, 3n//4, lowest and highest price."""
    return _distribution(_active_with_tier(products), ["region", "category", "weight_tier"], min_n)


def brand_pricing(products: DataFrame, min_n: int = 3) -> DataFrame:
    rows = _active_with_tier(products.filter(F.coalesce("brand", F.lit("")) != ""))
    return _distribution(rows, ["brand", "region", "category", "weight_tier"], min_n)


def enrichment_snapshots(products: DataFrame, snapshot_date: str) -> DataFrame:
    """Both snapshot kinds in one table, keyed for the weekly upsert."""
    general = price_distribution(products).withColumn("brand", F.lit(None).cast("string")).withColumn(
        "snapshot_type", F.lit("price_distribution"))
    branded = brand_pricing(products).withColumn("snapshot_type", F.lit("brand_pricing"))
    return general.unionByName(branded).withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))


def cross_region_brands(snapshots: DataFrame, min_regions: int = 2) -> DataFrame:
    regions = snapshots.groupBy("brand").agg(F.array_sort(F.collect_set("region")).alias("_r"))
    return regions.filter(F.size("_r") >= min_regions).select(
        "brand", F.size("_r").cast("long").alias("n_regions"), F.array_join("_r", ",").alias("regions"))


def fixed_cap(rows: DataFrame) -> DataFrame:
    """Adds the hand-set cap for comparison: exact tier of the state row, NULL when that tier has none."""
    state = strip_shard(F.col("region"))
    states = [s for s in L.PRICE_CAPS if s != "base"]
    joined = rows.withColumn("_s", F.when(state.isin(states), state).otherwise("base")).join(
        F.broadcast(caps_table(rows.sparkSession)),
        (F.col("_s") == F.col("cap_state")) & (F.col("category") == F.col("cap_category")), "left")
    number = F.regexp_extract("weight_tier", r"^([0-9.]+)", 1).try_cast("double")
    flat = F.filter("cap_steps", lambda s: (s["tier"] == 0.0) | (s["tier"] == number))
    return joined.withColumn("hardcoded_cap", F.try_element_at(flat, F.lit(1))["cap"]).select(*rows.columns, "hardcoded_cap")


def price_cap_recommendations(products: DataFrame, min_active: int = 20) -> DataFrame:
    """Learned cap = 1.1 x the price at position int(0.30 n); active from ``min_active`` listings on.

    The middle price here is the upper one (position n//2), unlike the distributions.
    """
    keys = ["region", "category", "weight_tier"]
    hist = histogram(_active_with_tier(products), keys, cents(F.col("sale_price")))
    n = F.col("n")
    # int(n * 0.30) on doubles, as binary 0.3 lies just below three tenths
    p30 = F.floor(n.cast("double") * F.lit(0.30)).cast("long")
    stats = hist.groupBy(*keys).agg(
        F.max("n").alias("sample_size"), at_index(_third(n, 1, 4)).alias("_p25"), at_index(p30).alias("_p30"),
        at_index(_third(n, 1, 2)).alias("_p50"), at_index(_third(n, 3, 4)).alias("_p75"))
    out = fixed_cap(stats.withColumn("recommended_cap", round_dec(F.col("_p30") / 100 * 1.1, 2)))
    fixed = F.when(F.col("hardcoded_cap") > 0, F.col("hardcoded_cap"))
    delta = round_dec((F.col("recommended_cap") - fixed) / fixed * 100, 1)
    money = lambda c: (F.col(c) / 100).cast("double")
    return out.select(
        *keys, "recommended_cap", money("_p25").alias("p25"), money("_p30").alias("p30"),
        money("_p50").alias("p50"), money("_p75").alias("p75"), "sample_size", "hardcoded_cap",
        delta.alias("cap_delta_pct"), (F.col("sample_size") >= min_active).alias("is_active"))
