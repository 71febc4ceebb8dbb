"""Upserts, history tables, expiry and retention.

An upsert here is one grouped aggregate over target and source (newest row per key by ``max_by``): NULL keys are
equal, hot keys are combined on the map side, and no join is needed. Writers swap whole versions or partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmart.functions.numbers import flag
from leafmart.operators.ranking import top_per_group

#: Types that no order is defined for; they may lie inside others as well.
UNORDERED = (T.MapType, T.ArrayType, T.StructType, T.VariantType)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], seq: str, keep: list[str] | None = None, by_seq: bool = False) -> DataFrame:
    """Target after inserting or overwriting by ``keys``; the last source row by ``seq`` wins, and the columns in
    ``keep`` (first-seen stamps) stay as they were in the target. Columns the target lacks are dropped.

    With ``by_seq`` a target row of a higher ``seq`` wins over a late source row."""
    keep = keep or []
    order = [seq, "_side"] if by_seq else ["_side", seq]
    cols = [c for c in target.columns]
    old = target.select(*cols, F.lit(0).alias("_side"))
    new = source.select(*[F.col(c) if c in source.columns else F.lit(None).alias(c) for c in cols], F.lit(1).alias("_side"))
    both = old.unionByName(new)
    rest = [c for c in cols if c not in keys]
    # one struct for order and values: `seq` is kept and shuffled once, not once in each
    ordered = lambda values: F.struct(*order, *[c for c in values if c != seq])
    newest, first = F.max(ordered(rest)), F.min(ordered(keep))
    if any(isinstance(both.schema[c].dataType, UNORDERED) for c in rest):
        newest, first = F.max_by(ordered(rest), F.struct(*order)), F.min_by(ordered(keep), F.struct(*order))
    grouped = both.groupBy(*keys).agg(newest.alias("_r"), *([first.alias("_k")] if keep else []))
    return grouped.select(*[F.col(c) if c in keys else (F.col(f"_k.{c}") if c in keep else F.col(f"_r.{c}")).alias(c) for c in cols])


def log_price_history(products: DataFrame, seq: str = "id") -> DataFrame:
    """One price row per product and day; within a day the last observation stays."""
    day = F.to_date("scraped_at")
    fields = ["dispensary_id", "sale_price", "original_price", "discount_percent", "brand", "category", "weight_value", "deal_score"]
    present = [f for f in fields if f in products.columns]
    rows = products.groupBy("product_id", day.alias("observed_date")).agg(
        F.max_by(F.struct(*present), F.struct("scraped_at", seq)).alias("r"))
    return rows.select("product_id", "observed_date", *[F.col(f"r.{f}").alias(f) for f in present])


def merge_deal_observations(history: DataFrame, observations: DataFrame, attributes: list[str], seq: str) -> DataFrame:
    """History after a batch: every observation of a key adds one to ``times_seen``, the last one sets the rest."""
    keys = ["product_id", "dispensary_id"]
    old = history.select(*keys, *attributes, "first_seen", "last_seen", "is_active", "times_seen",
                         F.lit(0).alias("_side"), F.lit("").alias("_seq"))
    new = observations.select(*keys, *attributes, F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
                              F.lit(True).alias("is_active"), F.lit(1).cast("long").alias("times_seen"),
                              F.lit(1).alias("_side"), F.col(seq).cast("string").alias("_seq"))
    rest = [*attributes, "last_seen", "is_active"]
    at = F.struct("_side", "last_seen", "_seq")
    g = old.unionByName(new).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), at).alias("r"), F.min_by("first_seen", at).alias("first_seen"), F.sum("times_seen").alias("times_seen"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "first_seen", "times_seen")


def _mark(df: DataFrame, slugs: DataFrame | None, name: str) -> DataFrame:
    """Adds ``name``: does the row belong to a listed store (all stores when no list is given)."""
    if slugs is None:
        return df.withColumn(name, F.lit(True))
    listed = slugs.select(F.col("slug").alias("dispensary_id")).distinct().withColumn(name, F.lit(True))
    return df.join(listed, "dispensary_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def expire_history(history: DataFrame, as_of: str, slugs: DataFrame | None = None) -> DataFrame:
    """Active rows last seen before today become inactive, for the given stores only."""
    cols = history.columns
    stale = F.col("is_active") & (F.to_date("last_seen") < F.lit(as_of[:10]).cast("date")) & F.col("_mine")
    return _mark(history, slugs, "_mine").withColumn("is_active", F.col("is_active") & ~stale).select(*cols)


def deactivate_products(products: DataFrame, as_of: str, slugs: DataFrame | None, disabled: DataFrame) -> DataFrame:
    """Listings scraped before today become inactive; active ones of disabled stores also lose their score."""
    cols = products.columns
    df = _mark(_mark(products, slugs, "_mine"), disabled, "_off")
    old = F.col("is_active") & F.col("_mine") & (F.col("scraped_at") < F.lit(as_of[:10]).cast("date").cast("timestamp_ntz"))
    # the second step sees the rows the first step left active
    orphan = F.col("is_active") & ~old & F.col("_off")
    return df.withColumn("deal_score", F.when(orphan, F.lit(0)).otherwise(F.col("deal_score"))).withColumn(
        "is_active", F.col("is_active") & ~old & ~orphan).select(*cols)


def retention_cutoffs(as_of: str) -> dict[str, Column]:
    now = F.lit(as_of).cast("timestamp_ntz")
    old = lambda days: now - F.expr(f"INTERVAL '{days}' DAY")
    return {"user_events": F.col("created_at") < old(180), "analytics_events": F.col("created_at") < old(180),
            "shared_saves": F.col("expires_at").isNotNull() & (F.col("expires_at") < now), "scrape_runs": F.col("started_at") < old(90)}


def apply_retention(tables: dict[str, DataFrame], as_of: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Kept rows per table and a report (table_name, rows_deleted)."""
    rules = retention_cutoffs(as_of)
    kept = {n: df.filter(~F.coalesce(rules[n], F.lit(False))) for n, df in tables.items()}
    report = [df.agg(F.coalesce(F.sum(flag(rules[n])), F.lit(0)).alias("rows_deleted")).select(F.lit(n).alias("table_name"), "rows_deleted")
              for n, df in tables.items()]
    return kept, reduce(DataFrame.unionByName, report)


def save_counts(saves: DataFrame) -> DataFrame:
    return saves.select("deal_id", "user_id").distinct().groupBy("deal_id").agg(F.count("*").alias("save_count"))


def with_save_count(deals: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    out = deals.join(counts.select(F.col("deal_id").alias(key), "save_count"), key, "left")
    return out.withColumn("save_count", F.coalesce("save_count", F.lit(0)))


def top_saved(counts: DataFrame, catalog: DataFrame, n: int = 10) -> DataFrame:
    """Most saved offers with name and brand; unknown ids keep their row."""
    best = top_n_counts(counts, n)
    return best.join(catalog.select(F.col("id").alias("deal_id"), "name", "brand"), "deal_id", "left")


def top_n_counts(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.col("save_count").desc(), "deal_id").limit(n)


def shared_list_expand(shares: DataFrame, catalog: DataFrame, as_of: str) -> DataFrame:
    """Offers of every share that has not expired, in list order; unknown ids and unusable rows fall out."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = shares.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    items = live.select(F.col("id").alias("share_id"), F.posexplode("deal_ids").alias("position", "deal_id"))
    usable = catalog.filter((F.coalesce("name", F.lit("")) != "") & (F.col("sale_price") > 0))
    return items.join(usable, items["deal_id"] == usable["id"]).select(
        "share_id", F.col("position").cast("long").alias("position"), "deal_id", "name", "sale_price")


def match_deals_to_products(deals: DataFrame, products: DataFrame, seq: str = "id") -> DataFrame:
    """Product id per offer by (name, price), NULL-safe; with equal keys the last product wins."""
    last = products.groupBy("name", "sale_price").agg(F.max_by("id", seq).alias("product_id"))
    cond = deals["name"].eqNullSafe(last["name"]) & deals["sale_price"].eqNullSafe(last["sale_price"])
    return deals.join(last, cond, "left").select(*[deals[c] for c in deals.columns], "product_id")


def expired_saves(saves: DataFrame, current: DataFrame, snapshots: DataFrame, history: DataFrame, keep: int = 200) -> DataFrame:
    """Saves whose offer is gone: already archived, archived now (snapshot exists) or kept without a snapshot.

    Newly archived rows are limited to the newest ``keep`` per user.
    """
    key = ["user_id", "deal_id"]
    gone = saves.join(current.select(F.col("id").alias("deal_id")), "deal_id", "left_anti")
    out = gone.join(history.select(*key).distinct().withColumn("_arch", F.lit(True)), key, "left").join(
        snapshots.select(*key).distinct().withColumn("_snap", F.lit(True)), key, "left")
    status = F.when(F.col("_arch"), "already_archived").when(F.col("_snap"), "archived").otherwise("kept")
    out = out.withColumn("status", status).drop("_arch", "_snap")
    fresh = top_per_group(out.filter("status = 'archived'"), ["user_id"], ["saved_at desc", "deal_id"], keep)
    return fresh.unionByName(out.filter("status <> 'archived'"))


def report_summary(reports: DataFrame) -> DataFrame:
    """Open reports per offer by kind, with first and last time."""
    kind = lambda v: F.sum(flag(F.col("report_type") == v))
    keys = ["deal_id", "product_name", "dispensary_name", "brand_name", "deal_price"]
    return reports.filter(~F.col("reviewed")).groupBy(*keys).agg(
        F.count("*").alias("report_count"), kind("wrong_price").alias("wrong_price_count"), kind("deal_gone").alias("deal_gone_count"),
        kind("wrong_product").alias("wrong_product_count"), F.min("created_at").alias("first_reported"), F.max("created_at").alias("last_reported"))


def flagged_deals(reports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reported offers with the present state of the product; open ones first, most reports first."""
    kind = lambda v: F.sum(flag(F.col("report_type") == v))
    g = reports.groupBy("deal_id").agg(
        F.count("*").alias("report_count"), kind("wrong_price").alias("wrong_price_count"), kind("deal_gone").alias("deal_gone_count"),
        kind("wrong_product").alias("wrong_product_count"), (F.min(flag(F.col("reviewed"))) == 1).alias("reviewed"))
    p = catalog.select(F.col("id").alias("deal_id"), F.col("name").alias("current_name"), "is_active")
    return g.join(p, "deal_id", "left")
