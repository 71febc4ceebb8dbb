"""Scrape run health and site coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions.numbers import count_if, flag, js_pct, js_round
from leafmart.functions.pricing import strip_shard_sql
from leafmart.operators.ranking import top_n, top_per_group


def runs_with_sites(runs: DataFrame, run_sites: DataFrame) -> DataFrame:
    """Adds the arrays ``sites_scraped`` and ``sites_failed`` (empty where a run has none)."""
    sites = run_sites.groupBy("run_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("slug")))).alias("sites_scraped"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("slug")))).alias("sites_failed"))
    none = F.array().cast("array<string>")
    out = runs.join(sites, runs["id"] == sites["run_id"], "left").drop("run_id")
    return out.withColumns({c: F.coalesce(c, none) for c in ("sites_scraped", "sites_failed")})


def ago(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY")


def _success(df: DataFrame) -> Column:
    """Percent of sites that worked in a run as an exact decimal, 100 for a run without sites."""
    ok, failed = F.size("sites_scraped").cast("decimal(10,0)"), F.size("sites_failed").cast("decimal(10,0)")
    return F.when(ok + failed > 0, ok * 100 / (ok + failed)).otherwise(F.lit(100)).cast("decimal(20,12)")


def finished() -> Column:
    return F.col("status").isin(L.FINISHED_STATUSES)


def latest_runs(runs: DataFrame, n: int, by_region: bool = True) -> DataFrame:
    """Newest runs per market or overall."""
    keyed = runs.withColumn("base_region", strip_shard_sql(F.col("region")))
    order = ["started_at desc", "id desc"]
    return top_per_group(keyed, ["base_region"], order, n) if by_region else top_n(keyed, order, n)


def scrape_health(runs: DataFrame, products: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Dashboard line: active offers, listings, live markets, success of the last 15 runs, last run and shares."""
    p = products.agg(count_if(F.col("is_active") & (F.col("deal_score") > 0)).alias("total_deals_active"),
                     F.count("*").alias("total_products"))
    live = runs.filter(F.col("started_at") >= ago(as_of, 7)).select(strip_shard_sql(F.col("region")).alias("r")).distinct().agg(
        F.count("*").alias("states_live"))
    last = runs.agg(F.max("started_at").alias("last_run"))
    recent = top_n(runs.filter(finished()), ["started_at desc", "id desc"], 15)
    success = recent.agg(F.round(F.avg(_success(recent)), 0).cast("double").alias("scraper_success"))
    shares = events.filter(F.col("event_name").isin(L.SHARE_EVENTS)).agg(F.count("*").alias("total_shares"))
    out = p.withColumn("_k", F.lit(1))
    for part in (live, last, success, shares):
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.select("total_deals_active", "total_products", F.col("total_products").alias("deals_total"), "states_live",
                      F.coalesce("scraper_success", F.lit(0.0)).alias("scraper_success"),
                      F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "total_shares")


def coverage_by_region(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= ago(as_of, days)).withColumn("base_region", strip_shard_sql(F.col("region")))
    return recent.groupBy("base_region").agg(
        F.sum(F.size("sites_scraped")).alias("sites_ok"), F.sum("total_products").alias("products"),
        F.round(F.avg(_success(recent)), 0).cast("double").alias("success_rate"),
        F.date_format(F.max("started_at"), "yyyy-MM-dd HH:mm:ss").alias("last_run"))


def region_unique_products(scored: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Distinct listings and offers per region seen in the window; ids are made unique first, then counted."""
    seen = scored.filter(F.col("scraped_at") >= ago(as_of, days)).groupBy("region", "id").agg(
        F.max(flag(F.col("deal_score") > 0)).alias("d"))
    return seen.groupBy("region").agg(F.count("*").alias("unique_products"), F.sum("d").alias("unique_deals"))


def listed_base_region(region: Column) -> Column:
    base = F.regexp_replace(region, "-[0-9]+$", "")
    return F.when(region.rlike("^.+-[0-9]+$") & base.isin(L.SHARDED_REGIONS), base).otherwise(region)


def region_site_coverage(runs: DataFrame, stores: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = runs.filter((F.col("started_at") >= ago(as_of, days)) & finished())
    slugs = recent.select(listed_base_region(F.col("region")).alias("r"), F.explode("sites_scraped").alias("slug")).distinct()
    known = slugs.join(stores.select(F.col("id").alias("slug")), "slug", "left_semi")
    scraped = known.groupBy("r").agg(F.count("*").alias("scraped"))
    sites = stores.groupBy("region").agg(F.count("*").alias("total_sites"), count_if(F.col("is_active")).alias("active_sites"))
    return sites.join(scraped, sites["region"] == scraped["r"], "left").select(
        "region", "total_sites", "active_sites", F.coalesce("scraped", F.lit(0)).alias("scraped_sites"))


def platform_summary(stores: DataFrame, scored: DataFrame, failed: DataFrame) -> DataFrame:
    """Sites, working sites, listings and offers per platform; ``failed`` holds the slugs that failed."""
    per_store = scored.groupBy("dispensary_id").agg(F.count("*").alias("p"), count_if(F.col("deal_score") > 0).alias("d"))
    ok = stores.join(failed.select(F.col("slug").alias("id")).distinct().withColumn("_bad", F.lit(1)), "id", "left").withColumn(
        "ok", flag(F.col("_bad").isNull()))
    j = ok.join(per_store, ok["id"] == per_store["dispensary_id"], "left")
    return j.groupBy("platform").agg(F.count("*").alias("sites"), F.sum("ok").alias("sites_ok"),
                                     F.sum(F.when(F.col("ok") == 1, F.coalesce("p", F.lit(0))).otherwise(0)).alias("products"),
                                     F.sum(F.when(F.col("ok") == 1, F.coalesce("d", F.lit(0))).otherwise(0)).alias("deals"))


def run_rollup(runs: DataFrame, as_of: str, shards: dict[str, int] | None = None) -> DataFrame:
    """Per market: success of the last 7 runs, mean runtime, today's distinct sites (failed minus later successes),
    listings, offers and shards that ran of those expected."""
    d0 = F.lit(as_of[:10]).cast("date")
    last7 = latest_runs(runs, 7)
    week = last7.groupBy("base_region").agg(
        F.count("*").alias("n7"), count_if(finished()).alias("ok7"),
        F.sum(F.when(finished(), F.coalesce("runtime_seconds", F.lit(0)))).alias("_rt"), F.sum("total_products").alias("products_last7"))
    today = runs.withColumn("base_region", strip_shard_sql(F.col("region"))).filter(
        (F.to_date("started_at") >= d0) & finished())
    day = today.groupBy("base_region").agg(
        F.count("*").alias("runs_today"), F.sum("total_products").alias("products_today"), F.sum("qualifying_deals").alias("deals_today"),
        F.size(F.collect_set("region")).cast("long").alias("shards_ran"))
    good = today.select("base_region", F.explode("sites_scraped").alias("slug")).distinct()
    bad = today.select("base_region", F.explode("sites_failed").alias("slug")).distinct().join(good, ["base_region", "slug"], "left_anti")
    n_good, n_bad = (x.groupBy("base_region").agg(F.count("*").alias(n)) for x, n in ((good, "sites_ok_today"), (bad, "sites_failed_today")))
    out = week.join(day, "base_region", "left").join(n_good, "base_region", "left").join(n_bad, "base_region", "left")
    counts = ["runs_today", "products_today", "deals_today", "shards_ran", "sites_ok_today", "sites_failed_today"]
    out = out.na.fill(0, counts)
    expected = F.lit(1)
    for region, n in (shards or {}).items():
        expected = F.when(F.col("base_region") == region, F.lit(n)).otherwise(expected)
    return out.select("base_region", "products_last7", js_pct(F.col("ok7"), F.col("n7")).alias("success7"),
                      F.coalesce(js_round(F.col("_rt").cast("double") / F.when(F.col("ok7") > 0, F.col("ok7"))), F.lit(0)).alias("avg_runtime7"),
                      *counts, expected.cast("long").alias("shards_expected"))


def missing_shards(runs: DataFrame, as_of: str, shards: dict[str, int]) -> DataFrame:
    """Shard names expected today without a run."""
    spark = runs.sparkSession
    wanted = spark.createDataFrame([(f"{r}-{i}",) for r, n in shards.items() for i in range(1, n + 1)], "region string")
    ran = runs.filter((F.to_date("started_at") >= F.lit(as_of[:10]).cast("date"))
                      & F.col("status").isin([*L.FINISHED_STATUSES, "running"])).select("region").distinct()
    return wanted.join(ran, "region", "left_anti")


def failed_minus_succeeded(runs: DataFrame) -> DataFrame:
    """Sites of a market and day that failed in one shard and worked in none."""
    keyed = runs.withColumn("base_region", strip_shard_sql(F.col("region"))).withColumn("day", F.to_date("started_at"))
    keys = ["base_region", "day", "slug"]
    good = keyed.select("base_region", "day", F.explode("sites_scraped").alias("slug")).distinct()
    bad = keyed.select("base_region", "day", F.explode("sites_failed").alias("slug")).distinct()
    return bad.join(good, keys, "left_anti")


