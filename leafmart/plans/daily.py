"""Jobs composed of the operators: the daily run, the weekly enrichment and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.operators import catalog, engagement, listings, maintenance, prices, runs, selection
from leafmart.session import cut_lineage


def daily_run(raw: DataFrame, terms: DataFrame, stores: DataFrame, dynamic_caps: DataFrame | None = None,
              tiers: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Cards of one day to parsed listings, selected offers and the per-store report."""
    cards = listings.with_default_platform(raw, stores)
    parsed = cut_lineage(listings.parse_listings(cards, terms))
    placed = parsed.join(stores.select(F.col("id").alias("dispensary_id"), "region"), "dispensary_id", "left") if "region" not in parsed.columns else parsed
    staged = cut_lineage(selection.detect_deals(placed, ["dispensary_id"], dynamic_caps, tiers))
    return {"parsed": parsed, "offers": staged.filter("is_selected = 1"), "report": catalog.site_funnel_report(staged, ["dispensary_id"]),
            "unmatched": listings.unmatched_candidates(parsed)}


def weekly_enrichment(products: DataFrame, snapshot_date: str) -> dict[str, DataFrame]:
    snapshots = prices.enrichment_snapshots(products, snapshot_date)
    return {"snapshots": snapshots, "caps": prices.price_cap_recommendations(products),
            "cross_region": prices.cross_region_brands(snapshots.filter("snapshot_type = 'brand_pricing'"))}


def dashboard(events: DataFrame, scored: DataFrame, run_rows: DataFrame, as_of: str, days: int = 30) -> dict[str, DataFrame]:
    return {"growth": engagement.growth(events, as_of, days), "daily_visitors": engagement.daily_visitors(events, as_of, days),
            "retention_7d": engagement.retention_rate(events, as_of, 7), "retention_30d": engagement.retention_rate(events, as_of, 30),
            "engagement": engagement.engagement(events, as_of, days), "cohorts": engagement.weekly_cohorts(events, as_of),
            "health": runs.scrape_health(run_rows, scored, events, as_of), "coverage": runs.coverage_by_region(run_rows, as_of)}


def refresh_save_counts(saves: DataFrame, path: str) -> DataFrame:
    from leafmart.sources.sinks import materialize

    return materialize(maintenance.save_counts(saves), path, "deal_save_counts")
