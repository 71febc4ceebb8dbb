"""Composed jobs against their parts on the smallest tables."""

from pyspark.sql import functions as F

from leafmart import bridge
from leafmart.operators import catalog, engagement, listings, selection
from leafmart.operators import runs as run_rows
from leafmart.plans import daily
from leafmart.registry import texts

SF = "/root/testdata/sf0.001"


def test_daily_run(spark):
    raw = bridge.view(spark, SF, "raw_listings").filter("run_date < DATE '1995-06-01'")
    stores, terms = bridge.view(spark, SF, "dispensaries"), texts.terms(spark, SF)
    out = daily.daily_run(raw, terms, stores)
    parsed = out["parsed"].cache()
    assert 0 < parsed.count() <= raw.count() and set(parsed.columns) >= {"id", "name", "brand", "category", "sale_price"}
    direct = listings.parse_listings(listings.with_default_platform(raw, stores), terms)
    assert sorted(r["id"] for r in direct.select("id").collect()) == sorted(r["id"] for r in parsed.select("id").collect())
    offers, report = out["offers"].cache(), {r["dispensary_id"]: r for r in out["report"].collect()}
    per_store = {r["dispensary_id"]: r["n"] for r in offers.groupBy("dispensary_id").agg(F.count("*").alias("n")).collect()}
    assert {s: r["selected"] for s, r in report.items() if r["selected"]} == per_store
    assert sum(r["total"] for r in report.values()) == parsed.count()
    assert out["unmatched"].columns == ["name", "n_stores"]


def test_weekly_enrichment_and_dashboard(spark):
    products = bridge.view(spark, SF, "products")
    week = daily.weekly_enrichment(products, "2001-08-01")
    kinds = {r["snapshot_type"] for r in week["snapshots"].select("snapshot_type").distinct().collect()}
    assert kinds == {"price_distribution", "brand_pricing"} and week["caps"].count() > 0 and week["cross_region"].columns[0] == "brand"
    events = bridge.view(spark, SF, "analytics_events")
    runs = run_rows.runs_with_sites(bridge.view(spark, SF, "scrape_runs"), bridge.view(spark, SF, "run_sites"))
    from leafmart.registry.common import EVENTS_AS_OF, scored

    board = daily.dashboard(events, scored(spark, SF), runs, EVENTS_AS_OF)
    assert sorted(map(str, board["growth"].collect())) == sorted(map(str, engagement.growth(events, EVENTS_AS_OF, 30).collect()))
    assert all(df.columns for df in board.values())


def test_top_names(spark):
    rows = [("d", "r", n) for n, k in (("b", 3), ("a", 3), ("c", 9)) for _ in range(k)] + [("d", "s", f"n{i:02d}") for i in range(30)]
    got = {r["region"]: r["top_names"] for r in catalog.top_names(spark.createDataFrame(rows, "run_date string, region string, name string"), ["run_date", "region"], "name").collect()}
    assert got == {"r": ["c", "a", "b"], "s": [f"n{i:02d}" for i in range(20)]}


def test_selection_and_detection_agree(spark):
    """Selected offers of the whole job are those of the selection over what the gates and duplicate rules leave."""
    products = bridge.view(spark, SF, "products")
    flags = selection.detect_deals(products, ["dispensary_id"]).cache()
    chosen = flags.filter("display_rank IS NOT NULL")
    assert chosen.filter("is_kept = 0 OR is_selected = 0").count() == 0
    assert flags.filter("is_kept = 1 AND is_passed = 0").count() == 0 and flags.select("id").distinct().count() == flags.count()
