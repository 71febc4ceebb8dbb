"""Listing audits, quality reports and browse counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions.pricing import badge
from leafmart.operators import catalog as c
from leafmart.operators import ranking
from leafmart.registry import oracle as o
from leafmart.registry.common import PRODUCTS_AS_OF as NOW
from leafmart.registry.common import day_text, judged, products, scored, view
from leafmart.session import cut_lineage

QUERIES, ORACLES = {}, {}
TODAY = f"DATE '{NOW[:10]}'"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


def live(s, d):
    return scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0))


def kept(s, d):
    """Stand-in for the day's selected offers: one offer per name, brand and category of a day and region."""
    return day_offers(judged(s, d))


def day_offers(rows):
    return ranking.dedup_global_name(rows.filter(F.col("passed") & F.col("strict_ok")), ["run_date", "region"])


register("volume_audit", lambda s, d: c.volume_audit(products(s, d)), """
SELECT 'region' AS level, region, '' AS category, '' AS platform, COUNT(*) AS n FROM v_products WHERE is_active GROUP BY region
UNION ALL SELECT 'category', '', category, '', COUNT(*) FROM v_products WHERE is_active GROUP BY category
UNION ALL SELECT 'platform', '', '', source_platform, COUNT(*) FROM v_products WHERE is_active GROUP BY source_platform
UNION ALL SELECT 'region_category', region, category, '', COUNT(*) FROM v_products WHERE is_active GROUP BY region, category""")
_rate = o.ratio("COUNT(brand)", "COUNT(*)", 4)
register("brand_detection_audit", lambda s, d: c.brand_detection_audit(products(s, d)), f"""
SELECT region, '' AS category, COUNT(*) AS total, COUNT(brand) AS branded, COUNT(*) - COUNT(brand) AS unbranded, {_rate} AS rate FROM v_products WHERE is_active GROUP BY region
UNION ALL SELECT '', category, COUNT(*), COUNT(brand), COUNT(*) - COUNT(brand), {_rate} FROM v_products WHERE is_active GROUP BY category""")


def _daily_unmatched(s, d):
    words = F.split("text", r"\s+")
    return view_documents(s, d).select(F.col("source").alias("region"), F.to_json(words).alias("names"),
                                       F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("run_date"))


def view_documents(s, d):
    from leafmart.bridge import base_table

    return base_table(s, d, "documents")


register("unmatched_brand_frequency", lambda s, d: c.unmatched_brand_frequency(_daily_unmatched(s, d), "2024-01-31", 20), """
SELECT name, COUNT(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS name, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS rd FROM documents) x
WHERE rd >= DATE '2024-01-31' - 20 AND length(name) >= 3 GROUP BY name ORDER BY n DESC, name LIMIT 50""")
_susp = {
    "sale_gt_original": "sale_price > original_price", "zero_weight": "weight_value = 0", "extreme_discount_high": "discount_percent > 80",
    "extreme_discount_low": "original_price > 0 AND discount_percent > 0 AND discount_percent < 5", "missing_category": "category IS NULL",
    "missing_name": "length(name) < 3", "very_low_price": "sale_price > 0 AND sale_price < 1", "very_high_price": "sale_price > 200"}
register("suspicious_data_audit", lambda s, d: c.suspicious_data(products(s, d)), " UNION ALL ".join(
    f"SELECT {o.q(n)} AS check_name, COUNT(*) FILTER (WHERE {w}) AS n FROM v_products WHERE is_active" for n, w in _susp.items()))
register("suspicious_examples", lambda s, d: c.suspicious_examples(products(s, d)), " UNION ALL ".join(
    f"SELECT * FROM (SELECT {o.q(n)} AS check_name, id, substr(name, 1, 40) AS name FROM v_products WHERE is_active AND {_susp[n]} ORDER BY id LIMIT 3) t{i}"
    for i, n in enumerate(["extreme_discount_low", "very_high_price", "sale_gt_original", "extreme_discount_high"])))


def _metrics(s, d):
    rows = cut_lineage(judged(s, d).select("run_date", "region", "id", "name", "brand", "category", "dispensary_id", "deal_score", "passed", "cap_failed", "strict_ok"))
    return c.daily_metrics(day_offers(rows), rows)


_dm_counts = ", ".join(f"COUNT(*) FILTER (WHERE category = '{k}') AS {k}_count" for k in ("flower", "vape", "edible", "concentrate", "preroll"))
o.EXTRA["o_kept"] = """SELECT * FROM (SELECT * FROM o_strict QUALIFY row_number() OVER (PARTITION BY run_date, region, o_key, lower(COALESCE(brand, '')), category
  ORDER BY deal_score DESC, id) = 1) k"""
from leafmart.registry.offers import _key as _dedup_key  # noqa: E402

o.EXTRA["o_kept"] = o.EXTRA["o_kept"].replace("o_key", _dedup_key)
o.EXTRA["o_metrics"] = f"""
SELECT t.run_date, t.region, total_products, brand_null_count, price_cap_reject_count, COALESCE(qualifying_deals, 0) AS qualifying_deals,
  {', '.join(f'COALESCE({k}_count, 0) AS {k}_count' for k in ('flower', 'vape', 'edible', 'concentrate', 'preroll'))},
  COALESCE(min_deal_score, 0) AS min_deal_score, COALESCE(max_deal_score, 0) AS max_deal_score, COALESCE(steal_count, 0) AS steal_count,
  COALESCE(fire_count, 0) AS fire_count, COALESCE(solid_count, 0) AS solid_count, COALESCE(median_deal_score, 0) AS median_deal_score,
  COALESCE(unique_brands, 0) AS unique_brands, COALESCE(unique_dispensaries, 0) AS unique_dispensaries, COALESCE(avg_deal_score, 0) AS avg_deal_score,
  {o.ratio_even('total_products - brand_null_count', 'total_products', 1, 100)} AS brand_detection_rate,
  {o.ratio_even('price_cap_reject_count', 'total_products', 1, 100)} AS price_cap_reject_rate
FROM (SELECT run_date, region, COUNT(*) AS total_products, COUNT(*) FILTER (WHERE brand IS NULL) AS brand_null_count,
        COUNT(*) FILTER (WHERE NOT passed AND cap_failed) AS price_cap_reject_count FROM o_judged GROUP BY ALL) t
LEFT JOIN (SELECT run_date, region, COUNT(*) AS qualifying_deals, {_dm_counts}, CAST(MIN(deal_score) AS BIGINT) AS min_deal_score, CAST(MAX(deal_score) AS BIGINT) AS max_deal_score,
    COUNT(*) FILTER (WHERE deal_score >= 85) AS steal_count, COUNT(*) FILTER (WHERE deal_score BETWEEN 70 AND 84) AS fire_count,
    COUNT(*) FILTER (WHERE deal_score BETWEEN 50 AND 69) AS solid_count, CAST(floor(median(deal_score)) AS BIGINT) AS median_deal_score,
    COUNT(DISTINCT brand) AS unique_brands, COUNT(DISTINCT dispensary_id) AS unique_dispensaries, {o.ratio_even('CAST(SUM(deal_score) AS BIGINT)', 'COUNT(*)', 2)} AS avg_deal_score
    FROM o_kept GROUP BY ALL) k ON k.run_date = t.run_date AND k.region = t.region"""
register("daily_metrics", lambda s, d: _metrics(s, d).withColumn("run_date", day_text("run_date")),
         "SELECT * REPLACE (strftime(run_date, '%Y-%m-%d') AS run_date) FROM o_metrics")
register("cap_reject_trend", lambda s, d: c.cap_reject_trend(_metrics(s, d).filter(F.col("run_date") <= NOW[:10]), NOW).withColumn("run_date", day_text("run_date")), f"""
SELECT region, strftime(run_date, '%Y-%m-%d') AS run_date, price_cap_reject_count, price_cap_reject_rate, brand_detection_rate, total_products FROM o_metrics
WHERE run_date <= {TODAY} AND run_date >= {TODAY} - 14 QUALIFY row_number() OVER (PARTITION BY region ORDER BY run_date DESC) = 1""")
register("table_status", lambda s, d: c.table_status({n: view(s, d, n) for n in ("dispensaries", "products", "scrape_runs", "user_contacts")}), " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows, COUNT(*) > 0 AS has_data FROM v_{n}" for n in ("dispensaries", "products", "scrape_runs", "user_contacts")))
register("health_status", lambda s, d: c.health_status(scored(s, d)), """
SELECT *, CASE WHEN deals = 0 THEN 'down' WHEN deals < 50 OR edibles < 5 OR prerolls < 3 THEN 'degraded' ELSE 'healthy' END AS status FROM (
  SELECT COUNT(*) AS deals, COUNT(*) FILTER (WHERE category = 'edible') AS edibles, COUNT(*) FILTER (WHERE category = 'preroll') AS prerolls FROM o_live) x""")
register("day_over_day_by_store", lambda s, d: c.day_over_day_by_store(scored(s, d), NOW), f"""
SELECT COALESCE(source_platform, '(all)') AS platform, COALESCE(dispensary_id, '(all)') AS store, COUNT(*) FILTER (WHERE run_date < {TODAY}) AS products_yesterday,
  COUNT(*) FILTER (WHERE run_date < {TODAY} AND deal_score > 0) AS deals_yesterday, COUNT(*) FILTER (WHERE run_date = {TODAY}) AS products_today,
  COUNT(*) FILTER (WHERE run_date = {TODAY} AND deal_score > 0) AS deals_today
FROM o_scored WHERE run_date BETWEEN {TODAY} - 1 AND {TODAY} GROUP BY ROLLUP (source_platform, dispensary_id)""")
register("brand_leaderboard", lambda s, d: c.brand_leaderboard(live(s, d)), """
SELECT COALESCE(brand, 'Unknown') AS brand, COUNT(*) AS n_deals, COUNT(DISTINCT dispensary_id) AS n_stores FROM o_live GROUP BY 1 ORDER BY n_deals DESC, brand LIMIT 15""")
_goals = ", ".join(f"('{b}', {t}, {L.CATEGORY_MINIMUMS[b]})" for b, t in L.CATEGORY_TARGETS.items())
register("category_distribution", lambda s, d: c.category_distribution(live(s, d)), f"""
SELECT g.bucket, CAST(g.target AS BIGINT) AS target, CAST(g.minimum AS BIGINT) AS minimum, COALESCE(p.n, 0) AS actual, COALESCE(p.n, 0) < g.minimum AS under_minimum
FROM (VALUES {_goals}) g(bucket, target, minimum) LEFT JOIN (SELECT bucket, COUNT(*) AS n FROM o_pool GROUP BY bucket) p ON p.bucket = g.bucket""")
register("subtype_breakdown", lambda s, d: c.subtype_breakdown(products(s, d)), f"""
SELECT COALESCE(brand, 'Unknown') AS brand, {', '.join(f"COUNT(*) FILTER (WHERE COALESCE(product_subtype, 'unclassified') = '{t}') AS {t}" for t in ('disposable', 'cartridge', 'pod', 'unclassified'))}
FROM v_products WHERE is_active AND category = 'vape' GROUP BY 1""")
register("miscategorised_vapes", lambda s, d: c.miscategorised_vapes(view(s, d, "raw_listings").withColumn("is_active", F.lit(True)).withColumn("category", F.col("scraped_category"))).select("id"), """
SELECT id FROM v_raw_listings WHERE scraped_category <> 'vape' AND regexp_matches(name, '\\b(?:disposable|all[- ]?in[- ]?one|aio|cart|cartridge|pod|vape|pen)\\b', 'i')""")
register("browse_brands", lambda s, d: c.browse_brands(live(s, d)),
         "SELECT brand, COUNT(*) AS n_deals, upper(substr(brand, 1, 1)) AS letter FROM o_live WHERE COALESCE(brand, '') <> '' GROUP BY brand")
register("browse_stores", lambda s, d: c.browse_stores(view(s, d, "dispensaries"), live(s, d)), """
SELECT *, row_number() OVER (PARTITION BY region ORDER BY n_deals DESC, name, id) AS position, upper(substr(name, 1, 1)) AS letter FROM (
  SELECT v.id, v.name, v.region, COUNT(l.id) AS n_deals FROM v_dispensaries v LEFT JOIN o_live l ON l.dispensary_id = v.id
  WHERE v.is_active AND NOT starts_with(v.id, 'zen-leaf') GROUP BY ALL) x""")
register("blocked_prefix_filter", lambda s, d: view(s, d, "dispensaries").filter(c.not_blocked(F.col("id"))).select("id"),
         "SELECT id FROM v_dispensaries WHERE NOT starts_with(id, 'zen-leaf')")
register("category_page_stats", lambda s, d: c.category_page_stats(live(s, d)), """
SELECT category, COUNT(*) AS n_deals, COUNT(DISTINCT dispensary_id) AS n_stores, MIN(sale_price) AS min_price, MAX(sale_price) AS max_price FROM o_live GROUP BY category""")
register("category_top_brands", lambda s, d: c.category_top_brands(live(s, d)), """
SELECT category, brand, COUNT(*) AS n_deals FROM o_live WHERE COALESCE(brand, '') <> '' GROUP BY category, brand
QUALIFY row_number() OVER (PARTITION BY category ORDER BY COUNT(*) DESC, brand) <= 8""")
_avg = f"{o.ratio('CAST(SUM(' + o.cents('sale_price') + ') AS BIGINT)', 'COUNT(*)', 0)} / 100"
register("quality_by_category", lambda s, d: c.quality_by_category(products(s, d)),
         f"SELECT category, COUNT(*) AS n, {_avg} AS avg_price, MIN(sale_price) AS min_price, MAX(sale_price) AS max_price FROM v_products WHERE is_active GROUP BY category")
register("quality_under_20", lambda s, d: c.quality_by_category(products(s, d), 20),
         f"SELECT category, COUNT(*) AS n, {_avg} AS avg_price, MIN(sale_price) AS min_price, MAX(sale_price) AS max_price FROM v_products WHERE is_active AND sale_price < 20 GROUP BY category")
register("quality_top_brands", lambda s, d: c.quality_top_brands(products(s, d)),
         "SELECT brand, COUNT(*) AS n FROM v_products WHERE is_active AND brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 30")
register("quality_shares", lambda s, d: c.quality_shares(products(s, d), view(s, d, "dispensaries")), f"""
WITH p AS (SELECT COUNT(*) AS total_active, COUNT(brand) AS has_brand, COUNT(DISTINCT dispensary_id) AS ns FROM v_products WHERE is_active),
g AS (SELECT COUNT(*) AS total_stores, COUNT(latitude) AS has_coordinates FROM v_dispensaries WHERE is_active)
SELECT total_active, has_brand, {o.ratio('has_brand', 'total_active', 1, 100)} AS brand_pct, total_stores, has_coordinates,
  {o.ratio('has_coordinates', 'total_stores', 1, 100)} AS geo_pct, {o.ratio('total_active', 'ns', 1)} AS avg_per_store FROM p, g""")
register("score_histogram", lambda s, d: c.score_histogram(scored(s, d)), """
SELECT CASE WHEN deal_score >= 85 THEN 'steal (85+)' WHEN deal_score >= 70 THEN 'fire (70-84)' WHEN deal_score >= 50 THEN 'solid (50-69)'
  WHEN deal_score > 0 THEN 'qualifying (1-49)' ELSE 'not_curated (0)' END AS tier, COUNT(*) AS n FROM o_scored WHERE is_active GROUP BY 1""")
register("store_group_stats",
         lambda s, d: c.store_group_stats(products(s, d), view(s, d, "dispensaries"), F.lower("address").contains("las vegas blvd") | F.col("address").rlike(r"(?i)\bstrip\b")), f"""
SELECT d.name AS store, d.address, COUNT(*) AS n, {_avg.replace('sale_price', 'p.sale_price')} AS avg_price, MIN(p.sale_price) AS cheapest, MAX(p.sale_price) AS dearest
FROM v_products p JOIN v_dispensaries d ON d.id = p.dispensary_id WHERE p.is_active AND (contains(lower(d.address), 'las vegas blvd') OR regexp_matches(d.address, '\\bstrip\\b', 'i')) GROUP BY ALL""")


def _staged(s, d):
    """Stage flags per listing, with the deduplicated offers as the selection."""
    keep = kept(s, d).select("id").withColumn("_sel", F.lit(1))
    df = judged(s, d).join(keep, "id", "left")
    one = lambda col: col.cast("long")
    return df.select("dispensary_id", "name", "deal_score", one(F.col("passed")).alias("is_passed"),
                     one(F.col("passed") & F.col("strict_ok")).alias("is_kept"), F.coalesce("_sel", F.lit(0)).cast("long").alias("is_selected"),
                     F.lit(0).cast("long").alias("is_guaranteed"), one(~F.col("passed") & F.col("cap_failed")).alias("is_cap_reject"))


register("site_funnel_report", lambda s, d: c.site_funnel_report(_staged(s, d), ["dispensary_id"]), """
SELECT dispensary_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE passed) AS passed, COUNT(*) FILTER (WHERE passed AND strict_ok) AS kept,
  COUNT(*) FILTER (WHERE sel) AS selected, CAST(0 AS BIGINT) AS guaranteed, COUNT(*) FILTER (WHERE NOT passed AND cap_failed) AS cap_rejects,
  COALESCE(CAST(MAX(deal_score) FILTER (WHERE passed AND strict_ok AND NOT sel) AS BIGINT), 0) AS best_cut_score,
  COALESCE(arg_max(name, (deal_score, name)) FILTER (WHERE passed AND strict_ok AND NOT sel), '') AS best_cut_name,
  CASE WHEN COUNT(*) FILTER (WHERE sel) > 0 THEN '' WHEN COUNT(*) FILTER (WHERE passed) = 0 THEN 'all ' || COUNT(*) || ' failed hard filters (price/discount/brand)'
    WHEN COUNT(*) FILTER (WHERE passed AND strict_ok) = 0 THEN COUNT(*) FILTER (WHERE passed) || ' passed filters but all failed quality gate'
    ELSE COUNT(*) FILTER (WHERE passed AND strict_ok) || ' scored but all cut during selection/dedup' END AS zero_reason
FROM (SELECT j.*, k.id IS NOT NULL AS sel FROM o_judged j LEFT JOIN o_kept k ON k.id = j.id) x GROUP BY dispensary_id""")
register("constraint_violations",
         lambda s, d: c.constraint_violations(scored(s, d), view(s, d, "dispensaries"), view(s, d, "scrape_runs"), view(s, d, "deal_reports"), view(s, d, "user_saved_deals"),
                                              view(s, d, "deal_catalog").filter("is_active")), f"""
SELECT 'products_category' AS rule, COUNT(*) FILTER (WHERE category NOT IN {o.values_in(L.CATEGORIES)}) AS n_bad FROM o_scored
UNION ALL SELECT 'products_deal_score', COUNT(*) FILTER (WHERE deal_score NOT BETWEEN 0 AND 100) FROM o_scored
UNION ALL SELECT 'products_sale_price', COUNT(*) FILTER (WHERE sale_price <= 0) FROM o_scored
UNION ALL SELECT 'products_original_price', COUNT(*) FILTER (WHERE original_price <= 0) FROM o_scored
UNION ALL SELECT 'products_discount_percent', COUNT(*) FILTER (WHERE discount_percent NOT BETWEEN 0 AND 100) FROM o_scored
UNION ALL SELECT 'products_weight_unit', COUNT(*) FILTER (WHERE weight_unit NOT IN ('g','mg','oz')) FROM o_scored
UNION ALL SELECT 'products_subtype', COUNT(*) FILTER (WHERE product_subtype NOT IN {o.values_in(L.SUBTYPES)}) FROM o_scored
UNION ALL SELECT 'products_strain_type', COUNT(*) FILTER (WHERE strain_type NOT IN ('Indica','Sativa','Hybrid')) FROM o_scored
UNION ALL SELECT 'products_name_length', COUNT(*) FILTER (WHERE length(trim(name)) < 3) FROM o_scored
UNION ALL SELECT 'stores_platform', COUNT(*) FILTER (WHERE platform NOT IN {o.values_in(L.PLATFORMS)}) FROM v_dispensaries
UNION ALL SELECT 'stores_region', COUNT(*) FILTER (WHERE region NOT IN {o.values_in(L.REGIONS)}) FROM v_dispensaries
UNION ALL SELECT 'runs_status', COUNT(*) FILTER (WHERE status NOT IN {o.values_in(L.RUN_STATUSES)}) FROM v_scrape_runs
UNION ALL SELECT 'runs_platform_group', COUNT(*) FILTER (WHERE platform_group NOT IN ('all','stable','new','test')) FROM v_scrape_runs
UNION ALL SELECT 'reports_type', COUNT(*) FILTER (WHERE report_type NOT IN {o.values_in(L.REPORT_TYPES)}) FROM v_deal_reports
UNION ALL SELECT 'fk_products_store', COUNT(*) FROM o_scored p WHERE NOT EXISTS (SELECT 1 FROM v_dispensaries d WHERE d.id = p.dispensary_id)
UNION ALL SELECT 'fk_reports_product', COUNT(*) FROM v_deal_reports r WHERE NOT EXISTS (SELECT 1 FROM v_deal_catalog c WHERE c.id = r.deal_id AND c.is_active)
UNION ALL SELECT 'fk_saves_product', COUNT(*) FROM v_user_saved_deals r WHERE NOT EXISTS (SELECT 1 FROM v_deal_catalog c WHERE c.id = r.deal_id AND c.is_active)""")
register("contact_stats", lambda s, d: c.contact_stats(view(s, d, "user_contacts")), """
SELECT COUNT(*) AS total, COUNT(phone) AS phones, COUNT(email) AS emails, COUNT(*) FILTER (WHERE source = 'saved_deals_banner') AS by_saved_deals,
  COUNT(*) FILTER (WHERE source = 'out_of_market') AS by_out_of_market, COUNT(*) FILTER (WHERE source = 'early_bird_banner') AS by_early_bird FROM v_user_contacts""")
register("freshness", lambda s, d: c.freshness(products(s, d).filter(F.col("scraped_at") <= F.lit(NOW).cast("timestamp_ntz")), "2001-08-01 15:00:00"), f"""
SELECT region, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, CAST(latest AS DATE) <> {TODAY} AS not_today,
  epoch(TIMESTAMP '2001-08-01 15:00:00') - epoch(latest) > 14 * 3600 AS is_stale
FROM (SELECT region, MAX(scraped_at) AS latest FROM v_products WHERE scraped_at <= TIMESTAMP '{NOW}' GROUP BY region) x""")
register("savings_totals", lambda s, d: c.savings_totals(view(s, d, "user_saved_deals").join(view(s, d, "deal_catalog").withColumnRenamed("id", "deal_id"), "deal_id")), f"""
SELECT s.user_id, CAST(SUM(CASE WHEN is_active THEN gain ELSE 0 END) AS BIGINT) / 100 AS potential, CAST(SUM(gain) AS BIGINT) / 100 AS lifetime, COUNT(*) AS n_saved
FROM v_user_saved_deals s JOIN (SELECT *, CASE WHEN original_price > sale_price THEN {o.cents('original_price')} - {o.cents('sale_price')} ELSE 0 END AS gain FROM v_deal_catalog) c
  ON c.id = s.deal_id GROUP BY s.user_id""")
register("display_columns", lambda s, d: scored(s, d).select(
    "id", c.js_discount(F.col("original_price"), F.col("sale_price")).alias("discount"), c.price_tier(F.col("sale_price")).alias("tier"),
    F.coalesce(badge(F.col("deal_score")), F.lit("")).alias("badge"),
    (F.col("deal_score") >= 70).alias("verified")), """
SELECT id, CASE WHEN original_price > sale_price THEN CAST(floor((original_price - sale_price) / original_price * 100 + 0.5) AS BIGINT) ELSE 0 END AS discount,
  CASE WHEN sale_price < 20 THEN 'budget' WHEN sale_price <= 75 THEN 'mid' ELSE 'premium' END AS tier,
  CASE WHEN deal_score >= 85 THEN 'steal' WHEN deal_score >= 70 THEN 'fire' WHEN deal_score >= 50 THEN 'solid' ELSE '' END AS badge, deal_score >= 70 AS verified FROM o_scored""")
