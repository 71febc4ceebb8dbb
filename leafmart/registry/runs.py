"""Run health and site coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.operators import runs as r
from leafmart.registry import oracle as o
from leafmart.registry.common import as_long, day_text, events, scored, view

NOW = "2001-07-28 12:00:00"
QUERIES, ORACLES = {}, {}
TS, TODAY = f"TIMESTAMP '{NOW}'", f"DATE '{NOW[:10]}'"
SHARDS = {"southern-nv": 3, "michigan": 4, "new-jersey": 3}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


def runs(s, d):
    return r.runs_with_sites(view(s, d, "scrape_runs"), view(s, d, "run_sites"))


BASE = "regexp_replace(region, '^(.+)-[0-9]+$', '\\1')"
o.EXTRA["o_runs"] = f"""
SELECT v.*, {BASE} AS base_region, COALESCE(n_ok, 0) AS n_ok, COALESCE(n_bad, 0) AS n_bad,
  CASE WHEN COALESCE(n_ok, 0) + COALESCE(n_bad, 0) > 0 THEN CAST(n_ok * 100 AS DOUBLE) / (n_ok + n_bad) ELSE 100 END AS success
FROM v_scrape_runs v LEFT JOIN (SELECT run_id, COUNT(*) FILTER (WHERE ok) AS n_ok, COUNT(*) FILTER (WHERE NOT ok) AS n_bad FROM v_run_sites GROUP BY run_id) c ON c.run_id = v.id"""
FIN = "status IN ('completed','completed_with_errors')"
register("runs_with_sites", lambda s, d: runs(s, d).select("id", F.array_join("sites_scraped", ",").alias("ok_sites"), F.array_join("sites_failed", ",").alias("failed_sites")), """
SELECT v.id, COALESCE(string_agg(slug, ',' ORDER BY slug) FILTER (WHERE ok), '') AS ok_sites, COALESCE(string_agg(slug, ',' ORDER BY slug) FILTER (WHERE NOT ok), '') AS failed_sites
FROM v_scrape_runs v LEFT JOIN v_run_sites x ON x.run_id = v.id GROUP BY v.id""")
register("scrape_health", lambda s, d: r.scrape_health(runs(s, d), scored(s, d), events(s, d), NOW), f"""
SELECT (SELECT COUNT(*) FROM o_scored WHERE is_active AND deal_score > 0) AS total_deals_active, (SELECT COUNT(*) FROM v_products) AS total_products,
  (SELECT COUNT(*) FROM v_products) AS deals_total, (SELECT COUNT(DISTINCT base_region) FROM o_runs WHERE started_at >= {TS} - INTERVAL '7' DAY) AS states_live,
  COALESCE((SELECT round(AVG(success), 0) FROM (SELECT success FROM o_runs WHERE {FIN} ORDER BY started_at DESC, id DESC LIMIT 15) t), 0) AS scraper_success,
  (SELECT strftime(MAX(started_at), '%Y-%m-%d %H:%M:%S') FROM o_runs) AS last_run,
  (SELECT COUNT(*) FROM v_analytics_events WHERE event_name IN {o.values_in(L.SHARE_EVENTS)}) AS total_shares""")
register("coverage_by_region", lambda s, d: r.coverage_by_region(runs(s, d), NOW), f"""
SELECT base_region, CAST(SUM(n_ok) AS BIGINT) AS sites_ok, CAST(SUM(total_products) AS BIGINT) AS products, round(AVG(success), 0) AS success_rate,
  strftime(MAX(started_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM o_runs WHERE started_at >= {TS} - INTERVAL '7' DAY GROUP BY base_region""")
register("region_unique_products", lambda s, d: r.region_unique_products(scored(s, d), NOW), f"""
SELECT region, COUNT(DISTINCT id) AS unique_products, COUNT(DISTINCT id) FILTER (WHERE deal_score > 0) AS unique_deals FROM o_scored
WHERE scraped_at >= {TS} - INTERVAL '30' DAY GROUP BY region""")
_listed = f"CASE WHEN regexp_matches(region, '^.+-[0-9]+$') AND regexp_replace(region, '-[0-9]+$', '') IN {o.values_in(L.SHARDED_REGIONS)} THEN regexp_replace(region, '-[0-9]+$', '') ELSE region END"
register("region_site_coverage", lambda s, d: r.region_site_coverage(runs(s, d), view(s, d, "dispensaries"), NOW, 10), f"""
WITH sl AS (SELECT DISTINCT {_listed} AS r, slug FROM v_scrape_runs v JOIN v_run_sites x ON x.run_id = v.id AND x.ok
   WHERE started_at >= {TS} - INTERVAL '10' DAY AND {FIN}),
c AS (SELECT r, COUNT(*) AS n FROM sl JOIN v_dispensaries d ON d.id = slug GROUP BY r)
SELECT region, COUNT(*) AS total_sites, COUNT(*) FILTER (WHERE is_active) AS active_sites, COALESCE(MAX(c.n), 0) AS scraped_sites
FROM v_dispensaries LEFT JOIN c ON c.r = region GROUP BY region""")
register("slug_join_after_explode", lambda s, d: runs(s, d).select("id", F.explode("sites_scraped").alias("slug")).join(
    view(s, d, "dispensaries").select(F.col("id").alias("slug"), "region"), "slug").groupBy("region").agg(F.count("*").alias("n")), """
SELECT d.region, COUNT(*) AS n FROM v_run_sites x JOIN v_dispensaries d ON d.id = x.slug JOIN v_scrape_runs r ON r.id = x.run_id WHERE x.ok GROUP BY d.region""")
register("distinct_region_slug", lambda s, d: runs(s, d).select("region", F.explode("sites_scraped").alias("slug")).distinct().groupBy("region").agg(F.count("*").alias("n")), """
SELECT region, COUNT(DISTINCT slug) AS n FROM v_scrape_runs v JOIN v_run_sites x ON x.run_id = v.id AND x.ok GROUP BY region""")
register("platform_summary", lambda s, d: r.platform_summary(view(s, d, "dispensaries"), scored(s, d), r.latest_runs(runs(s, d), 15, False).select(F.explode("sites_failed").alias("slug"))), """
WITH bad AS (SELECT DISTINCT slug FROM v_run_sites WHERE NOT ok AND run_id IN (SELECT id FROM v_scrape_runs ORDER BY started_at DESC, id DESC LIMIT 15)), p AS (SELECT dispensary_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE deal_score > 0) AS k FROM o_scored GROUP BY 1)
SELECT platform, COUNT(*) AS sites, COUNT(*) FILTER (WHERE bad.slug IS NULL) AS sites_ok, CAST(COALESCE(SUM(p.n) FILTER (WHERE bad.slug IS NULL), 0) AS BIGINT) AS products,
  CAST(COALESCE(SUM(p.k) FILTER (WHERE bad.slug IS NULL), 0) AS BIGINT) AS deals
FROM v_dispensaries v LEFT JOIN bad ON bad.slug = v.id LEFT JOIN p ON p.dispensary_id = v.id GROUP BY platform""")
register("latest_runs_per_region", lambda s, d: r.latest_runs(view(s, d, "scrape_runs"), 7).select("base_region", "id"),
         "SELECT base_region, id FROM o_runs QUALIFY row_number() OVER (PARTITION BY base_region ORDER BY started_at DESC, id DESC) <= 7")
register("latest_runs", lambda s, d: r.latest_runs(view(s, d, "scrape_runs"), 15, False).select("id"), "SELECT id FROM o_runs ORDER BY started_at DESC, id DESC LIMIT 15")
_exp = "CASE base_region " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SHARDS.items()) + " ELSE 1 END"
register("run_rollup", lambda s, d: as_long(r.run_rollup(runs(s, d), NOW, SHARDS), "products_last7", "products_today", "deals_today"), f"""
WITH l7 AS (SELECT * FROM o_runs QUALIFY row_number() OVER (PARTITION BY base_region ORDER BY started_at DESC, id DESC) <= 7),
w AS (SELECT base_region, COUNT(*) AS n7, COUNT(*) FILTER (WHERE {FIN}) AS ok7, SUM(runtime_seconds) FILTER (WHERE {FIN}) AS rt, CAST(SUM(total_products) AS BIGINT) AS products_last7 FROM l7 GROUP BY 1),
t AS (SELECT * FROM o_runs WHERE CAST(started_at AS DATE) >= {TODAY} AND {FIN}),
dd AS (SELECT base_region, COUNT(*) AS runs_today, CAST(SUM(total_products) AS BIGINT) AS products_today, CAST(SUM(qualifying_deals) AS BIGINT) AS deals_today, COUNT(DISTINCT region) AS shards_ran FROM t GROUP BY 1),
sx AS (SELECT t.base_region, x.slug, bool_or(x.ok) AS ok FROM t JOIN v_run_sites x ON x.run_id = t.id GROUP BY 1, 2),
sc AS (SELECT base_region, COUNT(*) FILTER (WHERE ok) AS g, COUNT(*) FILTER (WHERE NOT ok) AS b FROM sx GROUP BY 1)
SELECT base_region, products_last7, {o.js_pct('ok7', 'n7')} AS success7, COALESCE({o.js_round('CAST(rt AS DOUBLE) / NULLIF(ok7, 0)')}, 0) AS avg_runtime7,
  COALESCE(runs_today, 0) AS runs_today, COALESCE(products_today, 0) AS products_today, COALESCE(deals_today, 0) AS deals_today, COALESCE(shards_ran, 0) AS shards_ran,
  COALESCE(g, 0) AS sites_ok_today, COALESCE(b, 0) AS sites_failed_today, CAST({_exp} AS BIGINT) AS shards_expected
FROM w LEFT JOIN dd USING (base_region) LEFT JOIN sc USING (base_region)""")
register("missing_shards", lambda s, d: r.missing_shards(view(s, d, "scrape_runs"), NOW, SHARDS), f"""
SELECT region FROM (VALUES {', '.join(f"('{k}-{i}')" for k, n in SHARDS.items() for i in range(1, n + 1))}) w(region)
WHERE region NOT IN (SELECT region FROM v_scrape_runs WHERE CAST(started_at AS DATE) >= {TODAY} AND status IN ('completed','completed_with_errors','running'))""")
register("failed_minus_succeeded", lambda s, d: r.failed_minus_succeeded(runs(s, d)).withColumn("day", day_text("day")), """
SELECT base_region, strftime(started_at, '%Y-%m-%d') AS day, slug FROM o_runs r JOIN v_run_sites x ON x.run_id = r.id GROUP BY 1, 2, 3 HAVING NOT bool_or(x.ok)""")
