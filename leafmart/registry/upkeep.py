"""Upserts, histories, expiry, retention, saves and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmart.operators import maintenance as m
from leafmart.operators import stored
from leafmart.registry import oracle as o
from leafmart.registry.common import as_long, day_text, events, products, scored, view
from leafmart.registry.common import PRODUCTS_AS_OF as NOW
from leafmart.session import cut_lineage
from leafmart.sources import sinks
from leafmart.streaming.jobs import work_folder

QUERIES, ORACLES = {}, {}
TODAY = f"DATE '{NOW[:10]}'"
SPLIT = "2000-01-01"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


KEYS = ["dispensary_id", "name", "weight_value", "sale_price"]


def _upsert(s, d):
    df = scored(s, d).select(*KEYS, "id", "deal_score", "is_active", F.to_date("scraped_at").alias("created"))
    first = df.filter(F.col("created") < SPLIT)
    base = cut_lineage(m.upsert(first.limit(0), first, KEYS, "id", keep=["created"]))  # its shuffle files go before the second part
    out = m.upsert(base, df.filter(F.col("created") >= SPLIT), KEYS, "id", keep=["created"])
    return as_long(out, "deal_score").withColumn("created", day_text("created"))


_upsert_sql = f"""
WITH a AS (SELECT *, run_date >= DATE '{SPLIT}' AS side FROM o_scored),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY dispensary_id, name, weight_value, sale_price ORDER BY side DESC, id DESC) = 1),
f AS (SELECT dispensary_id, name, weight_value, sale_price, arg_min(run_date, (side, id)) AS created FROM a GROUP BY ALL),
b AS (SELECT dispensary_id, name, weight_value, sale_price, arg_max(run_date, id) FILTER (WHERE NOT side) AS old_created, arg_min(run_date, id) FILTER (WHERE side) AS new_created FROM a GROUP BY ALL)
SELECT n.dispensary_id, n.name, n.weight_value, n.sale_price, n.id, CAST(n.deal_score AS BIGINT) AS deal_score, n.is_active,
  strftime(COALESCE(arg0.c, b.new_created), '%Y-%m-%d') AS created
FROM n JOIN b ON b.dispensary_id = n.dispensary_id AND b.name = n.name AND b.weight_value IS NOT DISTINCT FROM n.weight_value AND b.sale_price = n.sale_price
LEFT JOIN (SELECT dispensary_id, name, weight_value, sale_price, arg_min(run_date, id) AS c FROM a WHERE NOT side GROUP BY ALL) arg0
  ON arg0.dispensary_id = n.dispensary_id AND arg0.name = n.name AND arg0.weight_value IS NOT DISTINCT FROM n.weight_value AND arg0.sale_price = n.sale_price"""
register("upsert_products", _upsert, _upsert_sql)


def _upsert_buckets(s, d):
    """The same table, stored by bucket; the second part touches its own buckets only."""
    df = cut_lineage(scored(s, d).select(*KEYS, "id", "deal_score", "is_active", F.to_date("scraped_at").alias("created")))  # read three times
    first, path = df.filter(F.col("created") < SPLIT), work_folder(s, "upsert")
    stored.create_table(cut_lineage(m.upsert(first.limit(0), first, KEYS, "id", keep=["created"])), path, KEYS, 16)
    stored.upsert_buckets(path, df.filter(F.col("created") >= SPLIT), KEYS, "id", ["created"], 16)
    return as_long(stored.read_table(s, path), "deal_score").withColumn("created", day_text("created"))


register("upsert_by_bucket", _upsert_buckets, _upsert_sql)



def _product_key(df):
    return df.withColumn("product_id", F.concat_ws("@", F.col("l_partkey").cast("string"), "dispensary_id"))


register("log_price_history", lambda s, d: m.log_price_history(_product_key(products(s, d))).withColumn("observed_date", day_text("observed_date")), """
SELECT product_id, strftime(run_date, '%Y-%m-%d') AS observed_date, dispensary_id, sale_price, original_price, discount_percent, brand, category, weight_value
FROM (SELECT *, CAST(l_partkey AS VARCHAR) || '@' || dispensary_id AS product_id FROM v_products) x
QUALIFY row_number() OVER (PARTITION BY product_id, run_date ORDER BY scraped_at DESC, id DESC) = 1""")
ATTRS = ["deal_score", "sale_price", "name"]


def _history(s, d):
    obs = scored(s, d).filter("deal_score > 0").select(
        F.col("l_partkey").alias("product_id"), "dispensary_id", *ATTRS, F.col("run_date").alias("seen_at"), "id")
    empty = obs.limit(0).select("product_id", "dispensary_id", *ATTRS, F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
                                F.lit(True).alias("is_active"), F.lit(1).cast("long").alias("times_seen"))
    first = m.merge_deal_observations(empty, obs.filter(F.col("seen_at") < SPLIT), ATTRS, "id")
    return m.merge_deal_observations(first, obs.filter(F.col("seen_at") >= SPLIT), ATTRS, "id")


o.EXTRA["o_history"] = """
SELECT l_partkey AS product_id, dispensary_id, CAST(arg_max(deal_score, (run_date, id)) AS BIGINT) AS deal_score, arg_max(sale_price, (run_date, id)) AS sale_price,
  MIN(run_date) AS first_seen, MAX(run_date) AS last_seen, COUNT(*) AS times_seen FROM o_scored WHERE deal_score > 0 GROUP BY ALL"""
register("merge_deal_observations", lambda s, d: as_long(_history(s, d), "deal_score").select(
    "product_id", "dispensary_id", "deal_score", "sale_price", day_text("first_seen").alias("first_seen"), day_text("last_seen").alias("last_seen"), "is_active", "times_seen"), """
SELECT * REPLACE (strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen), true AS is_active FROM o_history""")
_slugs = lambda s, d: view(s, d, "dispensaries").filter(F.col("platform").isin("dutchie", "jane", "aiq")).select(F.col("id").alias("slug"))
_off = lambda s, d: view(s, d, "dispensaries").filter(~F.col("is_active")).select(F.col("id").alias("slug"))
register("expire_history", lambda s, d: m.expire_history(_history(s, d), NOW, _slugs(s, d)).select("product_id", "dispensary_id", "is_active"), f"""
SELECT h.product_id, h.dispensary_id, NOT (h.last_seen < {TODAY} AND d.platform IN ('dutchie','jane','aiq')) AS is_active FROM o_history h JOIN v_dispensaries d ON d.id = h.dispensary_id""")
register("deactivate_products", lambda s, d: as_long(m.deactivate_products(scored(s, d), NOW, _slugs(s, d), _off(s, d)), "deal_score").select("id", "is_active", "deal_score"), f"""
SELECT p.id, p.is_active AND NOT (p.run_date < {TODAY} AND d.platform IN ('dutchie','jane','aiq')) AND d.is_active AS is_active,
  CAST(CASE WHEN p.is_active AND NOT (p.run_date < {TODAY} AND d.platform IN ('dutchie','jane','aiq')) AND NOT d.is_active THEN 0 ELSE p.deal_score END AS BIGINT) AS deal_score
FROM o_scored p JOIN v_dispensaries d ON d.id = p.dispensary_id""")


def _retention(s, d):
    t = {"analytics_events": events(s, d), "shared_saves": view(s, d, "shared_saves")}
    _, events_report = m.apply_retention(t, "2024-07-14 00:00:00")
    _, runs_report = m.apply_retention({"scrape_runs": view(s, d, "scrape_runs")}, NOW)
    return events_report.unionByName(runs_report)


register("apply_retention", _retention, f"""
SELECT 'analytics_events' AS table_name, COUNT(*) FILTER (WHERE created_at < TIMESTAMP '2024-07-14' - INTERVAL '180' DAY) AS rows_deleted FROM v_analytics_events
UNION ALL SELECT 'shared_saves', COUNT(*) FILTER (WHERE expires_at < TIMESTAMP '2024-07-14') FROM v_shared_saves
UNION ALL SELECT 'scrape_runs', COUNT(*) FILTER (WHERE started_at < TIMESTAMP '{NOW}' - INTERVAL '90' DAY) FROM v_scrape_runs""")
register("save_counts", lambda s, d: m.save_counts(view(s, d, "user_saved_deals")),
         "SELECT deal_id, COUNT(DISTINCT user_id) AS save_count FROM v_user_saved_deals GROUP BY deal_id")
register("save_count_join", lambda s, d: m.with_save_count(view(s, d, "deal_catalog"), m.save_counts(view(s, d, "user_saved_deals"))).select("id", "save_count"), """
SELECT c.id, COUNT(DISTINCT s.user_id) AS save_count FROM v_deal_catalog c LEFT JOIN v_user_saved_deals s ON s.deal_id = c.id GROUP BY c.id""")
register("top_saved_names", lambda s, d: m.top_saved(m.save_counts(view(s, d, "user_saved_deals")), view(s, d, "deal_catalog").filter("is_active")), """
SELECT t.deal_id, t.save_count, c.name, c.brand FROM (SELECT deal_id, COUNT(DISTINCT user_id) AS save_count FROM v_user_saved_deals GROUP BY deal_id ORDER BY save_count DESC, deal_id LIMIT 10) t
LEFT JOIN v_deal_catalog c ON c.id = t.deal_id AND c.is_active""")
register("shared_list_expand", lambda s, d: m.shared_list_expand(
    view(s, d, "shared_saves").withColumn("deal_ids", F.array("k", F.col("k") + 7, F.col("k") * 1000 + 1)), view(s, d, "deal_catalog"), "2024-01-15 00:00:00"), """
SELECT share_id, position, deal_id, c.name, c.sale_price FROM (
  SELECT id AS share_id, unnest([CAST(0 AS BIGINT), 1, 2]) AS position, unnest([k, k + 7, k * 1000 + 1]) AS deal_id FROM v_shared_saves WHERE expires_at >= TIMESTAMP '2024-01-15') x
JOIN v_deal_catalog c ON c.id = x.deal_id AND c.sale_price > 0""")
register("match_deals_to_products", lambda s, d: m.match_deals_to_products(
    products(s, d).filter("is_active").select(F.col("id").alias("deal_key"), "name", "sale_price"), products(s, d).filter(~F.col("is_active")).select("id", "name", "sale_price")
).groupBy(F.col("product_id").isNull().alias("unmatched")).agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("n_products")), """
SELECT p.product_id IS NULL AS unmatched, COUNT(*) AS n, COUNT(DISTINCT p.product_id) AS n_products FROM v_products v
LEFT JOIN (SELECT name, sale_price, MAX(id) AS product_id FROM v_products WHERE NOT is_active GROUP BY ALL) p ON p.name = v.name AND p.sale_price = v.sale_price
WHERE v.is_active GROUP BY 1""")


def _expired(s, d):
    saves = view(s, d, "user_saved_deals")
    return m.expired_saves(saves, view(s, d, "deal_catalog").filter("is_active"), saves.filter("saved_at >= DATE '2024-01-08'"), saves.filter("saved_at < DATE '2024-01-04'"), 2)


register("expired_saves", lambda s, d: _expired(s, d).select("user_id", "deal_id", "status"), """
WITH g AS (SELECT s.*, CASE WHEN saved_at < DATE '2024-01-04' THEN 'already_archived' WHEN saved_at >= DATE '2024-01-08' THEN 'archived' ELSE 'kept' END AS status
  FROM v_user_saved_deals s WHERE NOT EXISTS (SELECT 1 FROM v_deal_catalog c WHERE c.id = s.deal_id AND c.is_active))
SELECT user_id, deal_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY saved_at DESC, deal_id) AS rn FROM g) x WHERE status <> 'archived' OR rn <= 2""")
register("deal_report_summary", lambda s, d: m.report_summary(view(s, d, "deal_reports")).withColumns(
    {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_reported", "last_reported")}), """
SELECT deal_id, product_name, dispensary_name, brand_name, deal_price, COUNT(*) AS report_count, COUNT(*) FILTER (WHERE report_type = 'wrong_price') AS wrong_price_count,
  COUNT(*) FILTER (WHERE report_type = 'deal_gone') AS deal_gone_count, COUNT(*) FILTER (WHERE report_type = 'wrong_product') AS wrong_product_count,
  epoch_us(MIN(created_at)) AS first_reported, epoch_us(MAX(created_at)) AS last_reported FROM v_deal_reports WHERE NOT reviewed GROUP BY ALL""")
register("flagged_deals", lambda s, d: m.flagged_deals(view(s, d, "deal_reports"), view(s, d, "deal_catalog")), """
SELECT r.deal_id, COUNT(*) AS report_count, COUNT(*) FILTER (WHERE report_type = 'wrong_price') AS wrong_price_count, COUNT(*) FILTER (WHERE report_type = 'deal_gone') AS deal_gone_count,
  COUNT(*) FILTER (WHERE report_type = 'wrong_product') AS wrong_product_count, bool_and(reviewed) AS reviewed, ANY_VALUE(c.name) AS current_name, ANY_VALUE(c.is_active) AS is_active
FROM v_deal_reports r LEFT JOIN v_deal_catalog c ON c.id = r.deal_id GROUP BY r.deal_id""")
register("events_csv_lines", lambda s, d: events(s, d).select(F.col("id"), sinks.csv_line(
    F.col("id"), F.col("anon_id"), F.col("event_name"), F.to_json(F.struct(F.col("k"), F.col("device_type")))).alias("line")), """
SELECT id, '"' || id || '","' || anon_id || '","' || event_name || '","{""k"":' || k || CASE WHEN device_type IS NULL THEN '' ELSE ',""device_type"":""' || device_type || '""' END || '}"' AS line FROM v_analytics_events""")
register("union_of_snapshots", lambda s, d: reduce(DataFrame.unionByName, [
    m.save_counts(view(s, d, "user_saved_deals")).select(F.lit("saves").alias("kind"), F.col("deal_id").alias("key"), F.col("save_count").alias("n")),
    view(s, d, "deal_reports").groupBy("deal_id").agg(F.count("*").alias("n")).select(F.lit("reports").alias("kind"), F.col("deal_id").alias("key"), "n")]), """
SELECT 'saves' AS kind, deal_id AS key, COUNT(DISTINCT user_id) AS n FROM v_user_saved_deals GROUP BY deal_id UNION ALL SELECT 'reports', deal_id, COUNT(*) FROM v_deal_reports GROUP BY deal_id""")


# --- sources and sinks, written and read back ----------------------------------------------------------------

def _folder(s, name):
    from leafmart.streaming.jobs import work_folder

    return work_folder(s, name)


def _table_roundtrip(s, d):
    """Products as CSV and as Parquet through the typed reader; both copies must agree with the view."""
    from leafmart.sources.tables import SCHEMAS, read_table

    own = view(s, d, "products")
    typed = [f for f in T._parse_datatype_string(SCHEMAS["products"]).fields]
    rows = own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in typed])
    out = []
    for kind in ("csv", "parquet"):
        path = _folder(s, f"products-{kind}")
        writer = rows.write.option("header", True)
        writer.csv(path) if kind == "csv" else writer.parquet(path)
        out.append(read_table(s, "products", path, kind).select(F.lit(kind).alias("kind"), "id", "brand", "category", F.round(F.col("sale_price").cast("double"), 2).alias("sale_price")))
    return out[0].unionByName(out[1])


register("read_table_roundtrip", _table_roundtrip, """
SELECT kind, id, brand, category, CAST(sale_price AS DOUBLE) AS sale_price FROM v_products, (VALUES ('csv'), ('parquet')) k(kind)""")


def _raw_roundtrip(s, d):
    """Cards as JSON lines, a broken line after every store's first card, read by both readers."""
    from leafmart.sources.tables import parse_raw_listings, read_raw_listings

    cards = view(s, d, "raw_listings").select("name", "raw_text", "product_url", "dispensary_id")
    lines = cards.select(F.to_json(F.struct("*")).alias("value"), F.length("name") % 7 == 0)
    lines = lines.select(F.explode(F.when(lines[1], F.array("value", F.concat(F.lit("{broken "), F.substring("value", 2, 20)))).otherwise(F.array("value"))).alias("value"))
    path = _folder(s, "cards")
    lines.write.text(path)
    count = lambda df, how: df.groupBy(F.lit(how).alias("reader"), F.coalesce("dispensary_id", F.lit("")).alias("store"), F.col("_corrupt_record").isNotNull().alias("broken")).agg(F.count("*").alias("n"))
    return count(read_raw_listings(s, path), "file").unionByName(count(parse_raw_listings(s.read.text(path)), "rows"))


register("raw_listings_roundtrip", _raw_roundtrip, """
SELECT reader, store, broken, n FROM (
  SELECT dispensary_id AS store, FALSE AS broken, COUNT(*) AS n FROM v_raw_listings GROUP BY 1
  UNION ALL SELECT '', TRUE, COUNT(*) FROM v_raw_listings WHERE length(name) % 7 = 0 HAVING COUNT(*) > 0) x, (VALUES ('file'), ('rows')) r(reader)""")


def _materialized(s, d):
    from leafmart.plans.daily import refresh_save_counts

    refresh_save_counts(view(s, d, "user_saved_deals"), _folder(s, "save-counts"))
    return s.table("deal_save_counts")


register("materialized_save_counts", _materialized, "SELECT deal_id, COUNT(DISTINCT user_id) AS save_count FROM v_user_saved_deals GROUP BY deal_id")
