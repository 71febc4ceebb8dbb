"""Domain views over the benchmark tables.

One text per view that both Spark SQL and the checking engine accept; money is computed in whole cents so
that both give the same doubles. ``@IDIV@`` is the integer division, ``#name#`` a base table, ``v_*`` a view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "benchmark", "labels", "conversations", "embeddings",
]
EVENTS_AS_OF = "2024-01-30 12:00:00"
PRODUCTS_AS_OF = "2001-08-01 00:00:00"

# Tiers of the stand-in brands; 'brand#1' also proves that a prefix needs a word end ('brand#10').
BRIDGE_BRAND_TIERS = {
    "premium": ["brand#1", "brand#2", "brand#3"],
    "popular": ["brand#4", "brand#5", "brand#6", "brand#7", "brand#8", "brand#9"],
}

VIEWS: dict[str, str] = {}

VIEWS["v_dispensaries"] = """
SELECT 'chain' || CAST(n_nationkey AS STRING) || '-' || CAST(s_suppkey AS STRING) AS id,
       s_suppkey, s_name AS name, n_name AS state,
       CASE n_regionkey WHEN 0 THEN 'southern-nv' WHEN 1 THEN 'michigan' WHEN 2 THEN 'new-jersey'
                        WHEN 3 THEN 'colorado' ELSE 'northern-nv' END AS region,
       CASE s_suppkey % 6 WHEN 0 THEN 'dutchie' WHEN 1 THEN 'curaleaf' WHEN 2 THEN 'jane' WHEN 3 THEN 'carrot'
                          WHEN 4 THEN 'aiq' ELSE 'rise' END AS platform,
       s_suppkey % 10 <> 0 AS is_active,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(3590 + s_suppkey % 50 AS DOUBLE) / 100 END AS latitude,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 40 - 11530 AS DOUBLE) / 100 END AS longitude,
       CAST(s_suppkey * 7 % 1000 AS STRING) || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'Las Vegas Blvd'
            WHEN 1 THEN 'Nellis Ave' ELSE 'Strip Road' END AS address
FROM #supplier# JOIN #nation# ON s_nationkey = n_nationkey
"""

VIEWS["v_listing_base"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_linestatus, l_returnflag,
       p_name, p_brand, p_type, p_size,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' ||
       CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-' ||
       CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS STRING) AS id,
       (2 * CAST(ROUND(l_extendedprice * 100) AS BIGINT) + 40 * CAST(l_quantity AS BIGINT))
           @IDIV@ (80 * CAST(l_quantity AS BIGINT)) AS original_cents,
       CAST(ROUND(l_discount * 100) AS BIGINT) AS disc_points,
       CASE p_type WHEN 'ECONOMY' THEN 'flower' WHEN 'STANDARD' THEN 'vape' WHEN 'MEDIUM' THEN 'edible'
                   WHEN 'LARGE' THEN 'concentrate' WHEN 'SMALL' THEN 'preroll' ELSE 'other' END AS category,
       CASE WHEN p_type = 'ECONOMY' THEN CASE p_size % 5 WHEN 0 THEN '3.5' WHEN 1 THEN '7' WHEN 2 THEN '14'
                                                        WHEN 3 THEN '28' ELSE '1' END
            WHEN p_type = 'STANDARD' THEN CASE p_size % 4 WHEN 0 THEN '0.3' WHEN 1 THEN '0.5' WHEN 2 THEN '1' END
            WHEN p_type = 'MEDIUM' THEN CASE p_size % 3 WHEN 0 THEN '10' WHEN 1 THEN '100' ELSE '200' END
            WHEN p_type = 'LARGE' THEN CASE p_size % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1' WHEN 2 THEN '2' END
            WHEN p_type = 'SMALL' THEN '1' END AS weight_text
FROM #lineitem# JOIN #part# ON l_partkey = p_partkey
"""

VIEWS["v_products"] = """
SELECT b.id, d.id AS dispensary_id, d.name AS dispensary_name, d.region, d.platform AS source_platform,
       CASE WHEN l_partkey % 53 = 0 THEN 'Indica'
            WHEN l_partkey % 59 = 0 THEN p_brand
            WHEN l_partkey % 61 = 0 THEN '2 for $40 ' || p_name
            WHEN l_partkey % 67 = 0 THEN 'Badder Badder'
            WHEN l_partkey % 71 = 0 THEN p_name || ' Grinder'
            WHEN l_partkey % 73 = 0 THEN p_name || ' 20% off or 30% off'
            ELSE p_name || ' ' || COALESCE(weight_text || CASE WHEN category = 'edible' THEN 'mg' ELSE 'g' END || ' ', '')
                 || 'No' || CAST(l_partkey AS STRING) END AS name,
       CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE p_brand END AS brand,
       category,
       CAST(original_cents AS DOUBLE) / 100 AS original_price,
       CAST((2 * original_cents * (1000 - 75 * disc_points) + 1000) @IDIV@ 2000 AS DOUBLE) / 100 AS sale_price,
       CAST(75 * disc_points AS DOUBLE) / 10 AS discount_percent,
       CAST(weight_text AS DOUBLE) AS weight_value,
       CASE WHEN weight_text IS NULL THEN NULL WHEN category = 'edible' THEN 'mg' ELSE 'g' END AS weight_unit,
       CASE category WHEN 'vape' THEN CASE p_size % 3 WHEN 0 THEN 'disposable' WHEN 1 THEN 'cartridge' ELSE 'pod' END
                     WHEN 'preroll' THEN CASE p_size % 5 WHEN 0 THEN 'infused_preroll' WHEN 1 THEN 'preroll_pack' END
                     WHEN 'concentrate' THEN CASE p_size % 3 WHEN 0 THEN 'live_resin' WHEN 1 THEN 'rosin' END
                     WHEN 'edible' THEN CASE p_size % 3 WHEN 0 THEN 'gummy' WHEN 1 THEN 'chocolate' END
       END AS product_subtype,
       CASE l_partkey % 4 WHEN 0 THEN 'Indica' WHEN 1 THEN 'Sativa' WHEN 2 THEN 'Hybrid' END AS strain_type,
       l_linestatus = 'O' AS is_active,
       l_shipdate AS scraped_at, CAST(l_shipdate AS DATE) AS run_date,
       l_partkey, l_orderkey
FROM v_listing_base b JOIN v_dispensaries d ON b.l_suppkey = d.s_suppkey
"""

VIEWS["v_raw_listings"] = """
SELECT id, dispensary_id, name, scraped_brand, scraped_category, source_platform, product_url, price, run_date,
       name || CHR(10) || scraped_brand || CHR(10) || weight_words || ' ' || price || ' THC: ' || thc || '% '
           || strain_word || note AS raw_text
FROM (
  SELECT b.id, d.id AS dispensary_id, CAST(l_shipdate AS DATE) AS run_date,
         p_name || CASE category WHEN 'flower' THEN ' Flower' WHEN 'vape' THEN ' Cart' WHEN 'edible' THEN ' Gummies'
                        WHEN 'concentrate' THEN ' Live Resin' WHEN 'preroll' THEN ' Preroll' ELSE ' Thing' END
                || CASE p_size % 4 WHEN 0 THEN ' Black Label' WHEN 1 THEN ' (I)' WHEN 2 THEN ' Staff Pick!' ELSE '' END
                AS name,
         CASE WHEN l_partkey % 8 = 0 THEN '' ELSE p_brand END AS scraped_brand,
         CASE WHEN l_partkey % 3 = 0 THEN category ELSE '' END AS scraped_category,
         CASE WHEN l_linenumber % 2 = 0 THEN d.platform END AS source_platform,
         'https://menu.example.org/store' || CAST(l_suppkey AS STRING) || '/product/' || lower(p_brand) || '-' ||
             CAST(l_partkey AS STRING) AS product_url,
         CASE l_linenumber % 7
              WHEN 0 THEN 'was $' || o_text || ' now $' || s_text
              WHEN 1 THEN '$' || o_text || ' 2/$' || b_text
              WHEN 2 THEN '2/$' || b_text || ' $' || s_text
              WHEN 3 THEN 'BOGO $' || o_text
              WHEN 4 THEN '$' || o_text || ' $' || s_text
              WHEN 5 THEN '$' || o_text || ' $' || d_text || ' off'
              ELSE '$' || s_text END AS price,
         CASE WHEN weight_text IS NULL THEN 'eighth'
              WHEN category = 'flower' AND p_size % 7 = 0 THEN '1/8oz'
              WHEN category = 'edible' THEN weight_text || 'mg' ELSE weight_text || 'g' END AS weight_words,
         CAST((l_partkey % 300) @IDIV@ 10 AS STRING) || '.' || CAST(l_partkey % 10 AS STRING) AS thc,
         CASE l_partkey % 4 WHEN 0 THEN 'Indica' WHEN 1 THEN 'Sativa' WHEN 2 THEN 'Hybrid' ELSE '' END AS strain_word,
         CASE WHEN l_partkey % 11 = 0 THEN CHR(10) || 'Special Offers (1) 2/$40 other brand' ELSE '' END AS note
  FROM (SELECT *,
               CAST(original_cents @IDIV@ 100 AS STRING) || '.' || LPAD(CAST(original_cents % 100 AS STRING), 2, '0') AS o_text,
               CAST(sale_cents @IDIV@ 100 AS STRING) || '.' || LPAD(CAST(sale_cents % 100 AS STRING), 2, '0') AS s_text,
               CAST((2 * sale_cents) @IDIV@ 100 AS STRING) || '.' || LPAD(CAST((2 * sale_cents) % 100 AS STRING), 2, '0') AS b_text,
               CAST((original_cents - sale_cents) @IDIV@ 100 AS STRING) || '.' ||
                   LPAD(CAST((original_cents - sale_cents) % 100 AS STRING), 2, '0') AS d_text
        FROM (SELECT *, (2 * original_cents * (1000 - 75 * disc_points) + 1000) @IDIV@ 2000 AS sale_cents
              FROM v_listing_base) x) b
  JOIN v_dispensaries d ON b.l_suppkey = d.s_suppkey
) y
"""

VIEWS["v_analytics_events"] = """
SELECT event_id AS id, user_id * 20 + event_id % 20 AS anon_id, created_at, k,
       CASE event_type WHEN 'click' THEN 'get_deal_click' WHEN 'view' THEN 'deal_view'
            WHEN 'purchase' THEN 'deal_saved' WHEN 'signup' THEN 'app_loaded'
            ELSE CASE event_id % 5 WHEN 0 THEN 'shared_page_view' WHEN 1 THEN 'referral_click'
                                   WHEN 2 THEN 'referral_conversion' ELSE 'deal_shared' END END AS event_name,
       CASE k % 5 WHEN 1 THEN 'flyer' WHEN 2 THEN 'twitter' WHEN 3 THEN 'google' WHEN 4 THEN 'reddit' END AS utm_source,
       CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS device_type,
       CASE k % 6 WHEN 0 THEN 'https://t.co/abc' WHEN 1 THEN 'https://www.google.com/search?q=x'
            WHEN 2 THEN 'https://old.reddit.com/r/x' WHEN 3 THEN 'not a url'
            WHEN 4 THEN 'https://blog.example.org/p' END AS referrer_url,
       'r' || CAST(k % 12 AS STRING) AS referrer_id,
       CASE WHEN k % 10 = 9 THEN NULL ELSE 'store ' || CAST(k % 10 AS STRING) END AS store, value
FROM (SELECT event_id, user_id, ts AS created_at, event_type, value,
             CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM #events#) e
"""

VIEWS["v_user_saved_deals"] = """
SELECT anon_id AS user_id, k AS deal_id, MIN(created_at) AS saved_at
FROM v_analytics_events WHERE event_name = 'deal_saved' GROUP BY anon_id, k
"""

VIEWS["v_deal_reports"] = """
SELECT id, k AS deal_id, anon_id, created_at,
       CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'wrong_price' WHEN 1 THEN 'deal_gone'
            WHEN 2 THEN 'wrong_product' ELSE 'other' END AS report_type,
       id % 3 = 0 AS reviewed, CAST(k AS DOUBLE) + 0.5 AS deal_price,
       'deal ' || CAST(k AS STRING) AS product_name, 'store ' || CAST(k % 10 AS STRING) AS dispensary_name,
       'brand ' || CAST(k % 7 AS STRING) AS brand_name
FROM v_analytics_events
WHERE event_name IN ('deal_shared', 'shared_page_view', 'referral_click', 'referral_conversion')
"""

VIEWS["v_deal_catalog"] = """
SELECT p_partkey AS id, p_name || ' No' || CAST(p_partkey AS STRING) AS name,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE p_type WHEN 'ECONOMY' THEN 'flower' WHEN 'STANDARD' THEN 'vape' WHEN 'MEDIUM' THEN 'edible'
                   WHEN 'LARGE' THEN 'concentrate' WHEN 'SMALL' THEN 'preroll' ELSE 'other' END AS category,
       CASE p_size % 10 WHEN 0 THEN 'chain1-' ELSE 'chain2-' END || CAST(p_partkey % 20 AS STRING) AS dispensary_id,
       p_retailprice AS original_price,
       CASE WHEN p_size % 6 = 0 THEN p_retailprice
            ELSE CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) @IDIV@ 2 AS DOUBLE) / 100 END AS sale_price,
       CAST(p_size * 2 AS INT) AS deal_score, p_size % 4 <> 0 AS is_active
FROM #part#
"""

VIEWS["v_shared_saves"] = """
SELECT id, anon_id, k, created_at, created_at + INTERVAL '1' DAY AS expires_at
FROM v_analytics_events WHERE event_name = 'deal_shared'
"""

VIEWS["v_scrape_runs"] = """
SELECT o_orderkey AS id, o_orderdate AS started_at,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed_with_errors' ELSE 'failed' END AS status,
       CASE n_regionkey WHEN 0 THEN 'southern-nv' WHEN 1 THEN 'michigan' WHEN 2 THEN 'new-jersey'
                        WHEN 3 THEN 'colorado' ELSE 'northern-nv' END
           || CASE WHEN n_regionkey = 4 THEN '' ELSE '-' || CAST(o_custkey % 3 + 1 AS STRING) END AS region,
       CAST(floor(o_totalprice / 100) AS BIGINT) AS total_products,
       o_custkey % 50 AS qualifying_deals, o_orderkey % 4000 AS runtime_seconds,
       CASE o_custkey % 2 WHEN 0 THEN 'stable' ELSE 'new' END AS platform_group
FROM #orders# JOIN #customer# ON o_custkey = c_custkey JOIN #nation# ON c_nationkey = n_nationkey
"""

VIEWS["v_run_sites"] = """
SELECT DISTINCT l_orderkey AS run_id, 'chain' || CAST(s_nationkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS slug,
       l_returnflag <> 'R' AS ok
FROM #lineitem# JOIN #supplier# ON l_suppkey = s_suppkey
"""

VIEWS["v_user_contacts"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN '702' || LPAD(CAST(c_custkey % 10000000 AS STRING), 7, '0') END AS phone,
       CASE WHEN c_custkey % 2 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '@example.org' END AS email,
       CASE c_custkey % 4 WHEN 0 THEN 'saved_deals_banner' WHEN 1 THEN 'out_of_market'
            WHEN 2 THEN 'early_bird_banner' ELSE 'other' END AS source,
       LPAD(CAST(c_custkey * 37 % 100000 AS STRING), 5, '0') AS zip_entered,
       36 + CAST(c_custkey % 500 AS DOUBLE) / 100 AS lat, CAST(c_custkey % 300 AS DOUBLE) / 100 - 117 AS lng
FROM #customer#
"""


def _render(sql: str, spark_sql: bool) -> str:
    out = sql.replace("@IDIV@", "div" if spark_sql else "//")
    return re.sub(r"#(\w+)#", r"{\1}" if spark_sql else r"\1", out)


def with_views(body: str, extra: dict[str, str] | None = None, spark_sql: bool = False) -> str:
    """``body`` preceded by the WITH clause of every view it needs, in dependency order."""
    texts = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[vo]_[a-z0-9_]+\b", sql):
            if name in texts and name not in ordered:
                visit(texts[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    clause = ",\n".join(f"{name} AS ({texts[name]})" for name in ordered)
    body = body.strip()
    if clause and body.startswith("WITH "):
        return _render(f"WITH {clause},\n{body[5:]}", spark_sql)
    return _render((f"WITH {clause}\n" if clause else "") + body, spark_sql)


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bridge view as a lazy DataFrame over the tables in ``sf_dir``."""
    text = with_views(f"SELECT * FROM v_{name}", spark_sql=True)
    tables = {t: base_table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    out = spark.sql(text, **tables)
    if name == "raw_listings":
        # the card text is composed here, not stored: keep conditions on it from being rewritten into that composition
        out = out.withColumn("_here", F.spark_partition_id()).filter("_here >= 0").drop("_here")
    return out
