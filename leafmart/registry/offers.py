"""Caps, listing filters, scores, price distributions, duplicate removal and diversity limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions import pricing
from leafmart.operators import prices, ranking
from leafmart.registry import oracle as o
from leafmart.registry.common import PRODUCTS_AS_OF, TIERS, as_long, day_text, judged, products, scored, view
from leafmart.session import cut_lineage

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


# --- hard filters, caps, scores -------------------------------------------------------------------
register("hard_filter_reasons",
         lambda s, d: pricing.hard_filters(products(s, d)).select("id", F.coalesce("reject_reason", F.lit("pass")).alias("reason"), "cap_failed"),
         "SELECT id, COALESCE(reject_reason, 'pass') AS reason, cap_failed FROM o_hard")
register("failed_by_price_cap",
         lambda s, d: pricing.hard_filters(products(s, d)).groupBy("region", "category").agg(
             F.count("*").alias("n"), F.sum(F.col("cap_failed").cast("long")).alias("n_cap_failed"),
             F.sum((F.col("cap_failed") & ~F.col("passed")).cast("long")).alias("n_cap_rejects")),
         """SELECT region, category, COUNT(*) AS n, COUNT(*) FILTER (WHERE cap_failed) AS n_cap_failed,
                   COUNT(*) FILTER (WHERE cap_failed AND reject_reason IS NOT NULL) AS n_cap_rejects
            FROM o_hard GROUP BY region, category""")
register("resolve_price_cap",
         lambda s, d: pricing.with_price_cap(products(s, d)).filter("category <> 'other'").select("region", "category", "weight_value", "price_cap", "infused_cap", "pack_cap").distinct()
         .withColumn("weight_value", F.coalesce("weight_value", F.lit(-1.0))),
         """SELECT DISTINCT region, category, COALESCE(weight_value, -1) AS weight_value, price_cap, infused_cap, pack_cap FROM o_capped WHERE category <> 'other'""")


def _learned_caps(s, d):
    return prices.price_cap_recommendations(products(s, d))


o.EXTRA["o_tiered"] = f"""
SELECT *, {o.WEIGHT_TIER} AS weight_tier, {o.cents('sale_price')} AS pc FROM v_products
"""
o.EXTRA["o_ranked_prices"] = """
SELECT *, row_number() OVER (PARTITION BY region, category, weight_tier ORDER BY pc) - 1 AS i,
       COUNT(*) OVER (PARTITION BY region, category, weight_tier) AS n
FROM o_tiered WHERE is_active AND sale_price > 0 AND weight_tier IS NOT NULL
"""
o.EXTRA["o_cap_rec"] = f"""
SELECT region, category, weight_tier, {o.round_dec('MAX(pc) FILTER (WHERE i = CAST(floor(n * CAST(0.30 AS DOUBLE)) AS BIGINT)) / 100 * CAST(1.1 AS DOUBLE)', 2)} AS recommended_cap,
       MAX(pc) FILTER (WHERE i = n // 4) / 100 AS p25, MAX(pc) FILTER (WHERE i = CAST(floor(n * CAST(0.30 AS DOUBLE)) AS BIGINT)) / 100 AS p30,
       MAX(pc) FILTER (WHERE i = n // 2) / 100 AS p50, MAX(pc) FILTER (WHERE i = 3 * n // 4) / 100 AS p75,
       MAX(n) AS sample_size, MAX(n) >= 20 AS is_active
FROM o_ranked_prices GROUP BY region, category, weight_tier
"""
o.EXTRA["o_cap_rec_fixed"] = """
SELECT r.*, c.cap AS hardcoded_cap FROM o_cap_rec r LEFT JOIN o_caps c
  ON c.cat = r.category AND c.state = CASE WHEN EXISTS (SELECT 1 FROM o_caps e WHERE e.cat = r.category AND e.state = r.region)
     THEN r.region ELSE 'base' END
 AND (c.tier IS NULL OR c.tier = TRY_CAST(regexp_replace(r.weight_tier, '[gm]+$', '') AS DOUBLE))
"""
register("price_cap_recommendations", _learned_caps,
         f"""SELECT region, category, weight_tier, recommended_cap, p25, p30, p50, p75, sample_size, is_active, hardcoded_cap,
                CASE WHEN hardcoded_cap > 0 THEN {o.round_dec('(recommended_cap - hardcoded_cap) / hardcoded_cap * 100', 1)} END AS cap_delta_pct
            FROM o_cap_rec_fixed""")
o.EXTRA["o_dyn_source"] = f"""
SELECT v.*, COALESCE(k.recommended_cap, v.price_cap) AS learned_cap
FROM (SELECT *, {o.WEIGHT_TIER} AS wt FROM o_capped) v
LEFT JOIN o_cap_rec k ON k.is_active AND k.region = v.region AND k.category = v.category AND k.weight_tier = v.wt
"""
o.EXTRA["o_dyn_hard"] = o.hard_sql("o_dyn_source", "learned_cap")
register("hard_filter_learned_caps",
         lambda s, d: pricing.hard_filters(products(s, d), dynamic_caps=_learned_caps(s, d)).groupBy("region", "category").agg(
             F.sum(F.col("passed").cast("long")).alias("n_passed"),
             F.sum((F.col("reject_reason") == "price_cap").cast("long")).alias("n_price_cap")).na.fill(0, ["n_price_cap"]),
         """SELECT region, category, COUNT(*) FILTER (WHERE reject_reason IS NULL) AS n_passed,
                   COUNT(*) FILTER (WHERE reject_reason = 'price_cap') AS n_price_cap FROM o_dyn_hard GROUP BY region, category""")
register("deal_score", lambda s, d: scored(s, d).select("id", F.col("deal_score").cast("long").alias("deal_score")),
         "SELECT id, CAST(deal_score AS BIGINT) AS deal_score FROM o_scored")
#: Stand-in brands renamed to those of the default tiers, some with a word or letters behind, some unknown.
_real = [x for n in [*L.BRAND_TIERS["premium"], *L.BRAND_TIERS["popular"]] for x in (n.title(), n + " co", n + "x")] + ["nobody"]


def _real_brands(s, d):
    at = F.pmod(F.round(F.col("sale_price") * 100).cast("long"), F.lit(len(_real))).cast("int")
    return products(s, d).withColumn("brand", F.when(F.col("brand").isNotNull(), F.get(F.array(*[F.lit(n) for n in _real]), at)))


register("deal_score_default_tiers", lambda s, d: pricing.scored(_real_brands(s, d)).select("id", F.col("deal_score").cast("long").alias("deal_score")), f"""
SELECT id, CAST(CASE WHEN reject_reason IS NULL THEN {o.score_sql(L.BRAND_TIERS)} ELSE 0 END AS BIGINT) AS deal_score
FROM (SELECT * REPLACE (CASE WHEN brand IS NOT NULL THEN [{', '.join(o.q(n) for n in _real)}][CAST(round(sale_price * 100) AS BIGINT) % {len(_real)} + 1] END AS brand) FROM o_hard) x""")
register("quality_gates", lambda s, d: judged(s, d).select("id", "strict_ok", "relaxed_ok"),
         "SELECT id, strict_ok, relaxed_ok FROM o_judged")
_copy = "|".join(L.SALE_COPY_PATTERNS).replace("'", "''")
register("drop_junk_listings",
         lambda s, d: products(s, d).filter(~pricing.is_junk_listing(F.col("name"), F.col("sale_price"))).select("id", "name"),
         f"""SELECT id, name FROM v_products WHERE COALESCE(sale_price, 0) > 0 AND length(trim(name)) >= 5
             AND lower(trim(name)) NOT IN {o.values_in(L.LABEL_ONLY_NAMES)} AND NOT regexp_matches(name, '{_copy}', 'i')
             AND length(name) - length(replace(name, '%', '')) < 2
             AND NOT (length(name) > 100 AND regexp_matches(name, '[0-9]+%\\s*off', 'i'))""")


def _legacy(s, d):
    w = F.col("weight_value")
    text = F.when(w == F.floor(w), F.floor(w).cast("string")).otherwise(w.cast("string"))
    df = products(s, d).withColumn("weight", F.concat(text, F.col("weight_unit")))
    return df.select("id", pricing.legacy_score().alias("legacy_score"),
                     F.coalesce(pricing.legacy_reject(), F.lit("pass")).alias("legacy_reason"))


register("legacy_score_and_qualify", _legacy, f"""
SELECT id, {o.round_dec('least(40, COALESCE(discount_percent, 0) * CAST(0.67 AS DOUBLE)) + greatest(0, 30 - CASE WHEN sale_price <> 0 THEN sale_price ELSE 30 END) + least(20, CASE WHEN original_price > sale_price THEN original_price - sale_price ELSE 0 END)', 1).replace('DECIMAL(30,10)', 'DECIMAL(12,6)')} AS legacy_score,
  CASE WHEN COALESCE(sale_price, 0) = 0 THEN 'no_price' WHEN sale_price > 30 THEN 'global_cap'
    WHEN category = 'edible' THEN CASE WHEN sale_price NOT BETWEEN 3 AND 9 THEN 'price_window' WHEN w <> '' AND w NOT IN ('100mg','200mg') THEN 'tiny_edible' ELSE disc END
    WHEN category = 'preroll' THEN CASE WHEN sale_price NOT BETWEEN 2 AND 6 THEN 'price_window' ELSE disc END
    WHEN category = 'vape' THEN CASE WHEN sale_price NOT BETWEEN 10 AND 25 THEN 'price_window' ELSE disc END
    WHEN category = 'flower' THEN CASE
        WHEN contains(w, '3.5') THEN CASE WHEN sale_price NOT BETWEEN 10 AND 22 THEN 'price_window' ELSE disc END
        WHEN contains(w, '7') AND NOT contains(w, '14') THEN CASE WHEN sale_price NOT BETWEEN 15 AND 35 THEN 'price_window' ELSE disc END
        WHEN contains(w, '14') THEN CASE WHEN sale_price NOT BETWEEN 20 AND 50 THEN 'price_window' ELSE disc END
        ELSE CASE WHEN sale_price NOT BETWEEN 10 AND 22 THEN 'price_window' ELSE disc END END
    WHEN category = 'concentrate' THEN CASE WHEN w <> '' AND NOT contains(w, '1g') THEN 'weight' WHEN sale_price NOT BETWEEN 9 AND 25 THEN 'price_window' ELSE disc END
    ELSE 'other_category' END AS legacy_reason
FROM (SELECT *, COALESCE(CASE WHEN weight_value = floor(weight_value) THEN CAST(CAST(weight_value AS BIGINT) AS VARCHAR) ELSE CAST(weight_value AS VARCHAR) END || weight_unit, '') AS w,
        CASE WHEN discount_percent < 20 THEN 'low_discount' WHEN discount_percent > 75 THEN 'high_discount' ELSE 'pass' END AS disc FROM v_products) x""")

# --- price distributions ----------------------------------------------------------------------------
register("weight_tier", lambda s, d: products(s, d).select("id", F.coalesce(pricing.weight_tier(F.col("category"), F.col("weight_value")), F.lit("none")).alias("tier")),
         f"SELECT id, COALESCE({o.WEIGHT_TIER}, 'none') AS tier FROM v_products")


def _dist_sql(keys: str, source: str, min_n: int) -> str:
    return f"""SELECT {keys}, MAX(n) AS sample_size, MAX(pc) FILTER (WHERE i = n // 4) / 100 AS p25,
       {o.round_dec('(MAX(pc) FILTER (WHERE i = (n - 1) // 2) + MAX(pc) FILTER (WHERE i = n // 2)) / 200', 2)} AS p50,
       MAX(pc) FILTER (WHERE i = 3 * n // 4) / 100 AS p75, MIN(pc) / 100 AS p_min, MAX(pc) / 100 AS p_max
    FROM {source} GROUP BY {keys} HAVING MAX(n) >= {min_n}"""


o.EXTRA["o_ranked_brand_prices"] = """
SELECT *, row_number() OVER (PARTITION BY brand, region, category, weight_tier ORDER BY pc) - 1 AS i,
       COUNT(*) OVER (PARTITION BY brand, region, category, weight_tier) AS n
FROM o_tiered WHERE is_active AND sale_price > 0 AND weight_tier IS NOT NULL AND COALESCE(brand, '') <> ''
"""
o.EXTRA["o_dist"] = _dist_sql("region, category, weight_tier", "o_ranked_prices", 5)
o.EXTRA["o_brand_dist"] = _dist_sql("brand, region, category, weight_tier", "o_ranked_brand_prices", 3)
register("price_distribution", lambda s, d: prices.price_distribution(products(s, d)), "SELECT * FROM o_dist")
register("brand_pricing", lambda s, d: prices.brand_pricing(products(s, d)), "SELECT * FROM o_brand_dist")
register("cross_region_brands", lambda s, d: prices.cross_region_brands(prices.brand_pricing(products(s, d))),
         """SELECT brand, COUNT(DISTINCT region) AS n_regions, string_agg(DISTINCT region, ',' ORDER BY region) AS regions
            FROM o_brand_dist GROUP BY brand HAVING COUNT(DISTINCT region) >= 2""")
register("enrichment_snapshots",
         lambda s, d: prices.enrichment_snapshots(products(s, d), PRODUCTS_AS_OF[:10]).withColumn("snapshot_date", day_text("snapshot_date"))
         .withColumn("brand", F.coalesce("brand", F.lit("__null__"))),
         """SELECT '2001-08-01' AS snapshot_date, 'price_distribution' AS snapshot_type, '__null__' AS brand, * FROM o_dist
            UNION ALL SELECT '2001-08-01', 'brand_pricing', brand, * EXCLUDE (brand) FROM o_brand_dist""")

# --- ranks and duplicates -----------------------------------------------------------------------------
register("top_100_curated",
         lambda s, d: as_long(ranking.top_100_curated(scored(s, d)), "deal_score").select("id", "name", "category", "dispensary_id", "deal_score", "sale_price"),
         """SELECT id, name, category, dispensary_id, CAST(deal_score AS BIGINT) AS deal_score, sale_price FROM (
              SELECT *, row_number() OVER (PARTITION BY category ORDER BY deal_score DESC, id) AS cr,
                     row_number() OVER (PARTITION BY brand ORDER BY deal_score DESC, id) AS br,
                     row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) AS dr
              FROM o_scored WHERE is_active AND deal_score > 0) r
            WHERE cr <= 30 AND br <= 5 AND dr <= 10 ORDER BY deal_score DESC, id LIMIT 100""")
_norm = r"trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
register("dedup_batch", lambda s, d: ranking.dedup_batch(products(s, d)).select("id", "dispensary_id"),
         f"""SELECT id, dispensary_id FROM v_products QUALIFY row_number() OVER (
             PARTITION BY dispensary_id, {_norm}, weight_value, sale_price ORDER BY id DESC) = 1""")
_strict = lambda s, d: judged(s, d).filter(F.col("passed") & F.col("strict_ok"))
o.EXTRA["o_strict"] = "SELECT * FROM o_judged WHERE passed AND strict_ok"
o.EXTRA["o_similar"] = """SELECT * FROM o_strict QUALIFY row_number() OVER (
  PARTITION BY dispensary_id, CASE WHEN COALESCE(brand, '') = '' THEN 'unknown' ELSE lower(brand) END, category ORDER BY deal_score DESC, id) <= 3"""
o.EXTRA["o_chain_dedup"] = f"""SELECT * FROM o_strict QUALIFY row_number() OVER (
  PARTITION BY {o.CHAIN}, lower(trim(name)), lower(COALESCE(brand, '')), category ORDER BY deal_score DESC, id) = 1"""
register("limit_similar", lambda s, d: ranking.limit_similar(_strict(s, d)).select("id"), "SELECT id FROM o_similar")
register("dedup_cross_chain", lambda s, d: ranking.dedup_cross_chain(_strict(s, d)).select("id"), "SELECT id FROM o_chain_dedup")
_brandless = ("CASE WHEN COALESCE(brand, '') = '' THEN lower(trim(name)) ELSE regexp_replace(lower(trim(name)), "
              r"'\b' || regexp_escape(lower(brand)) || '\b', '', 'g') END")
_key = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _brandless +
        r", '\b(?:indica|sativa|hybrid|indica-hybrid|sativa-hybrid)\b', '', 'g'), '^\.?\d+\.?\d*\s*g\s*\|\s*', ''),"
        r" '\b(?:cartridge|cart|disposable|badder|pre-?roll|gummy|gummies)\b', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))")
register("dedup_global_name", lambda s, d: ranking.dedup_global_name(_strict(s, d)).select("id"),
         f"""SELECT id FROM o_strict QUALIFY row_number() OVER (
             PARTITION BY {_key}, lower(COALESCE(brand, '')), category ORDER BY deal_score DESC, id) = 1""")
_live = lambda s, d: scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0))
o.EXTRA["o_live"] = "SELECT * FROM o_scored WHERE is_active AND deal_score > 0"
register("cap_per_store", lambda s, d: ranking.cap_per_store(_live(s, d), 5).select("id"),
         "SELECT id FROM o_live QUALIFY row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) <= 5")
o.EXTRA["o_chain_cap"] = f"""
SELECT * FROM (SELECT *, CASE WHEN sr = 1 THEN 0 ELSE row_number() OVER (PARTITION BY chain, sr = 1 ORDER BY deal_score DESC, id) END AS rr,
  COUNT(*) FILTER (WHERE sr = 1) OVER (PARTITION BY chain) AS g
  FROM (SELECT *, {o.CHAIN} AS chain, row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) AS sr FROM o_live) a) b
WHERE sr = 1 OR rr + g <= 40"""
register("cap_per_chain", lambda s, d: ranking.cap_per_chain(_live(s, d), 40).select("id", "is_guaranteed"),
         "SELECT id, sr = 1 AS is_guaranteed FROM o_chain_cap")
o.EXTRA["o_brand_cap"] = """
SELECT id FROM (SELECT * FROM o_live WHERE COALESCE(brand, '') <> '' QUALIFY row_number() OVER (
   PARTITION BY brand, CASE WHEN category = 'vape' AND product_subtype = 'disposable' THEN 'disposable' ELSE category END ORDER BY deal_score DESC, id) <= 6) a
QUALIFY row_number() OVER (PARTITION BY brand ORDER BY deal_score DESC, id) <= 18
UNION ALL SELECT id FROM o_live WHERE COALESCE(brand, '') = ''"""
register("cap_per_brand", lambda s, d: ranking.cap_per_brand(_live(s, d), 6, 18).select("id"), "SELECT id FROM o_brand_cap")

# --- leaders, slots, guarantees (per store and day, as the daily job runs it) ---------------------------
GROUP = ["run_date", "dispensary_id"]
STORE = ["dispensary_id"]
o.EXTRA["o_pool"] = f"""
SELECT *, {o.BUCKET} AS bucket, CASE WHEN COALESCE(sale_price, 0) <> 0 THEN sale_price ELSE 999 END AS price FROM o_live"""
o.EXTRA["o_pool_tier"] = """
SELECT *, CASE WHEN COALESCE(weight_value, 0) > 0 THEN
   CASE WHEN bucket = 'flower' THEN CASE WHEN weight_value <= 4 THEN 'eighth' WHEN weight_value <= 8 THEN 'quarter' WHEN weight_value <= 15 THEN 'half' ELSE 'oz' END
        WHEN bucket = 'disposable' THEN CASE WHEN weight_value <= 0.5 THEN 'small' WHEN weight_value < 0.8 THEN 'medium' ELSE 'large' END
        WHEN bucket = 'vape' THEN CASE WHEN weight_value <= 0.6 THEN 'half_gram' ELSE 'full_gram' END END END AS tier,
   COUNT(*) OVER (PARTITION BY dispensary_id, bucket) AS n,
   COUNT(product_subtype) OVER (PARTITION BY dispensary_id, bucket) AS n_sub
FROM o_pool"""
o.EXTRA["o_leader_rank"] = """
SELECT *, CASE WHEN (bucket = 'flower' AND n >= 4) OR (bucket = 'disposable' AND n >= 3) OR (bucket = 'vape' AND n >= 2) THEN 'tier'
               WHEN bucket IN ('concentrate','edible','preroll') AND n >= 2 AND n_sub > 0 THEN 'subtype' ELSE 'cheapest' END AS mode,
   row_number() OVER (PARTITION BY dispensary_id, bucket, tier ORDER BY price, id) AS tr,
   row_number() OVER (PARTITION BY dispensary_id, bucket, product_subtype ORDER BY price, id) AS sr,
   CASE bucket WHEN 'flower' THEN 4 WHEN 'disposable' THEN 3 WHEN 'vape' THEN 2 ELSE 3 END AS fill
FROM o_pool_tier"""
o.EXTRA["o_leader_pick"] = """
SELECT *, row_number() OVER (PARTITION BY dispensary_id, bucket ORDER BY lead DESC, price, id) AS pick FROM (
  SELECT *, CASE WHEN mode = 'tier' AND tier IS NOT NULL AND tr = 1 THEN 1 WHEN mode = 'subtype' AND product_subtype IS NOT NULL AND sr = 1 THEN 1 ELSE 0 END AS lead
  FROM o_leader_rank) x"""
o.EXTRA["o_leaders"] = """
SELECT dispensary_id, bucket, id, row_number() OVER (PARTITION BY dispensary_id, bucket ORDER BY price, id) AS leader_rank, mode
FROM o_leader_pick WHERE (mode = 'subtype' AND lead = 1) OR (mode <> 'subtype' AND pick <= CASE WHEN mode = 'tier' THEN fill ELSE 3 END)"""


def _leaders(s, d):
    return as_long(ranking.bucket_leaders(_live(s, d), STORE), "leader_rank")


register("price_leaders", lambda s, d: _leaders(s, d).filter(F.col("bucket").isin("flower", "disposable", "vape", "other")),
         "SELECT dispensary_id, bucket, id, leader_rank FROM o_leaders WHERE bucket IN ('flower','disposable','vape','other')")
register("subtype_leaders", lambda s, d: _leaders(s, d).filter(F.col("bucket").isin("concentrate", "edible", "preroll")),
         "SELECT dispensary_id, bucket, id, leader_rank FROM o_leaders WHERE bucket IN ('concentrate','edible','preroll')")


def _slots_sql() -> str:
    """Slot allocation written as an unrolled sequence over the fixed bucket order."""
    targets = L.CATEGORY_TARGETS
    goal = "CASE bucket " + " ".join(f"WHEN {o.q(b)} THEN {t}" for b, t in targets.items()) + " END"
    order = sorted((b for b in targets if b != "other"), key=lambda b: (-targets[b], b))
    size = {b: f"COALESCE(n_{b}, 0)" for b in targets}
    o.EXTRA["o_sizes"] = f"SELECT dispensary_id, bucket, COUNT(*) AS bucket_size, {goal} AS goal FROM o_pool GROUP BY dispensary_id, bucket"
    o.EXTRA["o_wide"] = ("SELECT dispensary_id, SUM(bucket_size) AS total, " + ", ".join(
        f"SUM(bucket_size) FILTER (WHERE bucket = {o.q(b)}) AS n_{b}" for b in targets) + " FROM o_sizes GROUP BY dispensary_id")
    prev = ("SELECT *, least(300, total) AS target, least(300, total)" + "".join(f" - least({targets[b]}, {size[b]})" for b in targets)
            + " AS left_0, " + ", ".join(f"least({targets[b]}, {size[b]}) AS s_{b}" for b in targets) + " FROM o_wide")
    for i, b in enumerate(order):
        room = f"greatest(0, least({size[b]}, {int(targets[b] * 1.5)}) - s_{b})"
        prev = (f"SELECT * EXCLUDE (s_{b}), s_{b} + greatest(0, least({room}, left_{i})) AS s_{b}, "
                f"left_{i} - greatest(0, least({room}, left_{i})) AS left_{i + 1} FROM ({prev}) t{i}")
    o.EXTRA["o_slots_first"] = prev
    return f"""SELECT z.dispensary_id, z.bucket, z.bucket_size, CAST(w.total AS BIGINT) AS total_available, CAST(w.target AS BIGINT) AS target,
        CAST(CASE z.bucket {' '.join(f"WHEN {o.q(b)} THEN w.s_{b}" for b in targets)} END AS BIGINT) AS slots
      FROM o_sizes z JOIN o_slots_first w ON w.dispensary_id = z.dispensary_id"""


register("slot_allocation", lambda s, d: ranking.slot_allocation(_live(s, d), STORE), _slots_sql())
register("relaxed_backfill", lambda s, d: ranking.relaxed_backfill(judged(s, d), GROUP).select("id", "strict_ok"), """
WITH sizes AS (SELECT run_date, dispensary_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE passed AND strict_ok) AS k FROM o_judged GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN n >= 200 THEN 5 WHEN n >= 100 THEN 4 WHEN n >= 50 THEN 3 WHEN n >= 10 THEN 2 ELSE 1 END - k AS gap FROM sizes)
SELECT id, strict_ok FROM o_judged WHERE passed AND strict_ok
UNION ALL
SELECT id, strict_ok FROM (SELECT j.id, j.strict_ok, g.gap, row_number() OVER (PARTITION BY j.run_date, j.dispensary_id ORDER BY j.deal_score DESC, j.id) AS rn
  FROM o_judged j JOIN gaps g USING (run_date, dispensary_id) WHERE j.passed AND NOT j.strict_ok AND j.relaxed_ok) x WHERE rn <= gap""")


def _guaranteed(s, d):
    df = products(s, d).select("id", "dispensary_id", "name", "brand", "category", "sale_price")
    need = df.groupBy(*STORE).agg(F.count("*").alias("_n")).select(*STORE, ranking.store_floor(F.col("_n")).alias("n_needed"))
    return as_long(ranking.guaranteed_picks(df, STORE, need, TIERS), "deal_score").select("dispensary_id", "id", "deal_score")


register("guaranteed_picks", _guaranteed, f"""
WITH usable AS (SELECT *, greatest(15, {o.brand_points_sql()} + CASE WHEN sale_price BETWEEN 8 AND 15 THEN 12 WHEN sale_price > 15 AND sale_price <= 25 THEN 10
      WHEN sale_price >= 5 AND sale_price < 8 THEN 8 WHEN sale_price > 25 AND sale_price <= 40 THEN 6 ELSE 0 END
      + CASE WHEN category IN ('flower','vape','edible') THEN 8 WHEN category IN ('concentrate','preroll') THEN 7 ELSE 3 END) AS sc
    FROM v_products WHERE sale_price BETWEEN 3 AND 100 AND length(trim(name)) >= 5 AND NOT regexp_matches(lower(name), '{"|".join(L.MERCH_WORDS)}')),
need AS (SELECT dispensary_id, CASE WHEN COUNT(*) >= 200 THEN 5 WHEN COUNT(*) >= 100 THEN 4 WHEN COUNT(*) >= 50 THEN 3 WHEN COUNT(*) >= 10 THEN 2 ELSE 1 END AS need
    FROM v_products GROUP BY dispensary_id),
marked AS (SELECT *, row_number() OVER (PARTITION BY dispensary_id, category ORDER BY sc DESC, id) = 1 AS head FROM usable),
keyed AS (SELECT *, row_number() OVER (PARTITION BY dispensary_id, name, sale_price ORDER BY head DESC, sc DESC, id) AS kr FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dispensary_id ORDER BY head DESC, sc DESC, id) AS rn FROM keyed WHERE head OR kr = 1)
SELECT dispensary_id, id, CAST(least(25, sc) AS BIGINT) AS deal_score FROM ranked JOIN need USING (dispensary_id) WHERE rn <= need""")
register("top_n_per_category",
         lambda s, d: ranking.top_per_group(ranking.with_buckets(_live(s, d)), ["bucket"], ranking.SCORE_ORDER, 3).select("bucket", "id"),
         "SELECT bucket, id FROM o_pool QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY deal_score DESC, id) <= 3")


def _cut(s, d, group=None, n=10):
    live = cut_lineage(_live(s, d).select("id", "name", "brand", "category", "dispensary_id", "sale_price", "is_active", "deal_score"))
    return ranking.top_cut(live, ranking.top_100_curated(live, stored=True), group, n)


o.EXTRA["o_top100"] = """SELECT name, sale_price FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY deal_score DESC, id) AS cr,
    row_number() OVER (PARTITION BY brand ORDER BY deal_score DESC, id) AS br,
    row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) AS dr FROM o_live) r
  WHERE cr <= 30 AND br <= 5 AND dr <= 10 ORDER BY deal_score DESC, id LIMIT 100"""
o.EXTRA["o_cut"] = "SELECT * FROM o_live a WHERE NOT EXISTS (SELECT 1 FROM o_top100 t WHERE t.name = a.name AND t.sale_price = a.sale_price)"
register("top_cut", lambda s, d: _cut(s, d).select("id", "name"), "SELECT id, name FROM o_cut ORDER BY deal_score DESC, id LIMIT 10")
register("best_cut_per_store", lambda s, d: _cut(s, d, STORE, 1).select("dispensary_id", "id"),
         "SELECT dispensary_id, id FROM o_cut QUALIFY row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) = 1")
register("round_robin_assign",
         lambda s, d: ranking.round_robin_assign(view(s, d, "dispensaries"), 3).select("id", "shard", "position"),
         """SELECT id, (row_number() OVER (PARTITION BY region ORDER BY id) - 1) % 3 + 1 AS shard,
              row_number() OVER (PARTITION BY region ORDER BY turn, platform) AS position
            FROM (SELECT *, row_number() OVER (PARTITION BY region, platform ORDER BY id) AS turn FROM v_dispensaries) t""")
