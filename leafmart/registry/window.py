"""Shop feed, search, distances, curation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart import bridge
from leafmart import lookups as L
from leafmart.functions import pricing
from leafmart.operators import curation as cu
from leafmart.operators import feed as f
from leafmart.operators import listings as ls
from leafmart.operators import maintenance as m
from leafmart.operators import ranking, stored
from leafmart.registry import offers  # noqa: F401  (its checking views are used below)
from leafmart.registry import oracle as o
from leafmart.registry.common import PRODUCTS_AS_OF as NOW
from leafmart.registry.common import TIERS, as_long, day_text, products, scored, view
from leafmart.session import cut_lineage
from leafmart.streaming import jobs

QUERIES, ORACLES = {}, {}
REGION = "michigan"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


register("active_deals", lambda s, d: f.active_deals(scored(s, d), REGION).select("id"), f"""
SELECT id FROM (SELECT * FROM o_live WHERE region = '{REGION}' AND sale_price > 0 ORDER BY deal_score DESC, id LIMIT 500) x
WHERE length(name) >= 5 AND NOT starts_with(dispensary_id, 'zen-leaf')""")
o.EXTRA["o_gone"] = f"""SELECT * FROM (SELECT * FROM o_scored WHERE NOT is_active AND region = '{REGION}' AND deal_score > 0 AND sale_price > 0
  AND scraped_at >= TIMESTAMP '2001-06-20' - INTERVAL '48' HOUR ORDER BY deal_score DESC, id LIMIT 200) x WHERE length(name) >= 5"""
o.EXTRA["o_gone_chain"] = o.EXTRA["o_chain_cap"].replace("o_live", "o_gone").replace("<= 40", "<= 25")
_bucket = "CASE WHEN category = 'vape' AND product_subtype = 'disposable' THEN 'disposable' ELSE category END"


def _brand_cap_sql(src: str, per: int, total: int) -> str:
    g = "CASE WHEN sr = 1 THEN 0 ELSE 1 END"
    return f"""SELECT id FROM (SELECT * FROM {src} WHERE COALESCE(brand, '') <> '' QUALIFY row_number() OVER (PARTITION BY brand, {_bucket} ORDER BY {g}, deal_score DESC, id) <= {per}) a
      QUALIFY row_number() OVER (PARTITION BY brand ORDER BY {g}, deal_score DESC, id) <= {total} UNION ALL SELECT id FROM {src} WHERE COALESCE(brand, '') = ''"""


register("expired_deals", lambda s, d: f.expired_deals(scored(s, d), REGION, "2001-06-20 00:00:00").select("id"), _brand_cap_sql("o_gone_chain", 4, 12))
register("feed_caps", lambda s, d: f.feed_caps(scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0))).select("id"), _brand_cap_sql("o_chain_cap", 6, 18))


def windowed(s, d):
    """Shop rows with weight text."""
    return ls.normalize_deal(products(s, d))


o.EXTRA["o_shop"] = """SELECT *, CASE WHEN weight_value IS NULL THEN '' WHEN weight_value = floor(weight_value) THEN CAST(CAST(weight_value AS BIGINT) AS VARCHAR) || weight_unit
  ELSE CAST(weight_value AS VARCHAR) || weight_unit END AS weight FROM v_products"""
_filtered = """
SELECT id FROM o_shop WHERE category IN ('vape','edible') AND sale_price BETWEEN 5 AND 40 AND (original_price - sale_price) / original_price * 100 >= 30
  AND (regexp_matches(name, '\\bring\\b', 'i') OR regexp_matches(COALESCE(brand, ''), '\\bring\\b', 'i') OR regexp_matches(dispensary_name, '\\bring\\b', 'i') OR contains(weight, 'ring'))"""
register("filter_deals", lambda s, d: f.filter_deals(windowed(s, d), categories=["vape", "edible"], min_price=5, max_price=40, min_discount=30, query="ring").select("id"), _filtered)
register("shop_rows", lambda s, d: f.shop_rows(products(s, d), categories=["vape", "edible"], min_price=5, max_price=40, min_discount=30, query="ring").select("id"), _filtered)
_one_gram = "(weight = '1g' OR (weight_unit = 'g' AND abs(weight_value - 1) < 0.005) OR (weight_unit = 'mg' AND abs(weight_value / 1000 - 1) < 0.005))"
register("weight_filter_feed", lambda s, d: f.weight_filter(windowed(s, d), ["disposable", "1g"], "and").select("id"),
         f"SELECT id FROM o_shop WHERE product_subtype = 'disposable' AND {_one_gram}")
register("shop_rows_by_size", lambda s, d: f.shop_rows(products(s, d), sizes=["disposable", "1g"]).select("id"),
         f"SELECT id FROM o_shop WHERE product_subtype = 'disposable' AND {_one_gram}")
register("weight_filter_search", lambda s, d: f.weight_filter(windowed(s, d), ["disposable", "1/8"], "or").select("id"),
         "SELECT id FROM o_shop WHERE COALESCE(product_subtype, '') = 'disposable' OR abs(CASE weight_unit WHEN 'mg' THEN weight_value / 1000 ELSE weight_value END - 3.5) < 0.005")
LAT, LNG = 36.1716, -115.1391


def _hav(a, b, c, e):
    h = f"(power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({e}) - ({b})) / 2), 2))"
    return f"{L.EARTH_RADIUS_HAVERSINE}::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h}))"


def _near(s, d):
    return f.with_distance(view(s, d, "dispensaries"), LAT, LNG)


o.EXTRA["o_near"] = f"SELECT *, {_hav(f'{LAT}::DOUBLE', f'({LNG})::DOUBLE', 'latitude', 'longitude')} AS miles FROM v_dispensaries"
register("distance_filter", lambda s, d: f.distance_filter(_near(s, d), 5).select("id", f.distance_label(F.col("miles")).alias("label"), F.round(F.col("miles").cast("decimal(20,8)"), 3).cast("double").alias("miles")), """
SELECT id, CASE WHEN miles IS NULL THEN '' WHEN miles < 5 THEN 'Near You' WHEN miles < 10 THEN 'Nearby' WHEN miles < 15 THEN 'Across Town' ELSE 'Far' END AS label,
  CAST(round(CAST(miles AS DECIMAL(20,8)), 3) AS DOUBLE) AS miles FROM o_near WHERE miles IS NULL OR miles < 5""")
_cos = (f"{L.EARTH_RADIUS_COSINE}::DOUBLE * acos(least(1, greatest(-1, cos(radians({LAT}::DOUBLE)) * cos(radians(latitude)) * cos(radians(longitude) - radians(({LNG})::DOUBLE)) "
        f"+ sin(radians({LAT}::DOUBLE)) * sin(radians(latitude)))))")
register("distance_law_of_cosines", lambda s, d: view(s, d, "dispensaries").filter("latitude IS NOT NULL").select("id", F.round(f.law_of_cosines(
    F.lit(LAT), F.lit(LNG), F.col("latitude"), F.col("longitude")).cast("decimal(20,8)"), 1).cast("double").alias("miles")),
    f"SELECT id, CAST(round(CAST({_cos} AS DECIMAL(20,8)), 1) AS DOUBLE) AS miles FROM v_dispensaries WHERE latitude IS NOT NULL")
POINTS = [(f"p{i}", 35.95 + 0.04 * i, -115.28 + 0.03 * ((i * 5) % 12)) for i in range(12)]
_pts = ", ".join(f"('{z}', {a!r}::DOUBLE, ({g!r})::DOUBLE)" for z, a, g in POINTS)
register("distance_to_points", lambda s, d: f.distance_to_points(view(s, d, "dispensaries"), s.createDataFrame(POINTS, "point_id string, lat double, lng double"), 5.0).select(
    "point_id", "store", F.round(F.col("miles").cast("decimal(20,8)"), 3).cast("double").alias("miles")), f"""
SELECT point_id, store, CAST(round(CAST(miles AS DECIMAL(20,8)), 3) AS DOUBLE) AS miles FROM (
  SELECT p.z AS point_id, d.id AS store, {_hav('p.lat', 'p.lng', 'd.latitude', 'd.longitude')} AS miles
  FROM v_dispensaries d, (VALUES {_pts}) p(z, lat, lng) WHERE d.latitude IS NOT NULL) x WHERE miles <= 5""")
register("nearest_reference_point", lambda s, d: f.nearest_reference(view(s, d, "user_contacts"), POINTS, "lat", "lng").groupBy("nearest").agg(F.count("*").alias("n")), f"""
SELECT nearest, COUNT(*) AS n FROM (SELECT c.id, arg_min(p.z, (power(p.lat - c.lat, 2) + power(p.lng - c.lng, 2), p.z)) AS nearest FROM v_user_contacts c, (VALUES {_pts}) p(z, lat, lng) GROUP BY c.id) x GROUP BY nearest""")
for _kind, _sql in {"price_asc": "sale_price", "price_desc": "sale_price DESC", "discount": "(original_price - sale_price) / original_price * 100 DESC", "deal_score": "deal_score DESC"}.items():
    register(f"feed_sort_{_kind}", lambda s, d, k=_kind: f.feed_ranks(scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0)), k).select("id", "position"),
             f"SELECT id, row_number() OVER (ORDER BY {_sql}, id) AS position FROM o_live")
register("feed_sort_distance", lambda s, d: f.feed_ranks(_with_store_distance(s, d), "distance").select("id", "position"),
         "SELECT l.id, row_number() OVER (ORDER BY COALESCE(n.miles, 999), l.id) AS position FROM o_live l JOIN o_near n ON n.id = l.dispensary_id")


def _with_store_distance(s, d):
    near = _near(s, d).select(F.col("id").alias("dispensary_id"), "miles")
    return scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0)).join(near, "dispensary_id")


o.EXTRA["o_found"] = f"""
SELECT * FROM (SELECT * FROM o_scored WHERE is_active AND region = '{REGION}' AND sale_price > 0 AND (discount_percent IS NULL OR discount_percent > 0)
  AND (contains(lower(name), 'ring') OR contains(lower(COALESCE(brand, '')), 'ring') OR contains(category, 'ring') OR contains(COALESCE(product_subtype, ''), 'ring')
       OR contains(lower(COALESCE(strain_type, '')), 'ring')) ORDER BY deal_score DESC, id LIMIT 200) x
WHERE length(name) >= 5 AND NOT regexp_matches(name, {o.q(L.SEARCH_JUNK_PATTERN)}, 'i') AND (regexp_matches(name, '\\bring', 'i') OR regexp_matches(COALESCE(brand, ''), '\\bring', 'i'))"""
_search_sql = f"""
SELECT id FROM o_found WHERE id NOT IN (SELECT id FROM o_scored WHERE is_active AND deal_score > 0 AND region = '{REGION}' ORDER BY deal_score DESC, id LIMIT 50)
ORDER BY CASE WHEN original_price > sale_price THEN (original_price - sale_price) / original_price ELSE 0 END DESC, sale_price, id LIMIT 60"""
register("search", lambda s, d: f.search(scored(s, d), "ring", REGION, f.active_deals(scored(s, d), REGION, 50)).select("id"), _search_sql)
def _indexed(s, d):
    root = jobs.work_folder(s, "index")
    stored.build_search_index(scored(s, d), root)
    offers = stored.stored_offers(s, root)
    return stored.search_index(s, root, "ring", REGION, f.active_deals(offers, REGION, 50)).select("id")


register("search_by_index", _indexed, _search_sql)
register("search_junk_filter", lambda s, d: products(s, d).filter(~F.col("name").rlike("(?i)" + L.SEARCH_JUNK_PATTERN)).select("id"),
         f"SELECT id FROM v_products WHERE NOT regexp_matches(name, {o.q(L.SEARCH_JUNK_PATTERN)}, 'i')")
def _not_curated(s, d):
    offers = cut_lineage(scored(s, d).filter("deal_score > 0").select("id", "category", "brand", "dispensary_id", "is_active", "deal_score"))
    best = ranking.top_100_curated(offers, stored=True).select("id")
    return offers.join(best, "id", "left_anti").groupBy("category").agg(F.count("*").alias("n"))


register("curated_exclusion", _not_curated,
         """SELECT category, COUNT(*) AS n FROM o_scored WHERE deal_score > 0 AND id NOT IN (SELECT id FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY deal_score DESC, id) AS cr, row_number() OVER (PARTITION BY brand ORDER BY deal_score DESC, id) AS br,
    row_number() OVER (PARTITION BY dispensary_id ORDER BY deal_score DESC, id) AS dr FROM o_live) r WHERE cr <= 30 AND br <= 5 AND dr <= 10 ORDER BY deal_score DESC, id LIMIT 100) GROUP BY category""")
register("store_lookup", lambda s, d: f.store_lookup(view(s, d, "dispensaries"), "strip", aliases={"strip": ["chain15-0"]}).select("id"),
         "SELECT id FROM v_dispensaries WHERE regexp_matches(name, '\\bstrip', 'i') OR regexp_matches(address, '\\bstrip', 'i') OR id = 'chain15-0' ORDER BY id LIMIT 8")
register("brand_lookup", lambda s, d: f.brand_lookup(products(s, d).select("brand").filter("brand IS NOT NULL").distinct(), "#1").select("brand"),
         "SELECT DISTINCT brand FROM v_products WHERE contains(lower(brand), '#1') ORDER BY brand LIMIT 6")
register("word_search", lambda s, d: f.word_search(products(s, d), "ring", ["vape", "concentrate"]).select("id", "sale_price"),
         "SELECT id, sale_price FROM v_products WHERE is_active AND category IN ('vape','concentrate') AND regexp_matches(name, '\\bring\\b', 'i') ORDER BY sale_price, id LIMIT 20")
register("word_search_misspelled", lambda s, d: f.word_search(products(s, d), "wi+dget", limit=30, whole=False, without="small").select("id"),
         "SELECT id FROM v_products WHERE is_active AND regexp_matches(name, '\\bwi+dget', 'i') AND NOT regexp_matches(name, 'small', 'i') ORDER BY sale_price, id LIMIT 30")
register("best_price_per_gram", lambda s, d: f.best_price_per_gram(products(s, d), [7.0, 14.0], r"(?:7|quarter|1/4)\s*g").select("id", "price_per_gram"), f"""
SELECT id, {o.round_dec('sale_price / weight_value', 2)} AS price_per_gram FROM v_products WHERE is_active AND category = 'flower' AND weight_unit = 'g'
  AND (weight_value IN (7, 14) OR regexp_matches(name, '(?:7|quarter|1/4)\\s*g', 'i')) ORDER BY price_per_gram NULLS LAST, id LIMIT 20""")
register("multi_brand_search", lambda s, d: f.multi_brand_search(products(s, d), {"brand#3": "Three", "brand#7": "Seven"}, "edible").select("id", "matched_brand"), """
SELECT id, CASE WHEN brand = 'Brand#3' THEN 'Three' WHEN brand = 'Brand#7' THEN 'Seven' ELSE 'Other' END AS matched_brand FROM v_products WHERE is_active AND category = 'edible'
  AND (brand IN ('Brand#3','Brand#7') OR regexp_matches(name, '\\bbrand#[37]\\b', 'i')) ORDER BY matched_brand, sale_price, id LIMIT 30""")


def _catalog(s, d):
    base = m.with_save_count(view(s, d, "deal_catalog"), m.save_counts(view(s, d, "user_saved_deals")))
    recent = view(s, d, "analytics_events").filter("event_name = 'deal_saved' AND created_at >= TIMESTAMP_NTZ '2024-01-29 12:00:00'").groupBy(F.col("k").alias("id")).agg(F.count("*").alias("recent_saves"))
    return base.join(recent, "id", "left").withColumns({
        "recent_saves": F.coalesce("recent_saves", F.lit(0)), "created_at": F.expr("TIMESTAMP_NTZ '2024-01-29 11:00:00' + make_dt_interval(0, CAST(deal_score % 2 AS INT), 0, 0)")})


o.EXTRA["o_catalog"] = """
SELECT c.*, COALESCE(s.n, 0) AS save_count, COALESCE(r.n, 0) AS recent_saves FROM v_deal_catalog c
LEFT JOIN (SELECT deal_id, COUNT(DISTINCT user_id) AS n FROM v_user_saved_deals GROUP BY 1) s ON s.deal_id = c.id
LEFT JOIN (SELECT k, COUNT(*) AS n FROM v_analytics_events WHERE event_name = 'deal_saved' AND created_at >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1) r ON r.k = c.id"""
register("trending_at_store", lambda s, d: ranking.trending_at_store(_catalog(s, d)).select("id", "is_trending"), """
SELECT id, COUNT(*) OVER w >= 3 AND save_count > 1.5 * AVG(save_count) OVER w AS is_trending FROM o_catalog WINDOW w AS (PARTITION BY dispensary_id)""")
register("social_proof", lambda s, d: f.social_proof(_catalog(s, d), "2024-01-29 13:00:00").select("id", "badge", "priority"), """
SELECT id, CASE WHEN save_count >= 25 THEN 'hot_deal' WHEN recent_saves >= 10 THEN 'trending' WHEN save_count >= 10 THEN 'hot_deal' WHEN recent_saves >= 5 THEN 'trending' ELSE 'new_arrival' END AS badge,
  CAST(CASE WHEN save_count >= 25 THEN 100 WHEN recent_saves >= 10 THEN 90 WHEN save_count >= 10 THEN 80 WHEN recent_saves >= 5 THEN 70 ELSE 60 END AS BIGINT) AS priority FROM o_catalog""")
register("new_since", lambda s, d: f.new_since(products(s, d), NOW, "scraped_at", 24).select("id"),
         f"SELECT id FROM v_products WHERE (epoch(TIMESTAMP '{NOW}') - epoch(scraped_at)) / 3600 <= 24")
_zip = " ".join(f"WHEN z BETWEEN {a} AND {b} THEN '{st}'" for a, b, st in L.ZIP3_RANGES)
register("zip_to_state", lambda s, d: view(s, d, "user_contacts").select("id", F.coalesce(f.zip_to_state(F.col("zip_entered")), F.lit("?")).alias("state"), f.legality(f.zip_to_state(F.col("zip_entered"))).alias("legality"),
         F.coalesce(f.nevada_region(F.col("zip_entered")), F.lit("?")).alias("market"), f.region_from_latitude(F.col("lat")).alias("by_latitude")), f"""
SELECT id, COALESCE(st, '?') AS state, CASE WHEN st IN {o.values_in(L.RECREATIONAL_STATES)} THEN 'recreational' WHEN st IN {o.values_in(L.MEDICAL_STATES)} THEN 'medical_only' ELSE 'no_legal' END AS legality,
  CASE WHEN z IN (890, 891, 893, 894) THEN 'southern-nv' WHEN z BETWEEN 895 AND 898 THEN 'northern-nv' ELSE '?' END AS market, CASE WHEN lat > 37.5 THEN 'northern-nv' ELSE 'southern-nv' END AS by_latitude
FROM (SELECT *, CASE {_zip} END AS st FROM (SELECT *, CAST(substr(zip_entered, 1, 3) AS INT) AS z FROM v_user_contacts) a) b""")
register("local_midnight", lambda s, d: view(s, d, "analytics_events").select("id", F.unix_micros(f.next_local_midnight(F.col("created_at"))).alias("midnight_us"), day_text(F.date_trunc("week", "created_at")).alias("monday")), """
SELECT id, epoch_us(date_trunc('day', created_at - INTERVAL '8' HOUR) + INTERVAL '32' HOUR) AS midnight_us, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS monday FROM v_analytics_events""")
register("store_join_left_default", lambda s, d: products(s, d).select("dispensary_id", "id").join(view(s, d, "dispensaries").filter("is_active").select(F.col("id").alias("dispensary_id"), F.col("region").alias("r")), "dispensary_id", "left")
         .groupBy(F.coalesce("r", F.lit("unknown")).alias("region")).agg(F.count("*").alias("n")), """
SELECT COALESCE(d.region, 'unknown') AS region, COUNT(*) AS n FROM v_products p LEFT JOIN v_dispensaries d ON d.id = p.dispensary_id AND d.is_active GROUP BY 1""")

# --- curation ---------------------------------------------------------------------------------------------
o.EXTRA["o_hero"] = """SELECT *, CASE WHEN category = 'edible' AND weight_unit = 'mg' AND weight_value BETWEEN 80 AND 120 THEN 0
  WHEN category = 'vape' AND product_subtype = 'disposable' AND weight_value BETWEEN 0.7 AND 1.1 THEN 1
  WHEN category = 'preroll' AND COALESCE(product_subtype, '') NOT IN ('infused_preroll','preroll_pack') THEN 2 WHEN category = 'flower' AND weight_value BETWEEN 3 AND 4 THEN 3
  WHEN category = 'flower' AND weight_value BETWEEN 6.5 AND 8 THEN 4 WHEN category = 'vape' AND product_subtype = 'disposable' AND weight_value BETWEEN 0.25 AND 0.6 THEN 5
  WHEN category = 'flower' AND weight_value BETWEEN 13 AND 15 THEN 6 END AS slot FROM o_live"""


def _hero_sql() -> str:
    """One scalar choice per slot, each looking at the stores the earlier slots took."""
    parts = ["SELECT DISTINCT region FROM o_live"]
    for k in range(7):
        used = ", ".join(f"COALESCE(s{j}.dispensary_id, '')" for j in range(k)) or "''"
        parts.append(f"LEFT JOIN LATERAL (SELECT id, dispensary_id FROM o_hero h WHERE h.region = r.region AND h.slot = {k} "
                     f"ORDER BY h.dispensary_id IN ({used}), h.sale_price, h.id LIMIT 1) s{k} ON true")
    joins = " ".join(parts[1:])
    return " UNION ALL ".join(f"SELECT r.region, CAST({k} AS BIGINT) AS slot, s{k}.id, s{k}.dispensary_id FROM ({parts[0]}) r {joins} WHERE s{k}.id IS NOT NULL" for k in range(7))


def live(s, d):
    return scored(s, d).filter(F.col("is_active") & (F.col("deal_score") > 0))


register("hero_slots", lambda s, d: as_long(cu.hero_slots(live(s, d), ["region"]), "slot"), _hero_sql())


def _feed(s, d):
    """Feed of every region, at most 500 offers each."""
    return ranking.top_per_group(live(s, d), ["region"], ranking.SCORE_ORDER, 500)


register("tier_shuffle", lambda s, d: cu.tier_shuffle(_feed(s, d), ["region"], "2001-08-01:"))
register("spaced_feed", lambda s, d: cu.spaced_feed(_feed(s, d), ["region"]))
def _featured_sql(n: int = 5) -> str:
    """Picks one after another: by how much is new, then the rate, then the id."""
    ctes = ["c AS (SELECT region, id, category, dispensary_id, (original_price - sale_price) / original_price AS r FROM o_live WHERE original_price > sale_price)",
            "p0 AS (SELECT DISTINCT region, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS stores, CAST([] AS VARCHAR[]) AS cats FROM c)"]
    for k in range(n):
        stale = "CASE WHEN list_contains(p.stores, c.dispensary_id) THEN 2 WHEN list_contains(p.cats, c.category) THEN 1 ELSE 0 END"
        ctes.append(f"""q{k} AS (SELECT c.region, arg_min({{'i': c.id, 's': c.dispensary_id, 'c': c.category, 'k': {stale}}}, ({stale}, -c.r, c.id)) AS x
  FROM c JOIN p{k} p ON p.region = c.region WHERE NOT list_contains(p.ids, c.id) GROUP BY c.region)""")
        ctes.append(f"""p{k + 1} AS (SELECT p.region, list_append(p.ids, x.i) AS ids, list_append(p.stores, x.s) AS stores,
  CASE WHEN x.k = 0 THEN list_append(p.cats, x.c) ELSE p.cats END AS cats FROM p{k} p JOIN q{k} q ON p.region = q.region)""")
    return f"WITH {', '.join(ctes)} SELECT region, ids[i] AS id, CAST(i AS BIGINT) AS position FROM p{n}, unnest(range(1, {n + 1})) AS t(i)"


register("featured_by_discount", lambda s, d: cu.featured_by_discount(live(s, d), ["region"]), _featured_sql())
_unposted = lambda s, d: live(s, d).withColumn("is_posted", F.col("original_price") * 100 % 4 == 0)


def _queue_sql(turns: int = 8) -> str:
    """The queue one post after another; each turn starts one category further on."""
    has = lambda *words: "(" + " OR ".join(f"contains(n, {o.q(w)})" for w in words) + ")"
    gram = f"((un = 'g' AND w BETWEEN 0.9 AND 1.1) OR {has('1g', '1 g')})"
    fits = f"""CASE category WHEN 'vape' THEN (contains(sub, 'disposable') OR {has('disposable', 'dispo', 'all-in-one', 'aio')}) AND {gram}
      WHEN 'flower' THEN CASE WHEN un IN ('g', 'oz') THEN w BETWEEN 3.4 AND 3.6 OR w BETWEEN 6.9 AND 7.1 OR {has('3.5g', '3.5 g', 'eighth', '1/8', '7g', '7 g', 'quarter', '1/4')}
        ELSE {has('3.5g', '3.5 g', '7g', '7 g', 'eighth', 'quarter')} END
      WHEN 'edible' THEN (un = 'mg' AND w >= 100) OR {has('100mg', '200mg', '250mg', '300mg', '500mg')}
      WHEN 'concentrate' THEN (contains(sub, 'live') OR contains(sub, 'rosin') OR contains(sub, 'badder') OR {has('live resin', 'live rosin', 'badder')}) AND {gram}
      WHEN 'preroll' THEN COALESCE(TRY_CAST(NULLIF(regexp_extract(name, '([0-9]+)\\s*(?:pk|pack|ct|count)', 1, 'i'), '') AS INT), 1) <= 2 ELSE false END"""
    ctes = [
        f"""u AS (SELECT id, category, deal_score AS score, lower(trim(COALESCE(brand, 'unknown'))) AS b FROM (
      SELECT *, lower(COALESCE(name, '')) AS n, lower(COALESCE(product_subtype, '')) AS sub, lower(COALESCE(weight_unit, '')) AS un, COALESCE(weight_value, 0) AS w FROM o_live
      WHERE original_price * 100 % 4 <> 0 AND deal_score >= 50 ORDER BY deal_score DESC, id LIMIT 200) x
    WHERE region = '{REGION}' AND COALESCE(sale_price, original_price) <= 35 AND COALESCE(sale_price, original_price) > 0 AND {fits})""",
        "td AS (SELECT COUNT(*) AS n, list(DISTINCT lower(trim(brand))) AS used FROM (SELECT * FROM o_live WHERE run_date = DATE '2001-07-31' ORDER BY deal_score DESC, id LIMIT 3) x)",
        f"tu AS (SELECT list(c ORDER BY k) AS cats FROM (VALUES {', '.join(f'({k}, {o.q(c)})' for k, c in enumerate(cu.POST_BUCKETS))}) t(k, c) WHERE c IN (SELECT category FROM u))",
        "p0 AS (SELECT CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS bs)"]
    for k in range(turns):
        wait = f"((list_position(tu.cats, u.category) - 1 - {k}) % len(tu.cats) + len(tu.cats)) % len(tu.cats)"
        ctes.append(f"""q{k} AS (SELECT arg_min({{'i': u.id, 'b': u.b}}, ({wait}, -u.score, u.id)) AS x FROM u, td, tu, p{k} p
  WHERE {k} < {turns} - td.n AND NOT COALESCE(list_contains(td.used, u.b), false) AND NOT list_contains(p.bs, u.b))""")
        ctes.append(f"p{k + 1} AS (SELECT CASE WHEN x IS NULL THEN ids ELSE list_append(ids, x.i) END AS ids, CASE WHEN x IS NULL THEN bs ELSE list_append(bs, x.b) END AS bs FROM p{k}, q{k})")
    return f"WITH {', '.join(ctes)} SELECT unnest(ids) AS id, CAST(unnest(range(1, len(ids) + 1)) AS BIGINT) AS position FROM p{turns}"


register("post_queue", lambda s, d: cu.post_queue(_unposted(s, d), ranking.top_n(live(s, d).filter("run_date = DATE '2001-07-31'"), ranking.SCORE_ORDER, 3), REGION), _queue_sql())

# --- streaming --------------------------------------------------------------------------------------------


def _pieces(s, d, table, key, n=4):
    """A stream over the table in ``n`` files, one a batch; the pieces are ranges of a hash, so late rows are common."""
    rows = bridge.base_table(s, d, table)
    folder = jobs.work_folder(s, table)
    rows.withColumn("piece", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "piece").write.partitionBy("piece").parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _stream(s, d, name="analytics_events", table="events", key="event_id"):
    return s.sql(bridge.with_views(f"SELECT * FROM v_{name}", spark_sql=True), **{table: _pieces(s, d, table, key)})


def _run_feed(s, d):
    src = _pieces(s, d, "orders", "o_orderkey")
    # a run reports as running first and as finished later; rows of a customer stand for one run id
    rows = src.select((F.col("o_custkey")).alias("id"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    root = jobs.work_folder(s, "runs")
    jobs.run_state_feed(rows, root)
    return jobs.latest(s, root).select("id", "status")


register("run_state_feed", _run_feed, "SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")


def _sessions(s, d):
    root = jobs.work_folder(s, "sessions")
    jobs.session_touch(_stream(s, d), root)
    out = jobs.latest(s, root)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("user_id", us("first_seen").alias("first_seen"), us("last_seen").alias("last_seen"), F.coalesce("touch.source", F.lit("")).alias("source"))


register("session_touch", _sessions, """
SELECT anon_id AS user_id, epoch_us(MIN(created_at)) AS first_seen, epoch_us(MAX(created_at)) AS last_seen,
  COALESCE(arg_min(utm_source, (created_at, id)) FILTER (WHERE event_name = 'app_loaded' AND utm_source IS NOT NULL), '') AS source FROM v_analytics_events GROUP BY anon_id""")
register("session_milestones", lambda s, d: jobs.session_milestones(view(s, d, "analytics_events")).withColumn("day", day_text("day")), """
SELECT user_id, day, sec AS seconds, CAST((sec >= 60)::INT + (sec >= 180)::INT + (sec >= 300)::INT + (sec >= 600)::INT AS BIGINT) AS milestones FROM (
  SELECT anon_id AS user_id, strftime(created_at, '%Y-%m-%d') AS day, CAST(floor(epoch(MAX(created_at))) - floor(epoch(MIN(created_at))) AS BIGINT) AS sec FROM v_analytics_events GROUP BY 1, 2) x""")


def _ingest(s, d):
    root = jobs.work_folder(s, "ingest")
    jobs.event_ingest(_stream(s, d), root, cap=2)
    # which two events of a day are first depends on the order of arrival, how many are accepted does not
    return jobs.accepted_events(s, root).groupBy("anon_id", "day").agg(F.count("*").alias("n"))


register("event_ingest", _ingest, "SELECT anon_id, strftime(created_at, '%Y-%m-%d') AS day, least(2, COUNT(*)) AS n FROM v_analytics_events GROUP BY 1, 2")


def _saves(s, d, slide):
    root = jobs.work_folder(s, "saves")
    jobs.window_saves(_stream(s, d), root, "1 hour", slide, delay="400 days")
    return jobs.latest(s, root).select("deal_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "saves")


_save_events = "SELECT k AS deal_id, created_at FROM v_analytics_events WHERE event_name = 'deal_saved'"
register("hourly_saves", lambda s, d: _saves(s, d, None), f"""
SELECT deal_id, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M') AS window_start, COUNT(*) AS saves FROM ({_save_events}) x GROUP BY 1, 2""")
register("sliding_saves", lambda s, d: _saves(s, d, "5 minutes"), f"""
SELECT deal_id, strftime(to_timestamp(300 * (CAST(floor(epoch(created_at)) AS BIGINT) // 300 - i)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS window_start, COUNT(*) AS saves
FROM ({_save_events}) x, unnest(range(0, 12)) AS t(i) GROUP BY 1, 2""")
