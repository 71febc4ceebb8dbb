"""Listing text jobs and brand detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmart.functions import text as t
from leafmart.functions.pricing import chain_of, strip_shard, strip_shard_sql
from leafmart.operators import brands as b
from leafmart.operators import listings as ls
from leafmart.registry import oracle as o
from leafmart.registry.common import day_text, products, view
from leafmart.session import cut_lineage

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = o.sql(sql)


def raw(s, d):
    return view(s, d, "raw_listings")


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def num(text: str, pattern: str, n: int = 1, flags: str = "i") -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({text}, {rx(pattern)}, {n}, '{flags}'), '') AS DOUBLE)"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rx(pattern)})"


def any_word(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {o.q(w)})" for w in words) + ")"


# --- prices ---------------------------------------------------------------------------------------------
AM = f"list_transform(regexp_extract_all(tx, {rx(t.AMOUNT)}, 1), lambda x: CAST(x AS DOUBLE))"
_rest = f"regexp_replace(tx, {rx(t.BUNDLE)}, ' | ')"
_plain = f"regexp_replace(regexp_replace(tx, {rx(t.OFF_LABEL)}, '', 'gi'), {rx(t.FROM_PRICE)}, '', 'gi')"
o.EXTRA["o_px0"] = f"""
SELECT id, price AS tx, {num('price', t.WAS_NOW_OFF, 1)} AS o1, {num('price', t.WAS_NOW_OFF, 2)} AS off1, {num('price', t.WAS_NOW, 1)} AS o2, {num('price', t.WAS_NOW, 2)} AS s2,
  {num('price', t.BUNDLE_TIER, 2)} AS bt, {num('price', t.BUNDLE_TIER, 3)} AS tier, {num('price', t.BUNDLE, 1)} AS qty, {num('price', t.BUNDLE, 2)} AS bundle FROM v_raw_listings"""
o.EXTRA["o_px1"] = f"""
SELECT *, {AM} AS am, {AM.replace('tx', _rest, 1)} AS outside, {AM.replace('tx', _plain, 1)} AS plain,
  list_transform(regexp_extract_all(tx, {rx(t.OFF_LABEL)}, 1, 'i'), lambda x: CAST(x AS DOUBLE)) AS labels FROM o_px0"""
o.EXTRA["o_px2"] = f"""
SELECT id, CASE WHEN {o.round_dec('o1 - off1', 2)} > 3 THEN 'was_now_off' WHEN o2 IS NOT NULL THEN 'was_now' WHEN bt IS NOT NULL THEN 'bundle_tier' WHEN bundle IS NOT NULL THEN 'bundle'
    WHEN regexp_matches(tx, '\\bbogo\\b', 'i') THEN 'bogo' WHEN len(plain) >= 2 THEN 'two_prices' WHEN len(plain) = 1 AND {o.round_dec('plain[1] - labels[1]', 2)} > 3 THEN 'off_label'
    WHEN len(plain) = 1 THEN 'single' ELSE 'none' END AS strategy, * EXCLUDE (id) FROM o_px1"""
_disc = lambda og, sl: f"CASE WHEN {og} > 0 THEN {o.round_dec(f'(1 - {sl} / {og}) * 100', 1)} END"
_unit = o.round_dec("bundle / qty", 2)
o.EXTRA["o_px3"] = f"""
SELECT id, strategy, CASE strategy WHEN 'was_now_off' THEN o1 WHEN 'was_now' THEN o2 WHEN 'bundle_tier' THEN greatest(bt, tier)
     WHEN 'bundle' THEN CASE WHEN len(outside) > 0 THEN greatest(outside[-1], {_unit}) END WHEN 'bogo' THEN am[-1] WHEN 'two_prices' THEN list_max(plain)
     WHEN 'off_label' THEN plain[1] END AS og,
  CASE strategy WHEN 'was_now_off' THEN {o.round_dec('o1 - off1', 2)} WHEN 'was_now' THEN s2 WHEN 'bundle_tier' THEN least(bt, tier)
     WHEN 'bundle' THEN CASE WHEN len(outside) > 0 THEN least(outside[-1], {_unit}) ELSE {_unit} END WHEN 'bogo' THEN {o.round_dec('am[-1] / 2', 2)}
     WHEN 'two_prices' THEN list_min(plain) WHEN 'off_label' THEN {o.round_dec('plain[1] - labels[1]', 2)} WHEN 'single' THEN plain[1] END AS sl FROM o_px2"""
o.EXTRA["o_px4"] = f"SELECT *, CASE WHEN strategy = 'bogo' THEN 50.0 WHEN og IS NOT NULL THEN {_disc('og', 'sl')} END AS dc FROM o_px3"
register("extract_prices", lambda s, d: raw(s, d).withColumn("_p", t.extract_prices(F.col("price"))).select("id", "_p.*"),
         "SELECT id, strategy, og AS original_price, sl AS sale_price, CAST(dc AS DOUBLE) AS discount_percent FROM o_px4")
register("validate_prices", lambda s, d: ls.with_prices(raw(s, d), "price").select("id", "original_price", "sale_price", "discount_percent"), f"""
WITH a AS (SELECT *, COALESCE(sl > 0 AND og > sl AND sl < 10 AND sl / og < 0.25::DOUBLE AND og - sl > 3, false) AS mis FROM o_px4),
b AS (SELECT id, og, CASE WHEN mis THEN og - sl ELSE sl END AS s1, CASE WHEN mis THEN {_disc('og', '(og - sl)')} ELSE CAST(dc AS DOUBLE) END AS d1 FROM a),
c AS (SELECT id, CASE WHEN og < s1 THEN s1 ELSE og END AS o2, CASE WHEN og < s1 THEN og ELSE s1 END AS s2, CASE WHEN og < s1 THEN {_disc('s1', 'og')} ELSE d1 END AS d2 FROM b)
SELECT id, CASE WHEN o2 = s2 THEN NULL ELSE o2 END AS original_price, s2 AS sale_price, CASE WHEN o2 = s2 THEN NULL ELSE d2 END AS discount_percent FROM c""")
register("price_strategy_coverage", lambda s, d: ls.price_strategy_coverage(raw(s, d)), "SELECT strategy, COUNT(*) AS n FROM o_px4 GROUP BY strategy")

# --- weights, cannabinoids, categories --------------------------------------------------------------------
_named = "CASE WHEN regexp_matches(lower(tx), '\\beighth\\b') THEN 3.5 WHEN regexp_matches(lower(tx), '\\bquarter\\b') THEN 7 WHEN regexp_matches(lower(tx), '\\bhalf\\b') THEN 14 END"
o.EXTRA["o_wt"] = f"""
SELECT id, tx, regexp_extract(tx, {rx(t.FRACTION)}, 1, 'i') AS fr, {num('tx', t.METRIC, 1)} AS v, lower(regexp_extract(tx, {rx(t.METRIC)}, 2, 'i')) AS u,
  regexp_matches(tx, {rx(t.DRINK)}, 'i') AS drink, {num('tx', r'([0-9]*\.?[0-9]+)\s*mg\b')} AS mg, {_named} AS nm FROM (SELECT id, raw_text AS tx FROM v_raw_listings) x"""
register("extract_weight", lambda s, d: ls.with_weight(raw(s, d), "raw_text").select("id", "weight_value", "weight_unit"), f"""
SELECT id, CAST(CASE WHEN fr <> '' THEN CASE fr WHEN '1/8' THEN 3.5 WHEN '1/4' THEN 7 ELSE 14 END WHEN u = 'oz' AND drink THEN mg WHEN u = 'mg' THEN v
    WHEN v IS NOT NULL THEN CASE WHEN g > 2 AND {any_word('lower(tx)', t.VAPE_HINTS)} THEN g / 10 ELSE g END ELSE nm END AS DOUBLE) AS weight_value,
  CASE WHEN fr <> '' THEN 'g' WHEN u = 'oz' AND drink THEN CASE WHEN mg IS NOT NULL THEN 'mg' END WHEN u = 'mg' THEN 'mg' WHEN v IS NOT NULL OR nm IS NOT NULL THEN 'g' END AS weight_unit
FROM (SELECT *, CASE WHEN u = 'oz' THEN {o.round_dec('v * 28', 1)} ELSE v END AS g FROM o_wt) y""")
_cb = lambda n: (lambda p: f"COALESCE({num('raw_text', p, 1)}, {num('raw_text', p, 2)})")(rf"(?:([0-9]+(?:\.[0-9]+)?)\s*%\s*{n})|(?:{n}\s*:?\s*([0-9]+(?:\.[0-9]+)?)\s*%)")
register("extract_cannabinoids", lambda s, d: ls.with_cannabinoids(raw(s, d), "raw_text").select("id", "thc_percent", "cbd_percent"),
         f"SELECT id, {_cb('THC')} AS thc_percent, {_cb('CBD')} AS cbd_percent FROM v_raw_listings")


def category_sql(x: str) -> str:
    cone = f"({has(x, r'\bcones?\b')} AND NOT {has(x, r'\b(?:infused|thc|live resin)\b')} AND ({' OR '.join(has(x, p) for p in t.CONE_EXTRAS)}))"
    vape, mg = has(x, t.VAPE_PATTERN), has(x, r"\b[0-9]+\s*mg\b")
    weighed = f"({any_word(x, t.CONCENTRATE_WEIGHTS)} OR {has(x, r'\b1/[248]\s*(?:oz)?\b')})"
    return f"""CASE WHEN {x} = '' THEN 'other' WHEN {any_word(x, t.SKIP_WORDS)} OR {cone} OR {has(x, r'\bcream\b.*[0-9]+:[0-9]+')} THEN 'skip'
      WHEN {any_word(x, t.DRINK_WORDS)} THEN 'edible' WHEN {any_word(x, t.PREROLL_WORDS)} OR {has(x, r"\bpr'?s?\b")} OR {has(x, r'[0-9]+\.?[0-9]*\s*g\s*/\s*[0-9]+\s*pk\b')} THEN 'preroll'
      WHEN {any_word(x, t.CONCENTRATE_WORDS)} AND NOT {vape} AND ({weighed} OR {any_word(x, t.SURE_CONCENTRATE_WORDS)}) THEN 'concentrate'
      WHEN {has(x, r'\b(?:3\.5|7|14|28)\s*g\b')} AND NOT {vape} THEN 'flower' WHEN {vape} AND NOT {any_word(x, t.EDIBLE_WORDS)} THEN 'vape'
      WHEN {any_word(x, t.FLOWER_WORDS)} THEN 'flower' WHEN {any_word(x, t.EDIBLE_WORDS)} THEN 'edible' WHEN {has(x, t.SMALL_EDIBLE_PATTERN)} AND {mg} THEN 'edible'
      WHEN {mg} THEN 'edible' WHEN {has(x, r'\b0\.[5-9]\s*g\b')} AND NOT {vape} THEN 'concentrate' ELSE 'other' END"""


register("detect_category", lambda s, d: raw(s, d).select("id", t.detect_category(F.col("raw_text")).alias("category")),
         f"SELECT id, {category_sql('lower(raw_text)')} AS category FROM v_raw_listings")
_weights = lambda s, d: products(s, d).select("id", "category", F.concat(F.col("weight_value").cast("string"), F.col("weight_unit")).alias("w"))
o.EXTRA["o_w"] = "SELECT id, category, CAST(weight_value AS VARCHAR) || weight_unit AS w, weight_value AS v, weight_unit AS u FROM v_products"
_gt = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END || 'g'"
o.EXTRA["o_w_valid"] = f"""
SELECT id, category, w, v, u, CASE category WHEN 'preroll' THEN CASE WHEN u = 'g' AND v = 1 THEN '1g' END
  WHEN 'vape' THEN CASE WHEN u = 'g' AND v BETWEEN 0.3 AND 2 THEN {_gt} WHEN u = 'mg' AND v BETWEEN 200 AND 1000 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || 'mg' END
  WHEN 'flower' THEN CASE WHEN u = 'g' AND v = 0.35 THEN '3.5g' WHEN u = 'g' AND v = 0.7 THEN '7g' WHEN u = 'g' AND v BETWEEN 0.5 AND 28 THEN {_gt} END
  WHEN 'edible' THEN CASE WHEN u = 'mg' AND v BETWEEN 82 AND 118 THEN '100mg' WHEN u = 'mg' AND v BETWEEN 180 AND 220 THEN '200mg' END
  WHEN 'concentrate' THEN CASE WHEN u = 'g' AND v BETWEEN 0.5 AND 2 THEN {_gt} END
  ELSE CASE WHEN u = 'g' AND v BETWEEN 0.3 AND 28 THEN {_gt} WHEN u = 'mg' AND v = 100 THEN '100mg' END END AS valid FROM o_w"""
register("validate_weight", lambda s, d: _weights(s, d).select("id", F.coalesce(t.validate_weight(F.col("w"), F.col("category")), F.lit("-")).alias("weight")),
         "SELECT id, COALESCE(valid, '-') AS weight FROM o_w_valid")
_lo = "CASE category " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in t.WEIGHT_RULES.items()) + " ELSE 0.5 END"
_hi = "CASE category " + " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in t.WEIGHT_RULES.items()) + " ELSE 28 END"
_scaled = lambda s, d: _weights(s, d).withColumn("w", F.concat(t.number(F.col("w"), r"([0-9.]+)") * F.when(F.col("category") == "vape", 5).otherwise(0.1), F.lit("g")))
register("correct_weight", lambda s, d: t.with_correct_weight(_scaled(s, d), "w", "category").select("id", "value", "unit", "is_valid", "was_corrected"), f"""
WITH a AS (SELECT id, category, v * CASE WHEN category = 'vape' THEN 5 ELSE CAST(0.1 AS DOUBLE) END AS x, CAST({_lo} AS DOUBLE) AS lo, CAST({_hi} AS DOUBLE) AS hi FROM o_w),
b AS (SELECT *, COALESCE(x < lo AND x * 10 BETWEEN lo AND hi, false) AS up, COALESCE(x > hi AND x / 10 BETWEEN lo AND hi, false) AS dn FROM a),
c AS (SELECT *, CASE WHEN up THEN x * 10 WHEN dn THEN x / 10 ELSE x END AS y FROM b)
SELECT id, CASE WHEN x > 0 THEN y END AS value, CASE WHEN x > 0 THEN CASE WHEN category = 'edible' AND y >= 5 THEN 'mg' ELSE 'g' END END AS unit,
  CASE WHEN x > 0 THEN y BETWEEN lo AND hi END AS is_valid, CASE WHEN x > 0 THEN up OR dn OR (category = 'edible' AND y >= 5) END AS was_corrected FROM c""")

# --- names ------------------------------------------------------------------------------------------------
_chain = [t.NAME_JUNK, t.BUNDLE_PROMO, t.STRAIN_END, t.STRAIN_START, t.TIER_LABEL, t.PREPACK, t.CANNABINOID_TEXT]


def strip_sql(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {rx(p)}, '', 'gi')"
    return x


_cn = strip_sql("name", _chain)
_cn = f"regexp_replace(regexp_replace({_cn}, '([0-9]+\\s*mg)\\s*mg\\b', '\\1', 'gi'), '(Indica|Sativa|Hybrid)\\s*mg\\b', '\\1', 'gi')"
_cn = strip_sql(_cn, [*t.RIBBONS, t.PRICE_START, t.PRICE_REST])
_cn = f"trim(trim(regexp_replace({_cn}, '\\s{{2,}}', ' ', 'g')), '.,;:-|')"
_cn = strip_sql(_cn, [t.BRACKET_WEIGHT, t.PAREN_WEIGHT_END])
o.EXTRA["o_clean"] = f"SELECT *, CASE WHEN length(c) >= 3 THEN c ELSE trim(name) END AS clean FROM (SELECT *, trim(regexp_replace({_cn}, '\\s{{2,}}', ' ', 'g')) AS c FROM v_raw_listings) x"
register("clean_name", lambda s, d: t.with_clean_name(raw(s, d), "name", "clean").select("id", "clean"), "SELECT id, clean FROM o_clean")
_offer = t.OFFER_PATTERN
o.EXTRA["o_offer_free"] = f"SELECT *, trim(regexp_replace(raw_text, {rx(_offer)}, '', 'g')) AS offer_free FROM o_clean"
register("strip_offer_text", lambda s, d: raw(s, d).select("id", t.strip_offer_text(F.col("raw_text")).alias("rest")), "SELECT id, offer_free AS rest FROM o_offer_free")
o.EXTRA["o_dn1"] = f"SELECT *, trim({strip_sql('name', [t.WEIGHT_PREFIX])}) AS d1 FROM v_raw_listings"
o.EXTRA["o_dn2"] = r"""SELECT *, CASE WHEN COALESCE(scraped_brand, '') <> '' AND d1 <> ''
  THEN trim(regexp_replace(d1, '\b(?:' || regexp_escape(scraped_brand) || ')\b\s*[-:|]?\s*', '', 'gi')) ELSE d1 END AS d3 FROM o_dn1"""


def _display_sql() -> str:
    """The steps one inside the other, from the brand-free name on."""
    x = "CASE WHEN d3 <> '' THEN d3 WHEN name <> '' THEN name ELSE 'Unknown' END"
    for p in (t.STRAIN_WORD, t.BUNDLE_QTY):
        x = f"trim({strip_sql(x, [p])})"
    o.EXTRA["o_dn3"] = f"SELECT *, {x} AS d4 FROM o_dn2"
    words = " ".join(f"WHEN {o.q(k)} THEN {strip_sql('d4', [p])}" for k, p in t.CATEGORY_WORDS.items())
    o.EXTRA["o_dn4"] = f"SELECT *, trim(CASE scraped_category {words} ELSE d4 END) AS d5 FROM o_dn3"
    x = "d5"
    for p in t.DISPLAY_STRIPS:
        x = f"trim({strip_sql(x, [p])})"
    x = f"trim({strip_sql(f'trim({strip_sql(x, t.DISPLAY_PARENS)})', [t.RATIO])})"
    for p in (r"\s*\(?\s*[ISH]\s*/\s*[ISH]\s*\)?\s*", r"\s*\(\s*\)\s*", r"\s{2,}"):
        x = f"trim(regexp_replace({x}, {rx(p)}, ' ', 'g'))"
    return f"SELECT id, CASE WHEN d6 <> '' THEN d6 WHEN name <> '' THEN name ELSE 'Unknown' END AS display FROM (SELECT *, trim({x}, ' -–—|/') AS d6 FROM o_dn4) z"


register("display_name", lambda s, d: t.with_display_name(raw(s, d).withColumn("b", F.col("scraped_brand")), "name", "b", "scraped_category", "raw_text", "display").select("id", "display"), _display_sql())


def classify_sql(n: str, brand: str, c: str, w: str) -> str:
    return f"""SELECT id, infused AS is_infused, COALESCE(CASE WHEN infused THEN 'infused_preroll' WHEN pack THEN 'preroll_pack' END, sub, rescue) AS product_subtype,
      CASE WHEN sub IS NULL AND NOT infused AND NOT pack AND rescue IS NOT NULL THEN 'vape' WHEN {c} = 'flower' AND {w} BETWEEN 0.5 AND 1.5 THEN 'preroll'
           WHEN pack AND NOT contains({c}, 'preroll') AND {c} <> '' THEN 'preroll' WHEN infused AND {c} = 'concentrate' THEN 'preroll' END AS corrected_category"""


_n, _c = "lower(name)", "category"
_conc = "CASE " + " ".join(f"WHEN {has(_n, p)} THEN '{v}'" for p, v in t.CONCENTRATE_SUBTYPES) + " END"
_edib = "CASE " + " ".join(f"WHEN {has(_n, p)} THEN '{v}'" for p, v in t.EDIBLE_SUBTYPES) + " END"
o.EXTRA["o_cls"] = f"""
SELECT *, NOT infused AND category NOT IN ('edible','concentrate','vape') AND NOT {any_word(_n, t.EDIBLE_CONTEXT)} AND NOT {any_word(_n, t.ACCESSORIES)} AND {has(_n, t.PACK)} AS pack,
  CASE category WHEN 'vape' THEN CASE WHEN {has(_n, t.DISPOSABLE)} THEN 'disposable' WHEN {has(_n, t.POD)} THEN 'pod' WHEN {has(_n, t.CARTRIDGE)} THEN 'cartridge'
       WHEN {has(_n, r'\bpen\b')} AND NOT {has(_n, t.NOT_DISPOSABLE)} THEN 'disposable' END WHEN 'concentrate' THEN {_conc} WHEN 'edible' THEN {_edib} END AS sub,
  CASE WHEN category <> 'vape' THEN CASE WHEN {has(_n, t.DISPOSABLE)} THEN 'disposable' WHEN {has(_n, t.CARTRIDGE)} THEN 'cartridge' WHEN {has(_n, t.POD)} THEN 'pod' END END AS rescue
FROM (SELECT r.id, r.name, r.scraped_category AS category, p.weight_value, {has('lower(r.name)', t.INFUSED)} AS infused FROM v_raw_listings r JOIN v_products p ON p.id = r.id) x"""


def _classified(s, d):
    df = raw(s, d).join(products(s, d).select("id", "weight_value"), "id")
    return df.withColumn("_c", t.classify_product(F.col("name"), F.col("scraped_brand"), F.col("scraped_category"), F.col("weight_value"))).select("id", "_c.*")


register("classify_product", _classified, classify_sql("name", "brand", "category", "weight_value") + " FROM o_cls")
register("unit_price", lambda s, d: products(s, d).select("id", ls.unit_price(F.col("sale_price"), F.concat(ls.number_text(F.col("weight_value")), F.col("weight_unit")), F.col("category")).alias("unit_price")), f"""
SELECT id, CASE WHEN u = 'g' AND category IN ('flower','vape','concentrate','preroll') THEN printf('$%.2f/g', {o.round_dec('sale_price / v', 2)})
   WHEN u = 'mg' AND category = 'edible' THEN printf('$%.2f/10mg', {o.round_dec('sale_price / v * 10', 2)}) END AS unit_price
FROM (SELECT id, category, sale_price, weight_value AS v, weight_unit AS u FROM v_products) x""")
register("price_per_gram", lambda s, d: products(s, d).filter("weight_unit = 'g'").select("id", F.round((F.col("sale_price") / F.col("weight_value")).cast("decimal(30,10)"), 2).cast("double").alias("ppg")),
         f"SELECT id, {o.round_dec('sale_price / weight_value', 2)} AS ppg FROM v_products WHERE weight_unit = 'g'")
register("normalize_deal", lambda s, d: ls.normalize_deal(products(s, d)).select("id", "category", "weight", "brand_name", "brand_id"), """
SELECT id, CASE WHEN category = 'other' THEN 'flower' ELSE category END AS category,
  CASE WHEN v IS NULL THEN nw ELSE CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END || u END AS weight,
  COALESCE(brand, 'Unknown') AS brand_name, lower(COALESCE(brand, 'Unknown')) AS brand_id
FROM (SELECT id, category, brand, weight_value AS v, weight_unit AS u, '' AS nw FROM v_products) x""")
register("strip_shard", lambda s, d: view(s, d, "scrape_runs").groupBy("region", strip_shard(F.col("region")).alias("listing_rule"), strip_shard_sql(F.col("region")).alias("dashboard_rule")).agg(F.count("*").alias("n")), """
SELECT region, CASE WHEN regexp_matches(region, '[0-9]$') THEN regexp_replace(region, '-[^-]*$', '') ELSE region END AS listing_rule,
  regexp_replace(region, '^(.+)-[0-9]+$', '\\1') AS dashboard_rule, COUNT(*) AS n FROM v_scrape_runs GROUP BY ALL""")
register("chain_of", lambda s, d: view(s, d, "dispensaries").select("id", chain_of(F.col("id")).alias("chain")),
         f"SELECT id, {o.CHAIN.replace('dispensary_id', 'id')} AS chain FROM v_dispensaries")
register("raw_listing_defaults", lambda s, d: ls.with_default_platform(raw(s, d), view(s, d, "dispensaries")).select("id", "source_platform"),
         "SELECT r.id, COALESCE(r.source_platform, d.platform) AS source_platform FROM v_raw_listings r JOIN v_dispensaries d ON d.id = r.dispensary_id")

# --- live parser ------------------------------------------------------------------------------------------
_clean = "trim(regexp_replace(" + strip_sql("raw_text || ' ' || price", [r"Add to (?:cart|bag)", r"(?:Add|Remove)\s*$", r"(?:Indica|Sativa|Hybrid)\s*$"]) + ", '\\s+', ' ', 'g'))"
o.EXTRA["o_lv0"] = f"SELECT id, tx, {category_sql('lower(tx)')} AS category FROM (SELECT id, {_clean} AS tx FROM v_raw_listings) x"
o.EXTRA["o_lv1"] = f"""
SELECT *, CASE fr WHEN '1/8' THEN '3.5g' WHEN '1/4' THEN '7.0g' WHEN '1/2' THEN '14.0g' ELSE NULLIF(CASE WHEN category = 'edible' THEN regexp_extract(tx, '([0-9.]+)\\s*mg\\b', 0, 'i')
    ELSE regexp_extract(tx, '([0-9.]+)\\s*(g|mg|oz)\\b', 0, 'i') END, '') END AS w0,
  COALESCE({num('tx', t.LIVE_OFF)}, 0) AS off, list_transform(regexp_extract_all(regexp_replace(tx, {rx(t.LIVE_OFF)}, '', 'gi'), {rx(t.LIVE_AMOUNT)}, 1), lambda x: CAST(x AS DOUBLE)) AS am
FROM (SELECT *, regexp_extract(tx, {rx(t.FRACTION)}, 1, 'i') AS fr FROM o_lv0) y"""
o.EXTRA["o_lv2"] = f"""
SELECT id, tx, category, fr, w0 AS w, off, am, list_min(am) AS lo, CASE WHEN len(am) > 1 THEN list_max(am) END AS hi, {num('w0', '([0-9.]+)')} AS v,
  CASE WHEN regexp_matches(w0, 'mg', 'i') THEN 'mg' WHEN regexp_matches(w0, 'g', 'i') THEN 'g' END AS u FROM o_lv1"""
o.EXTRA["o_lv3"] = f"""
SELECT *, CASE WHEN category = 'edible' AND fr = '' AND w IS NOT NULL THEN CASE WHEN v BETWEEN 82 AND 118 THEN '100mg' WHEN v BETWEEN 180 AND 220 THEN '200mg' WHEN v < 50 THEN NULL
      ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) || 'mg' END ELSE valid END AS weight,
  off > 0 AND lo > 0 AND hi IS NULL AS lab, {o.round_dec('lo - off', 2)} AS cut
FROM ({o.EXTRA['o_w_valid'].replace('SELECT id, category, w, v, u,', 'SELECT *,').replace('FROM o_w', 'FROM o_lv2')}) z"""
o.EXTRA["o_lv4"] = """
SELECT *, CASE WHEN lab AND cut > 0 THEN cut ELSE lo END AS p1, CASE WHEN lab THEN CASE WHEN cut > 0 THEN lo END ELSE hi END AS o1,
  category = 'skip' OR length(tx) < 5 OR (fr = '' AND ((category = 'edible' AND w IS NOT NULL AND weight IS NULL) OR (category = 'preroll' AND COALESCE(weight, '') <> '1g'))) AS refused FROM o_lv3"""
_half_even = lambda x: f"round_even(CAST(CAST({x} AS DECIMAL(20,10)) AS DOUBLE), 0)"


def _live(s, d):
    df = raw(s, d).withColumn("_text", F.concat_ws(" ", "raw_text", "price"))
    return t.keep_rows(t.with_live_parse(df.select("id", "_text"), "_text"), ~F.col("refused")).drop("refused", "_text")


register("parse_text_live", _live, f"""
SELECT id, category, {any_word('lower(tx)', t.INFUSED_WORDS)} AS is_infused, weight, CASE WHEN tiny THEN o1 - p1 ELSE p1 END AS deal_price, o1 AS original_price,
  COALESCE(CASE WHEN tiny THEN {_half_even('p1 / o1 * 100')} WHEN p1 > 0 AND o1 > p1 THEN {_half_even('(o1 - p1) / o1 * 100')} END, {num('tx', r'([0-9]+)%\s*off')}) AS discount_percent,
  CASE WHEN category <> 'edible' OR weight IS NULL THEN {num('tx', r'THC:\s*([0-9.]+)%?')} END AS thc_percent,
  CASE WHEN category = 'edible' THEN {num('weight', r'([0-9]+\.?[0-9]*)\s*mg')} END AS thc_mg,
  CASE WHEN contains(tx, '(I)') OR contains(tx, 'Indica') THEN 'Indica' WHEN contains(tx, '(S)') OR contains(tx, 'Sativa') THEN 'Sativa'
       WHEN contains(tx, '(H)') OR contains(tx, 'Hybrid') THEN 'Hybrid' END AS strain_type
FROM (SELECT *, COALESCE(p1 > 0 AND p1 < 3 AND o1 > p1 AND o1 - p1 > 3, false) AS tiny FROM o_lv4) q WHERE NOT refused""")

# --- brands -----------------------------------------------------------------------------------------------
BLOCKERS = [(r"\bold\s+ring\b", "Brand#4"), (r"\bhot\s+gear\b", "Brand#5")]
VARIATIONS = [("hot gear", "Brand#7"), ("blue", "Brand#3"), ("new", "Brand#12"), ("other brand", "Brand#11")]
ALIASES = [("Brand#9", "Brand#8")]


def terms(s, d):
    brands = view(s, d, "deal_catalog").select("brand").filter("brand IS NOT NULL").distinct()
    return b.dictionary(brands, s.createDataFrame(VARIATIONS, "variation string, canonical string"), s.createDataFrame(ALIASES, "name string, canonical string"))


_vals = lambda rows: ", ".join("(" + ", ".join(o.q(x) for x in r) + ")" for r in rows)
o.EXTRA["o_terms"] = f"""
SELECT canonical, term, is_var, COALESCE(a.c, canonical) AS brand FROM (
  SELECT DISTINCT brand AS canonical, lower(brand) AS term, 0 AS is_var FROM v_deal_catalog WHERE brand IS NOT NULL
  UNION ALL SELECT c, v, 1 FROM (VALUES {_vals(VARIATIONS)}) t(v, c)) x LEFT JOIN (VALUES {_vals(ALIASES)}) a(n, c) ON a.n = x.canonical"""
_blocked = " OR ".join(f"(t.canonical = '{bb}' AND regexp_matches(r.raw_text, {rx(p)}, 'i'))" for p, bb in BLOCKERS)
o.EXTRA["o_hits"] = f"""
SELECT r.id, t.*, length(regexp_extract(lower(r.raw_text), '^(.*?)\\b' || t.term || '\\b', 1, 's')) AS pos FROM v_raw_listings r
JOIN o_terms t ON regexp_matches(lower(r.raw_text), '\\b' || t.term || '\\b') AND NOT ({_blocked})"""


def _misspelt(s, d):
    """Names whose brand lost a sign in front of the number, as `Brand3 - ...`."""
    low = F.when(F.col("scraped_brand") != "", F.replace("scraped_brand", F.lit("#"), F.lit(""))).otherwise("Nobody")
    return raw(s, d).select("id", F.concat(low, F.lit(" - "), F.regexp_replace("name", r"(?i)\b(new|blue)\b", "x")).alias("name"))


register("detect_brand", lambda s, d: b.detect_brands(raw(s, d).select("id", "raw_text"), terms(s, d), ["id"], "raw_text", BLOCKERS).select("id", "brand", F.col("score").cast("long").alias("score")), """
WITH sc AS (SELECT *, length(term) + CASE WHEN pos < 3 THEN 100 WHEN pos < 10 THEN 50 ELSE 0 END AS score FROM o_hits),
c AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY id, canonical ORDER BY is_var, length(term) DESC, score DESC) = 1)
SELECT id, brand, CAST(score AS BIGINT) AS score FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, is_var, lower(canonical)) = 1""")
#: Heads of offers that resemble a brand without naming it; the ratio itself is checked in the tests.
register("detect_brand_similar", lambda s, d: b.detect_brands(_misspelt(s, d), terms(s, d), ["id"], "name", BLOCKERS, similar=True).select("id", "brand", F.col("score").cast("long").alias("score")))
register("strain_blockers", lambda s, d: raw(s, d).select("id", F.array_join(F.array_sort(b.blocked_brands(F.col("raw_text"), BLOCKERS)), ",").alias("blocked")),
         f"""SELECT id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(raw_text, {rx(p)}, 'i') THEN '{bb}' END" for p, bb in BLOCKERS)}], lambda x: x IS NOT NULL)), ',') AS blocked FROM v_raw_listings""")
register("brand_from_url", lambda s, d: b.brands_from_url(raw(s, d), terms(s, d), "id"), """
SELECT r.id, arg_max(t.canonical, length(t.term)) AS brand FROM v_raw_listings r JOIN o_terms t ON t.is_var = 0 AND contains(lower(r.product_url), '/' || t.term || '-') GROUP BY r.id""")
register("label_brands", lambda s, d: b.label_brands(raw(s, d), terms(s, d), "id").select("id", F.array_join("labels", ",").alias("labels")), """
SELECT r.id, t.canonical AS labels FROM v_raw_listings r JOIN o_terms t ON t.is_var = 0 AND t.brand = t.canonical AND list_contains(string_split(lower(r.raw_text), CHR(10)), t.term)""")
register("resolve_brand_category", lambda s, d: ls.parse_listings(raw(s, d), terms(s, d)).groupBy("brand", "category", "product_subtype").agg(F.count("*").alias("n")))
register("parse_listings", lambda s, d: ls.parse_listings(raw(s, d), terms(s, d)).withColumn("run_date", day_text("run_date")).drop("raw_text"))

def _unnamed(s, d):
    """Offers without a brand, under their names up to the first dash or bar."""
    return view(s, d, "products").withColumn("clean_name", F.replace("name", F.lit(" No"), F.lit(" - No")))


_head = "substr(trim(regexp_split_to_array(replace(name, ' No', ' - No'), '\\s*[-|–—]\\s*')[1]), 1, 50)"
register("unmatched_names", lambda s, d: ls.unmatched_candidates(_unnamed(s, d)), f"""
SELECT name, COUNT(*) AS n_stores FROM (
  SELECT dispensary_id, {_head} AS name, COUNT(*) AS n FROM v_products WHERE COALESCE(brand, '') = '' AND length({_head}) > 2 GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY dispensary_id ORDER BY COUNT(*) DESC, {_head}) <= 10) x
GROUP BY name ORDER BY n_stores DESC, name LIMIT 20""")
register("unmatched_candidates", lambda s, d: ls.unmatched_candidates(ls.parse_listings(raw(s, d), terms(s, d))))


def _daily(s, d):
    from leafmart.bridge import base_table

    words = F.split("text", r"\s+")
    return base_table(s, d, "documents").select(F.col("source").alias("region"), words.alias("names"),
                                               F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("run_date"))


def _word_brands(s, d):
    """Stand-in brand list: the words of the benchmark texts."""
    from leafmart.bridge import base_table

    words = base_table(s, d, "benchmark").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("brand"))
    return words.filter(F.length("brand") >= 5).distinct()


def _fuzzy(s, d):
    names = _daily(s, d).select(F.explode("names").alias("name"))
    return b.fuzzy_brand_match(names, _word_brands(s, d)).select("name", "brand", F.round("ratio", 4).alias("ratio"))


register("fuzzy_brand_match", _fuzzy)


def _learned(s, d):
    """Candidates after a second run over the same days, with one candidate approved and one rejected before it."""
    daily, brands = _daily(s, d), _word_brands(s, d)
    first = b.learn_brands(daily, brands, s.createDataFrame([], "name string, status string"), "2024-01-31", 30, 5)
    judged_ = first.withColumn("status", F.when(F.col("observation_count") % 3 == 0, "approved").when(F.col("observation_count") % 3 == 1, "rejected").otherwise("pending"))
    return b.learn_brands(daily, brands, cut_lineage(judged_), "2024-01-31", 30, 5)


register("learned_brands", lambda s, d: _learned(s, d).select("name", "observation_count", "state_count", "status", "closest_existing_brand"))
register("brand_candidates", lambda s, d: b.brand_candidates(_daily(s, d), _word_brands(s, d), 5).select(
    "name", "observation_count", "state_count", F.array_join("regions_seen", ",").alias("regions"), "closest_existing_brand", "similarity_score"))
