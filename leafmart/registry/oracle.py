"""Checking SQL for the scoring views, written apart from the column expressions they check."""

from __future__ import annotations

from leafmart import lookups as L
from leafmart.bridge import BRIDGE_BRAND_TIERS, with_views

EXTRA: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_in(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def ratio(num: str, den: str, digits: int, scale: int = 1) -> str:
    """Half-up quotient of whole non-negative numbers in integer arithmetic."""
    shift = scale * 10 ** digits
    return (f"(CASE WHEN ({den}) <> 0 THEN CAST(((2 * ({num}) * {shift}) + ({den})) // (2 * ({den})) AS DOUBLE) "
            f"/ {10 ** digits} END)")


def ratio_even(num: str, den: str, digits: int, scale: int = 1) -> str:
    shift = scale * 10 ** digits
    n, d = f"(({num}) * {shift})", f"({den})"
    return (f"(CASE WHEN {d} <> 0 THEN CAST({n} // {d} + CASE WHEN 2 * ({n} % {d}) > {d} THEN 1 "
            f"WHEN 2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / {10 ** digits} END)")


def round_dec(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def js_round(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def js_pct(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN {js_round(f'CAST({num} AS DOUBLE) / ({den}) * 100')} ELSE 0 END"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def cents(col: str) -> str:
    return f"CAST(round({col} * 100) AS BIGINT)"


def sql(body: str) -> str:
    return with_views(body, EXTRA)


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def _caps_rows() -> str:
    rows = []
    for state, cats in L.PRICE_CAPS.items():
        for cat, cap in cats.items():
            steps = cap.items() if isinstance(cap, dict) else [(None, cap)]
            for tier, c in steps:
                rows.append(f"({q(state)}, {q(cat)}, {'NULL' if tier is None else float(tier)}, {float(c)})")
    return ", ".join(rows)


EXTRA["o_caps"] = (
    "SELECT state, cat, CAST(tier AS DOUBLE) AS tier, CAST(cap AS DOUBLE) AS cap FROM (VALUES "
    + _caps_rows() + ") t(state, cat, tier, cap)")

# cap by state override or base, then by weight step; one row per product
_state = "CASE WHEN regexp_matches(region, '[0-9]$') THEN regexp_replace(region, '-[^-]*$', '') ELSE region END"


def cap_lookup(category: str, weight: str) -> str:
    """Scalar cap of a listing: rows of its state when that state lists the category, else the base rows."""
    src = (f"(SELECT tier, cap FROM o_caps c WHERE c.cat = {category} AND c.state = CASE WHEN EXISTS (SELECT 1 FROM o_caps e "
           f"WHERE e.cat = {category} AND e.state = p.state) THEN p.state ELSE 'base' END)")
    return (f"COALESCE((SELECT max_by(cap, COALESCE(tier, 0)) FROM {src} s WHERE tier IS NULL OR tier <= {weight}), "
            f"(SELECT min_by(cap, tier) FROM {src} s), 50)")


# the price cap depends on state, category and weight only: resolve it once per combination
EXTRA["o_cap_keys"] = f"""
SELECT DISTINCT {_state} AS state, category, CASE WHEN weight_value <> 0 THEN weight_value END AS w FROM v_products
"""
EXTRA["o_cap_resolved"] = f"""
SELECT p.state, p.category, p.w, {cap_lookup('p.category', 'p.w')} AS price_cap,
       {cap_lookup("'infused_preroll'", '0')} AS infused_cap, {cap_lookup("'preroll_pack'", '0')} AS pack_cap
FROM o_cap_keys p
"""
_merch = "|".join(w for w in L.MERCH_WORDS)


def hard_sql(source: str, price_cap: str = "price_cap") -> str:
    """Reject reason and cap flag over ``source``, which carries the cap columns and ``state``."""
    budget = ("((category IN ('edible','preroll') AND sale_price <= 10) OR (category = 'flower' AND sale_price <= 15))")
    heavy = "COALESCE(weight_value, 0) > 0.6"
    return f"""
SELECT *, CASE
  WHEN regexp_matches(lower(name), '{_merch}') THEN 'merchandise'
  WHEN sale_price < 3 THEN 'price_floor'
  WHEN sale_price > 100 THEN 'price_ceiling'
  WHEN category = 'vape' AND sale_price < CASE WHEN product_subtype = 'disposable' THEN CASE WHEN {heavy} THEN 17 ELSE 8 END
       ELSE CASE WHEN {heavy} THEN 14 ELSE 7 END END THEN 'vape_floor'
  WHEN category = 'vape' AND sale_price > CASE WHEN {heavy} OR (COALESCE(weight_value, 0) = 0 AND
       product_subtype = 'disposable') THEN 35 ELSE 25 END THEN 'vape_cap'
  WHEN source_platform IN ('jane','carrot','aiq') THEN CASE WHEN sale_price > {price_cap} * CAST(1.3 AS DOUBLE) THEN 'price_cap' END
  WHEN category = 'vape' AND product_subtype = 'disposable' AND sale_price <= 25 THEN
       CASE WHEN sale_price > {price_cap} THEN 'price_cap' END
  WHEN discount_percent IS NULL OR discount_percent < CASE WHEN {budget} THEN 1
       WHEN category IN ('edible','preroll') THEN 12 ELSE 15 END THEN 'discount_low'
  WHEN discount_percent > 85 THEN 'discount_high'
  WHEN COALESCE(original_price, 0) = 0 OR original_price <= sale_price THEN 'no_original_price'
  WHEN original_price > CASE WHEN category = 'preroll' AND product_subtype = 'preroll_pack' THEN 50
       WHEN category IN ('flower','concentrate') THEN 100 WHEN category = 'vape' THEN 80 WHEN category = 'edible' THEN 50
       WHEN category = 'preroll' THEN 30 END THEN 'original_ceiling'
  WHEN category = 'preroll' AND product_subtype = 'infused_preroll' THEN CASE WHEN sale_price > infused_cap THEN 'infused_cap' END
  WHEN category = 'preroll' AND product_subtype = 'preroll_pack' THEN CASE WHEN sale_price > pack_cap THEN 'pack_cap' END
  WHEN sale_price > {price_cap} THEN 'price_cap' END AS reject_reason,
  sale_price BETWEEN 3 AND 100 AND CASE WHEN category = 'preroll' AND COALESCE(product_subtype, '') = 'infused_preroll'
     THEN sale_price > infused_cap ELSE sale_price > {price_cap} END AS cap_failed
FROM {source}
"""


EXTRA["o_capped"] = f"""
SELECT v.*, r.state, r.price_cap, r.infused_cap, r.pack_cap FROM v_products v JOIN o_cap_resolved r
  ON r.state = {_state.replace('region', 'v.region')} AND r.category = v.category
 AND r.w IS NOT DISTINCT FROM CASE WHEN v.weight_value <> 0 THEN v.weight_value END
"""
EXTRA["o_hard"] = hard_sql("o_capped")


def brand_points_sql(brand: str = "brand", tiers: dict[str, list[str]] = BRIDGE_BRAND_TIERS) -> str:
    cases = []
    for tier, points in (("premium", 20), ("popular", 12)):
        names = tiers[tier]
        tests = [f"lower({brand}) IN {values_in(names)}"]
        tests += [rf"(starts_with(lower({brand}), {q(n)}) AND NOT regexp_matches(substr(lower({brand}), {len(n) + 1}, 1), '[\p{{L}}\p{{N}}]'))"
                  for n in names if len(n) > 3]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {points}")
    return f"CASE WHEN {brand} IS NULL OR {brand} = '' THEN 0 {' '.join(cases)} ELSE 5 END"


def score_sql(tiers: dict[str, list[str]] = BRIDGE_BRAND_TIERS) -> str:
    depth = " ".join(f"WHEN least(COALESCE(discount_percent, 0), 80) >= {a} THEN {p}" for a, p in L.DISCOUNT_POINTS)
    unit = "sale_price / weight_value"
    return f"""least(100,
  CASE WHEN source_platform IN ('jane','carrot','aiq') THEN 15 ELSE (CASE {depth} ELSE 0 END)
     + CASE WHEN original_price > 0 AND original_price > sale_price
            THEN least(10, CAST(floor((original_price - sale_price) / 2.5::DOUBLE) AS INT)) ELSE 0 END END
  + {brand_points_sql(tiers=tiers)}
  + CASE WHEN COALESCE(weight_value, 0) <= 0 THEN 0
      WHEN category = 'flower' THEN CASE WHEN {unit} <= 3 THEN 15 WHEN {unit} <= 4.5 THEN 12 WHEN {unit} <= 6 THEN 8 WHEN {unit} <= 8 THEN 4 ELSE 0 END
      WHEN category = 'edible' THEN CASE WHEN {unit} * 100 <= 5 THEN 15 WHEN {unit} * 100 <= 8 THEN 10 WHEN {unit} * 100 <= 12 THEN 5 ELSE 0 END
      WHEN category IN ('vape','concentrate') THEN CASE WHEN {unit} <= 15 THEN 15 WHEN {unit} <= 22 THEN 10 WHEN {unit} <= 30 THEN 5 ELSE 0 END
      WHEN category = 'preroll' THEN CASE WHEN sale_price <= 4 THEN 15 WHEN sale_price <= 6 THEN 12 WHEN sale_price <= 8 THEN 8 WHEN sale_price <= 9 THEN 4 ELSE 0 END
      ELSE 0 END
  + CASE WHEN category IN ('flower','vape','edible') THEN 8 WHEN category IN ('concentrate','preroll') THEN 7 ELSE 3 END
  + CASE WHEN sale_price < 3 THEN 0 WHEN sale_price <= 8 THEN 15 WHEN sale_price <= 15 THEN 12 WHEN sale_price <= 25 THEN 8 WHEN sale_price <= 40 THEN 4 ELSE 0 END
  + CASE WHEN (category IN ('preroll','edible') AND sale_price <= 11) OR (category = 'flower' AND sale_price <= 15) THEN 5 ELSE 0 END
  + CASE WHEN category = 'vape' AND product_subtype = 'disposable' THEN 12 ELSE 0 END)"""


EXTRA["o_scored"] = f"""
SELECT *, reject_reason IS NULL AS passed, CASE WHEN reject_reason IS NULL THEN {score_sql()} ELSE 0 END AS deal_score
FROM o_hard
"""
_promo = L.PROMO_NAME_PATTERN.replace("'", "''")
EXTRA["o_judged"] = f"""
SELECT *, relaxed_ok AND COALESCE(brand, '') <> '' AND NOT regexp_matches(name, '{_promo}', 'i')
          AND NOT (category IN ('flower','concentrate','vape') AND COALESCE(weight_value, 0) = 0
                   AND COALESCE(product_subtype, '') <> 'disposable') AS strict_ok
FROM (SELECT *, lower(trim(name)) NOT IN {values_in(L.LABEL_ONLY_NAMES)} AND length(trim(name)) >= 5
          AND NOT (COALESCE(brand, '') <> '' AND lower(trim(name)) = lower(brand))
          AND NOT (len(string_split_regex(trim(name), '\\s+')) = 2
                   AND lower(string_split_regex(trim(name), '\\s+')[1]) = lower(string_split_regex(trim(name), '\\s+')[2]))
          AND NOT (category = 'edible' AND COALESCE(weight_value, 0) <> 0 AND weight_value < 50) AS relaxed_ok
      FROM o_scored) j
"""
BUCKET = ("CASE WHEN category = 'vape' AND product_subtype = 'disposable' THEN 'disposable' "
          "WHEN category IN ('flower','vape','edible','concentrate','preroll') THEN category ELSE 'other' END")
CHAIN = ("CASE WHEN split_part(dispensary_id, '-', 1) IN ('the','nevada','deep','beyond','tree') AND contains(dispensary_id, '-') "
         "THEN split_part(dispensary_id, '-', 1) || '-' || split_part(dispensary_id, '-', 2) "
         "ELSE split_part(dispensary_id, '-', 1) END")
_bands = " ".join(f"WHEN category = {q(c)} AND weight_value BETWEEN {float(lo)} AND {float(hi)} THEN {q(t)}"
                  for c, rows in L.WEIGHT_BANDS.items() for lo, hi, t in rows)
WEIGHT_TIER = f"CASE {_bands} END"
