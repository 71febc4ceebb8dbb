"""Price caps, listing filters and scores as column expressions (no Python rows, no shuffle)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmart import lookups as L

BASE_STATE = "base"


def case_of(column: Column, values: dict, default=None) -> Column:
    """``CASE column WHEN key THEN value ...`` over a small fixed table."""
    out = None
    for key, value in values.items():
        hit = column == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def strip_shard(region: Column) -> Column:
    """Market of a sharded region: a name that ends in a digit loses its last dash part."""
    return F.when(region.rlike("[0-9]$"), F.regexp_replace(region, "-[^-]*$", "")).otherwise(region)


def strip_shard_sql(region: Column) -> Column:
    """Same for dashboards: only a trailing ``-<digits>`` behind a non-empty name goes."""
    return F.regexp_replace(region, r"^(.+)-[0-9]+$", "$1")


def weight_tier(category: Column, weight: Column) -> Column:
    """Name of the inclusive weight band, NULL in the gaps."""
    out = None
    for cat, bands in L.WEIGHT_BANDS.items():
        for lo, hi, tier in bands:
            hit = (category == cat) & weight.between(F.lit(float(lo)), F.lit(float(hi)))
            out = F.when(hit, F.lit(tier)) if out is None else out.when(hit, F.lit(tier))
    return out


def caps_table(spark: SparkSession, caps: dict | None = None) -> DataFrame:
    """One row per (state, category): sorted cap steps plus the preroll caps of that state.

    Each state row is already completed with the base values, so a listing needs a single small join.
    """
    caps = caps or L.PRICE_CAPS
    rows = []
    for state in caps:
        merged = {**caps[BASE_STATE], **caps[state]}
        for category in ("flower", "vape", "edible", "concentrate", "preroll"):
            cap = merged[category]
            steps = sorted(cap.items()) if isinstance(cap, dict) else [(0.0, cap)]
            rows.append((state, category, [(float(t), float(c)) for t, c in steps],
                         float(merged["infused_preroll"]), float(merged["preroll_pack"])))
    schema = T.StructType([
        T.StructField("cap_state", T.StringType(), False),
        T.StructField("cap_category", T.StringType(), False),
        T.StructField("cap_steps", T.ArrayType(T.StructType([
            T.StructField("tier", T.DoubleType(), False), T.StructField("cap", T.DoubleType(), False)]), False), False),
        T.StructField("infused_cap", T.DoubleType(), False),
        T.StructField("pack_cap", T.DoubleType(), False),
    ])
    return spark.createDataFrame(rows, schema)


#: Learned caps (regions x categories x tiers) that are broadcast; more are left to the planner.
MAX_BROADCAST_CAPS = 200_000


def with_price_cap(products: DataFrame, dynamic_caps: DataFrame | None = None, caps: dict | None = None) -> DataFrame:
    """Adds ``price_cap``, ``infused_cap`` and ``pack_cap``.

    Learned caps (exact region, then its market) win over the fixed state caps, those over the base caps.
    Weight picks the largest step not above it; a lighter or missing weight takes the smallest step.
    """
    caps = caps or L.PRICE_CAPS
    spark = products.sparkSession
    state = strip_shard(F.col("region"))
    known = F.when(state.isin([s for s in caps if s != BASE_STATE]), state).otherwise(F.lit(BASE_STATE))
    out = products.withColumn("_state", known).join(
        F.broadcast(caps_table(spark, caps)),
        (F.col("_state") == F.col("cap_state")) & (F.col("category") == F.col("cap_category")), "left")
    weight = F.when(F.col("weight_value") != 0, F.col("weight_value").cast("double"))
    reached = F.filter("cap_steps", lambda s: s["tier"] <= weight)
    step = F.coalesce(F.try_element_at(reached, F.lit(-1)), F.try_element_at("cap_steps", F.lit(1)))
    fixed = F.coalesce(step["cap"], F.lit(float(L.UNCAPPED_CATEGORY_CAP)))
    if dynamic_caps is None:
        out = out.withColumn("price_cap", fixed)
    else:
        learned = dynamic_caps.filter("is_active").select(
            F.col("region").alias("_r"), F.col("category").alias("_c"), F.col("weight_tier").alias("_t"),
            F.col("recommended_cap").cast("double").alias("_cap"))
        # one row a category and tier, with the caps of its regions: a few rows, so exact region and market are two look-ups
        by_region = learned.groupBy("_r", "_c", "_t").agg(F.max("_cap").alias("_cap")).groupBy("_c", "_t").agg(
            F.map_from_entries(F.collect_list(F.struct("_r", "_cap"))).alias("_caps"))
        if learned.limit(MAX_BROADCAST_CAPS + 1).count() <= MAX_BROADCAST_CAPS:
            by_region = F.broadcast(by_region)
        out = out.withColumn("_tier", weight_tier(F.col("category"), F.col("weight_value").cast("double")))
        out = out.join(by_region, (F.col("category") == F.col("_c")) & (F.col("_tier") == F.col("_t")), "left")
        own = F.try_element_at("_caps", F.col("region"))
        out = out.withColumn("price_cap", F.coalesce(own, F.try_element_at("_caps", strip_shard(F.col("region"))), fixed))
    base = caps[BASE_STATE]
    keep = [F.col(c) for c in products.columns]
    return out.select(*keep, "price_cap",
                      F.coalesce("infused_cap", F.lit(float(base["infused_preroll"]))).alias("infused_cap"),
                      F.coalesce("pack_cap", F.lit(float(base["preroll_pack"]))).alias("pack_cap"))


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words)


def word_pattern(words: list[str]) -> str:
    """Pattern that finds a text with one of the words. Words that hold another one are left out, common heads are tried once."""
    shortest = sorted(w for w in set(words) if not any(v in w for v in words if v != w))

    def tree(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest})
        ways = []
        for head in heads:
            tails = [w[1:] for w in rest if w[0] == head]
            ways.append(re.escape(head) + (re.escape(tails[0]) if len(tails) == 1 else f"(?:{tree(tails)})"))
        return "|".join(ways)

    return f"(?=[{''.join(sorted({re.escape(w[0]) for w in shortest}))}])(?:{tree(shortest)})"


MERCH_PATTERN = word_pattern(L.MERCH_WORDS)


def is_merch(*texts: Column) -> Column:
    joined = F.lower(F.concat_ws("\n", *texts))
    return joined.rlike(MERCH_PATTERN)


def has_column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def merchandise(products: DataFrame) -> Column:
    return is_merch(F.coalesce(F.col("name"), F.lit("")), has_column(products, "raw_text"))


def price_reason() -> Column:
    """First failing check of the listing filter behind `merchandise`, NULL when none fails. Needs ``with_price_cap``."""
    sale = F.coalesce(F.col("sale_price").cast("double"), F.lit(0.0))
    original = F.coalesce(F.col("original_price").cast("double"), F.lit(0.0))
    discount = F.col("discount_percent").cast("double")
    category, subtype = F.col("category"), F.col("product_subtype")
    weight = F.coalesce(F.col("weight_value").cast("double"), F.lit(0.0))
    heavy = weight > 0.6
    is_vape = category == "vape"
    floor = F.when(heavy, case_of(subtype, {s: v[1] for s, v in L.VAPE_FLOORS.items()})).otherwise(
        case_of(subtype, {s: v[0] for s, v in L.VAPE_FLOORS.items()}))
    roomy = heavy | ((weight == 0) & (subtype == "disposable"))
    ceiling = F.when(roomy, case_of(subtype, {s: v[1] for s, v in L.VAPE_CAPS.items()})).otherwise(
        case_of(subtype, {s: v[0] for s, v in L.VAPE_CAPS.items()}))
    loose = F.coalesce(F.col("source_platform").isin(L.LOOSE_PLATFORMS), F.lit(False))
    cheap_single = category.isin("edible", "preroll") & (sale <= 10)
    cheap_flower = (category == "flower") & (sale <= 15)
    cheap_disposable = is_vape & (subtype == "disposable") & (sale <= 25)
    minimum = F.when(cheap_single | cheap_flower, F.lit(1.0)).otherwise(
        F.coalesce(case_of(category, {k: float(v) for k, v in L.CATEGORY_MIN_DISCOUNT.items()}),
                   F.lit(float(L.MIN_DISCOUNT))))
    pack = (category == "preroll") & (subtype == "preroll_pack")
    infused = (category == "preroll") & (subtype == "infused_preroll")
    limit = F.when(pack, F.lit(float(L.PACK_ORIGINAL_CEILING))).otherwise(
        case_of(category, {k: float(v) for k, v in L.ORIGINAL_CEILINGS.items()}))
    over_cap = sale > F.col("price_cap")
    return (
        F.when(sale < L.MIN_PRICE, "price_floor")
        .when(sale > L.MAX_PRICE, "price_ceiling")
        .when(is_vape & (sale < floor), "vape_floor")
        .when(is_vape & (sale > ceiling), "vape_cap")
        .when(loose & (sale > F.col("price_cap") * L.LOOSE_CAP_MULTIPLIER), "price_cap")
        .when(loose, F.lit(None).cast("string"))
        .when(cheap_disposable & over_cap, "price_cap")
        .when(cheap_disposable, F.lit(None).cast("string"))
        .when(discount.isNull() | (discount < minimum), "discount_low")
        .when(discount > L.MAX_DISCOUNT, "discount_high")
        .when((original == 0) | (original <= sale), "no_original_price")
        .when(original > limit, "original_ceiling")
        .when(infused & (sale > F.col("infused_cap")), "infused_cap")
        .when(infused, F.lit(None).cast("string"))
        .when(pack & (sale > F.col("pack_cap")), "pack_cap")
        .when(pack, F.lit(None).cast("string"))
        .when(over_cap, "price_cap")
    )


def fails_price_cap() -> Column:
    """Cap failures only; knows no pack cap, no loose multiplier and no vape subtype caps."""
    sale = F.coalesce(F.col("sale_price").cast("double"), F.lit(0.0))
    infused = (F.col("category") == "preroll") & F.coalesce(F.col("product_subtype") == "infused_preroll", F.lit(False))
    in_range = (sale >= L.MIN_PRICE) & (sale <= L.MAX_PRICE)
    return in_range & F.when(infused, sale > F.col("infused_cap")).otherwise(sale > F.col("price_cap"))


def hard_filters(products: DataFrame, dynamic_caps: DataFrame | None = None, caps: dict | None = None) -> DataFrame:
    """Adds ``reject_reason`` (NULL = qualifies), ``passed`` and ``cap_failed`` to every listing.

    Merchandise is the first reason; names are searched last for ``passed``, where a failing price saves the search.
    """
    out = with_price_cap(products, dynamic_caps, caps)
    out = out.withColumn("_price", price_reason()).withColumn("cap_failed", fails_price_cap())
    out = out.withColumns({"reject_reason": F.when(merchandise(out), "merchandise").otherwise(F.col("_price")), "passed": F.col("_price").isNull() & ~merchandise(out)})
    return out.drop("_price", "price_cap", "infused_cap", "pack_cap")


def brand_points(brand: Column, tiers: dict[str, list[str]] | None = None) -> Column:
    """Brand recognition: exact tier name, or a tier name of over 3 letters as prefix up to a word end."""
    tiers = tiers or L.BRAND_TIERS
    lower = F.lower(brand)
    out = F.when(brand.isNull() | (brand == ""), F.lit(0))
    for tier in ("premium", "popular"):
        names = tiers[tier]
        prefixes = [n for n in names if len(n) > 3]
        hit = lower.isin(names)
        if prefixes:
            hit = hit | lower.rlike("^(?:" + _any_of(prefixes) + r")(?![\p{L}\p{N}])")
        out = out.when(hit, F.lit(L.BRAND_POINTS[tier]))
    return out.otherwise(F.lit(L.BRAND_POINTS["other"]))


def _steps(value: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first step whose upper end is not exceeded, else 0."""
    out = None
    for upper, points in steps:
        hit = value <= upper
        out = F.when(hit, F.lit(points)) if out is None else out.when(hit, F.lit(points))
    return out.otherwise(F.lit(0))


def deal_score(tiers: dict[str, list[str]] | None = None) -> Column:
    """Composite offer score, 0 to 100."""
    discount = F.least(F.coalesce(F.col("discount_percent").cast("double"), F.lit(0.0)), F.lit(80.0))
    sale = F.coalesce(F.col("sale_price").cast("double"), F.lit(0.0))
    original = F.coalesce(F.col("original_price").cast("double"), F.lit(0.0))
    weight = F.col("weight_value").cast("double")
    category, subtype = F.col("category"), F.col("product_subtype")

    depth = None
    for at_least, points in L.DISCOUNT_POINTS:
        hit = discount >= at_least
        depth = F.when(hit, F.lit(points)) if depth is None else depth.when(hit, F.lit(points))
    saved = F.when((original > 0) & (original > sale), F.least(F.lit(10), F.floor((original - sale) / 2.5).cast("int")))
    loose = F.coalesce(F.col("source_platform").isin(L.LOOSE_PLATFORMS), F.lit(False))
    price_part = F.when(loose, F.lit(L.LOOSE_PLATFORM_POINTS)).otherwise(
        depth.otherwise(F.lit(0)) + F.coalesce(saved, F.lit(0)))

    per_unit = sale / F.when(weight > 0, weight)
    unit_value = F.when(
        (weight > 0) & (sale > 0),
        F.when(category == "flower", _steps(per_unit, [(3, 15), (4.5, 12), (6, 8), (8, 4)]))
        .when(category == "edible", _steps(per_unit * 100, [(5, 15), (8, 10), (12, 5)]))
        .when(category.isin("vape", "concentrate"), _steps(per_unit, [(15, 15), (22, 10), (30, 5)]))
        .when(category == "preroll", _steps(sale, [(4, 15), (6, 12), (8, 8), (9, 4)])))
    attractive = F.when(sale < 3, F.lit(0)).otherwise(_steps(sale, [(8, 15), (15, 12), (25, 8), (40, 4)]))
    budget = F.when((category.isin("preroll", "edible") & (sale <= 11)) | ((category == "flower") & (sale <= 15)),
                    F.lit(5)).otherwise(F.lit(0))
    disposable = F.when((category == "vape") & (subtype == "disposable"), F.lit(12)).otherwise(F.lit(0))
    total = (price_part + brand_points(F.col("brand"), tiers) + F.coalesce(unit_value, F.lit(0))
             + F.coalesce(case_of(category, L.CATEGORY_POINTS), F.lit(L.OTHER_CATEGORY_POINTS))
             + attractive + budget + disposable)
    return F.least(F.lit(100), total).cast("int")


def scored(products: DataFrame, dynamic_caps: DataFrame | None = None, tiers: dict[str, list[str]] | None = None,
           caps: dict | None = None) -> DataFrame:
    """Listing filter plus score; listings that do not qualify get 0."""
    out = hard_filters(products, dynamic_caps, caps)
    return out.withColumn("deal_score", F.when(F.col("passed"), deal_score(tiers)).otherwise(F.lit(0)))


def quality_flags() -> list[Column]:
    """Columns ``strict_ok`` and ``relaxed_ok``: is the listing complete enough to show."""
    name = F.coalesce(F.col("name"), F.lit(""))
    bare = F.lower(F.trim(name))
    brand = F.coalesce(F.col("brand"), F.lit(""))
    weight = F.coalesce(F.col("weight_value").cast("double"), F.lit(0.0))
    doubled = bare.rlike(r"^(\S*)\s+\1\z")
    tiny = (F.col("category") == "edible") & (weight != 0) & (weight < L.MIN_EDIBLE_MG)
    relaxed = ~(bare.isin(L.LABEL_ONLY_NAMES) | (F.length(bare) < 5) | ((brand != "") & (bare == F.lower(brand)))
                | doubled | tiny)
    weightless = (F.col("category").isin(L.WEIGHT_REQUIRED) & (weight == 0)
                  & (F.coalesce(F.col("product_subtype"), F.lit("")) != "disposable"))
    # each way through the pattern begins a word with a digit, b or m
    promo = name.rlike(r"(?i)\b(?=[\dbm])(?:" + L.PROMO_NAME_PATTERN + ")")
    strict = relaxed & (brand != "") & ~weightless & ~promo
    return [strict.alias("strict_ok"), relaxed.alias("relaxed_ok")]


def is_junk_listing(name: Column, price: Column) -> Column:
    bare = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    copy = name.rlike("(?i)(?:" + "|".join(L.SALE_COPY_PATTERNS) + ")")
    percents = F.length(name) - F.length(F.replace(name, F.lit("%"), F.lit("")))
    long_promo = (F.length(name) > 100) & name.rlike(r"(?i)\d+%\s*off")
    return (F.coalesce(price, F.lit(0)) <= 0) | (F.length(bare) < 5) | bare.isin(L.LABEL_ONLY_NAMES) | copy | (
        percents >= 2) | long_promo


def selection_bucket() -> Column:
    """Category used for selection: disposables are their own bucket, unknown names fall into 'other'."""
    return (F.when((F.col("category") == "vape") & (F.col("product_subtype") == "disposable"), "disposable")
            .when(F.col("category").isin(list(L.CATEGORY_TARGETS)), F.col("category")).otherwise("other"))


def chain_of(store: Column) -> Column:
    """Chain prefix of a store slug: first dash part, two parts behind the listed heads."""
    parts = F.split(store, "-")
    two = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(L.MULTI_WORD_CHAIN_HEADS)
    return F.when(two, F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def badge(score: Column) -> Column:
    out = None
    for name, at_least in L.BADGES:
        hit = score >= at_least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def legacy_score() -> Column:
    """First-generation score: share of discount, cheapness and savings."""
    discount = F.coalesce(F.col("discount_percent").cast("double"), F.lit(0.0))
    price = F.when(F.col("sale_price") != 0, F.col("sale_price").cast("double")).otherwise(F.lit(30.0))
    savings = F.when(F.col("original_price") > F.col("sale_price"),
                     F.col("original_price") - F.col("sale_price")).otherwise(F.lit(0.0))
    total = F.least(F.lit(40.0), discount * 0.67) + F.greatest(F.lit(0.0), 30 - price) + F.least(F.lit(20.0), savings)
    return F.round(total.cast("decimal(12,6)"), 1).cast("double")


# First-generation price windows per category.
LEGACY_WINDOWS = {
    "edible": (3, 9), "preroll": (2, 6), "vape": (10, 25), "flower_3.5g": (10, 22), "flower_7g": (15, 35),
    "flower_14g": (20, 50), "concentrate_1g": (9, 25),
}
LEGACY_GLOBAL_CAP = 30
LEGACY_DISCOUNT = (20, 75)


def legacy_reject() -> Column:
    """First failing check of the first-generation rules, NULL when the listing qualifies.

    Expects the weight as text (``3.5g``) in ``weight``.
    """
    price, category = F.col("sale_price").cast("double"), F.col("category")
    weight = F.coalesce(F.col("weight"), F.lit(""))
    w = LEGACY_WINDOWS
    key = (F.when(category == "flower", F.when(weight.contains("3.5"), "flower_3.5g")
                  .when(weight.contains("7") & ~weight.contains("14"), "flower_7g")
                  .when(weight.contains("14"), "flower_14g").otherwise("flower_3.5g"))
           .when(category == "concentrate", "concentrate_1g").otherwise(category))
    low, high = case_of(key, {k: v[0] for k, v in w.items()}), case_of(key, {k: v[1] for k, v in w.items()})
    outside = (price < low) | (price > high)
    discount = F.col("discount_percent").cast("double")
    return (F.when(price.isNull() | (price == 0), "no_price")
            .when(price > LEGACY_GLOBAL_CAP, "global_cap")
            .when((category == "concentrate") & (weight != "") & ~weight.contains("1g"), "weight")
            .when(outside, "price_window")
            .when((category == "edible") & (weight != "") & ~weight.isin("100mg", "200mg"), "tiny_edible")
            .when(category == "other", "other_category")
            .when(discount < LEGACY_DISCOUNT[0], "low_discount")
            .when(discount > LEGACY_DISCOUNT[1], "high_discount"))
