"""Ranks, duplicate removal, diversity caps and guaranteed picks.

All ranks end with a unique key, so results do not depend on partitioning. Every per-group limit is written as
``row_number() <= n`` right above its window: Spark then keeps only the first ``n`` rows per key inside each map
task (window group limit), so even one key with a third of all rows ships ``n`` rows per task, not the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions.pricing import (
    case_of, chain_of, has_column, is_merch, brand_points, selection_bucket,
)
from leafmart.session import cut_lineage

SCORE_ORDER = ["deal_score desc", "id"]


def order_of(spec: list[str]) -> list[Column]:
    out = []
    for item in spec:
        name, _, direction = item.partition(" ")
        out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    return out


def top_per_group(df: DataFrame, keys: list[str], order: list[str], n: int, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (which must end with a unique column)."""
    rank = rank_col or "_rn"
    window = Window.partitionBy(*keys).orderBy(*order_of(order))
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return out if rank_col else out.drop(rank)


def top_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order_of(order)).limit(n)


def top_100_curated(scored: DataFrame, stored: bool = False) -> DataFrame:
    """Best 100 active offers that are in the top 30 of their category, top 5 of their brand and top 10 of
    their store, the three ranks being independent of each other.

    The category top 30 bounds the candidates (30 x the fixed category list). The other two ranks are computed
    only for the brands and stores of those candidates; the three broadcast sets hold at most 210, 1,050 and
    2,100 rows by construction. All three read the live offers, which are written once for them; ``stored``: the offers
    are a table already, not steps to repeat.
    """
    live = scored.filter((F.col("is_active")) & (F.col("deal_score") > 0))
    live = live if stored else cut_lineage(live)
    live = live.withColumn("_brand", F.coalesce("brand", F.lit("\u0000")))
    candidates = top_per_group(live, ["category"], SCORE_ORDER, 30)
    by_brand = top_per_group(
        live.join(F.broadcast(candidates.select("_brand").distinct()), "_brand", "left_semi").select("_brand", "deal_score", "id"),
        ["_brand"], SCORE_ORDER, 5)
    by_store = top_per_group(
        live.join(F.broadcast(candidates.select("dispensary_id").distinct()), "dispensary_id", "left_semi")
        .select("dispensary_id", "deal_score", "id"),
        ["dispensary_id"], SCORE_ORDER, 10)
    kept = candidates.join(F.broadcast(by_brand.select("id")), "id", "left_semi").join(
        F.broadcast(by_store.select("id")), "id", "left_semi")
    return top_n(kept.drop("_brand"), SCORE_ORDER, 100)


def normalized_name(name: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def dedup_batch(batch: DataFrame, seq: str = "id") -> DataFrame:
    """One row per (store, normalised name, weight, price); the last by ``seq`` wins, NULL weights are equal."""
    keyed = batch.withColumn("_n", normalized_name(F.col("name")))
    return top_per_group(keyed, ["dispensary_id", "_n", "weight_value", "sale_price"], [f"{seq} desc"], 1).drop("_n")


def limit_similar(deals: DataFrame, n: int = L.MAX_SIMILAR_PER_STORE, scope: list[str] | None = None) -> DataFrame:
    """At most ``n`` per store, brand and category."""
    brand = F.when(F.coalesce("brand", F.lit("")) == "", "unknown").otherwise(F.lower("brand"))
    keyed = deals.withColumn("_b", brand).withColumn("_d", F.coalesce("dispensary_id", F.lit("")))
    return top_per_group(keyed, [*(scope or []), "_d", "_b", "category"], SCORE_ORDER, n).drop("_b", "_d")


def dedup_cross_chain(deals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same product at several stores of a chain is kept once."""
    keyed = (deals.withColumn("_chain", chain_of(F.coalesce("dispensary_id", F.lit(""))))
             .withColumn("_n", F.lower(F.trim("name"))).withColumn("_b", F.lower(F.coalesce("brand", F.lit("")))))
    return top_per_group(keyed, [*(scope or []), "_chain", "_n", "_b", "category"], SCORE_ORDER, 1).drop(
        "_chain", "_n", "_b")


def dedup_name_key(name: Column, brand: Column) -> Column:
    """Name without brand, strain, leading weight, format words and punctuation."""
    lower = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    b = F.lower(F.coalesce(brand, F.lit("")))
    # the brand is data, so it is quoted inside the pattern
    quoted = F.concat(F.lit(r"\b\Q"), b, F.lit(r"\E\b"))
    out = F.when(b == "", lower).otherwise(F.regexp_replace(lower, quoted, F.lit("")))
    out = F.regexp_replace(out, r"\b(?:indica|sativa|hybrid|indica-hybrid|sativa-hybrid)\b", "")
    out = F.regexp_replace(out, r"^\.?\d+\.?\d*\s*g\s*\|\s*", "")
    out = F.regexp_replace(out, r"\b(?:cartridge|cart|disposable|badder|pre-?roll|gummy|gummies)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", ""), r"\s+", " "))


def dedup_global_name(deals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The same brand and product sold anywhere is kept once, with its best score."""
    keyed = (deals.withColumn("_n", dedup_name_key(F.col("name"), F.col("brand")))
             .withColumn("_b", F.lower(F.coalesce("brand", F.lit("")))))
    return top_per_group(keyed, [*(scope or []), "_n", "_b", "category"], SCORE_ORDER, 1).drop("_n", "_b")


def cap_per_store(deals: DataFrame, n: int = 5, scope: list[str] | None = None) -> DataFrame:
    return top_per_group(deals, [*(scope or []), "dispensary_id"], SCORE_ORDER, n)


def cap_per_chain(deals: DataFrame, n: int, scope: list[str] | None = None, chains: dict[str, str] | None = None) -> DataFrame:
    """First offer of each store always stays; others fill their chain up to ``n``.

    Exact without a scan: with ``g`` guaranteed stores in a chain, the other rows of rank <= n - g stay.
    Adds ``is_guaranteed`` (guaranteed offers come first in the feed).
    """
    scope = scope or []
    chain = case_of(F.col("dispensary_id"), chains) if chains else None
    chain = F.coalesce(chain, F.col("dispensary_id")) if chains else chain_of(F.col("dispensary_id"))
    keyed = deals.withColumn("_chain", chain)
    first = top_per_group(keyed, [*scope, "dispensary_id"], SCORE_ORDER, 1)
    taken = first.groupBy(*scope, "_chain").agg(F.count("*").alias("_g"))
    rest = keyed.join(first.select("id"), "id", "left_anti")
    ranked = top_per_group(rest, [*scope, "_chain"], SCORE_ORDER, n, "_rank")
    kept = ranked.join(taken, [*scope, "_chain"]).filter(F.col("_rank") + F.col("_g") <= n)
    cols = deals.columns
    return first.select(*cols, F.lit(True).alias("is_guaranteed")).unionByName(
        kept.select(*cols, F.lit(False).alias("is_guaranteed")))


def cap_per_brand(deals: DataFrame, per_category: int = 4, total: int = 12, scope: list[str] | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """Two-tier brand cap; offers without a brand all stay.

    Same as the sequential scan: a row over the total never frees a category slot for a later one.
    """
    scope, order = scope or [], order or SCORE_ORDER
    bucket = F.when((F.col("category") == "vape") & (F.col("product_subtype") == "disposable"), "disposable").otherwise(
        F.col("category"))
    branded = deals.filter(F.coalesce("brand", F.lit("")) != "").withColumn("_bucket", bucket)
    step1 = top_per_group(branded, [*scope, "brand", "_bucket"], order, per_category).drop("_bucket")
    step2 = top_per_group(step1, [*scope, "brand"], order, total)
    return step2.unionByName(deals.filter(F.coalesce("brand", F.lit("")) == ""))


# ---------------------------------------------------------------------------
# Price and subtype leaders, slots
# ---------------------------------------------------------------------------

def leader_tier() -> Column:
    """Size tier used for price leaders; NULL without a weight and outside flower and vapes."""
    w = F.coalesce(F.col("weight_value").cast("double"), F.lit(0.0))
    bucket = F.col("bucket")
    return F.when(w > 0, F.when(bucket == "flower", F.when(w <= 4, "eighth").when(w <= 8, "quarter").when(
        w <= 15, "half").otherwise("oz")).when(
        bucket == "disposable", F.when(w <= 0.5, "small").when(w < 0.8, "medium").otherwise("large")).when(
        bucket == "vape", F.when(w <= 0.6, "half_gram").otherwise("full_gram")))


def with_buckets(deals: DataFrame) -> DataFrame:
    price = F.when(F.coalesce(F.col("sale_price"), F.lit(0)) != 0, F.col("sale_price")).otherwise(F.lit(999.0))
    return deals.withColumn("bucket", selection_bucket()).withColumn("_price", price.cast("double"))


def bucket_leaders(deals: DataFrame, group_cols: list[str]) -> DataFrame:
    """Leaders of each bucket with their position (``leader_rank``), cheapest first.

    Flower, disposables and vapes: the cheapest per size tier, filled up to 4/3/2 with the cheapest others.
    Concentrates, edibles and prerolls: the cheapest per subtype, or the 3 cheapest when no subtype is known.
    Everything else (and pools below the minimum size): the 3 cheapest.
    """
    pool = with_buckets(deals).withColumn("_tier", leader_tier())
    g = [*group_cols, "bucket"]
    cheapest = ["_price", "id"]
    sizes = pool.groupBy(*g).agg(
        F.count("*").alias("bucket_size"),
        F.max(F.coalesce("product_subtype", F.lit("")) != "").alias("_has_subtype"))
    fill_to = case_of(F.col("bucket"), {"flower": 4, "disposable": 3, "vape": 2})
    by_subtype = F.col("bucket").isin("concentrate", "edible", "preroll") & (F.col("bucket_size") >= 2) & F.col("_has_subtype")
    by_tier = ((F.col("bucket") == "flower") & (F.col("bucket_size") >= 4)
               | (F.col("bucket") == "disposable") & (F.col("bucket_size") >= 3)
               | (F.col("bucket") == "vape") & (F.col("bucket_size") >= 2))
    mode = F.when(by_tier, "tier").when(by_subtype, "subtype").otherwise("cheapest")
    sizes = sizes.withColumn("_mode", mode).withColumn("_fill", F.coalesce(fill_to, F.lit(3)))

    tier_best = top_per_group(pool.filter(F.col("_tier").isNotNull()), [*g, "_tier"], cheapest, 1)
    sub_best = top_per_group(pool.filter(F.coalesce("product_subtype", F.lit("")) != ""),
                             [*g, "product_subtype"], cheapest, 1)
    few = top_per_group(pool, g, cheapest, 8, "_cheap_rank")

    first = (tier_best.join(sizes, g).filter(F.col("_mode") == "tier").select(*g, "id", "_price", F.lit(0).alias("_pri"))
             .unionByName(sub_best.join(sizes, g).filter(F.col("_mode") == "subtype")
                          .select(*g, "id", "_price", F.lit(0).alias("_pri"))))
    # up to 4 tier leaders plus the 4 cheapest others always lie within the 8 cheapest and the leaders
    others = (few.join(first.select("id"), "id", "left_anti").join(sizes, g).filter(F.col("_mode") != "subtype")
              .select(*g, "id", "_price", F.lit(1).alias("_pri")))
    union = first.unionByName(others).join(sizes.select(*g, "_mode", "_fill"), g)
    pick = F.row_number().over(Window.partitionBy(*g).orderBy("_pri", "_price", "id"))
    picked = union.withColumn("_pick", pick).filter((F.col("_mode") == "subtype") | (F.col("_pick") <= F.col("_fill")))
    rank = F.row_number().over(Window.partitionBy(*g).orderBy("_price", "id"))
    return picked.withColumn("leader_rank", rank).select(*g, "id", "leader_rank")


def slot_allocation(deals: DataFrame, group_cols: list[str], target: int = L.TARGET_DEALS) -> DataFrame:
    """Slots per bucket: targets first, then the surplus to under-filled buckets by target (up to 1.5x, never
    'other'), then what is left by supply. Works on at most seven rows per group."""
    sizes = deals.withColumn("bucket", selection_bucket()).groupBy(*group_cols, "bucket").agg(
        F.count("*").alias("bucket_size"))
    per = Window.partitionBy(*group_cols)
    goal = case_of(F.col("bucket"), L.CATEGORY_TARGETS)
    out = sizes.withColumn("_goal", goal).withColumn("total_available", F.sum("bucket_size").over(per))
    out = out.withColumn("target", F.least(F.lit(target), F.col("total_available")))
    out = out.withColumn("_base", F.least("_goal", "bucket_size"))
    left1 = F.col("target") - F.sum("_base").over(per)
    out = out.withColumn("_left1", left1)
    stretch = F.floor(F.col("_goal") * 1.5).cast("long")
    room1 = F.when(F.col("bucket") == "other", 0).otherwise(
        F.greatest(F.lit(0), F.least(F.col("bucket_size"), stretch) - F.col("_base")))
    out = out.withColumn("_room1", room1)
    by_goal = per.orderBy(F.col("_goal").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before1 = F.coalesce(F.sum("_room1").over(by_goal), F.lit(0))
    out = out.withColumn("_add1", F.greatest(F.lit(0), F.least("_room1", F.col("_left1") - before1)))
    out = out.withColumn("_slots1", F.col("_base") + F.col("_add1"))
    out = out.withColumn("_left2", F.col("_left1") - F.sum("_add1").over(per))
    limit2 = F.when(F.col("bucket") == "other", F.col("_goal")).otherwise(stretch)
    out = out.withColumn("_room2", F.greatest(F.lit(0), F.least(F.col("bucket_size"), limit2) - F.col("_slots1")))
    by_supply = per.orderBy(F.col("bucket_size").desc(), F.col("_goal").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before2 = F.coalesce(F.sum("_room2").over(by_supply), F.lit(0))
    out = out.withColumn("_add2", F.greatest(F.lit(0), F.least("_room2", F.col("_left2") - before2)))
    return out.select(*group_cols, "bucket", "bucket_size", "total_available", F.col("target").cast("long").alias("target"),
                      (F.col("_slots1") + F.col("_add2")).cast("long").alias("slots"))


# ---------------------------------------------------------------------------
# Guaranteed picks and floors
# ---------------------------------------------------------------------------

def store_floor(n_products: Column) -> Column:
    out = None
    for at_least, floor in L.STORE_FLOORS:
        hit = n_products >= at_least
        out = F.when(hit, F.lit(floor)) if out is None else out.when(hit, F.lit(floor))
    return out


def simple_score(tiers: dict[str, list[str]] | None = None) -> Column:
    """Score of the safety net: brand, price band and category only, at least 15."""
    sale = F.col("sale_price").cast("double")
    band = (F.when(sale.between(8, 15), 12).when((sale > 15) & (sale <= 25), 10).when((sale >= 5) & (sale < 8), 8)
            .when((sale > 25) & (sale <= 40), 6).otherwise(0))
    category = F.coalesce(case_of(F.col("category"), L.CATEGORY_POINTS), F.lit(L.OTHER_CATEGORY_POINTS))
    return F.greatest(F.lit(15), brand_points(F.col("brand"), tiers) + band + category)


def guaranteed_picks(products: DataFrame, group_cols: list[str], needed: DataFrame,
                     tiers: dict[str, list[str]] | None = None) -> DataFrame:
    """Up to ``needed`` forced picks per group by simple score: distinct categories first, then by score without
    repeating (name, price). ``needed`` has the group columns and ``n_needed`` (at most 5)."""
    usable = products.filter(
        (F.col("sale_price") >= L.MIN_PRICE) & (F.col("sale_price") <= L.MAX_PRICE)
        & (F.length(F.trim(F.coalesce("name", F.lit("")))) >= 5)
        & ~is_merch(F.col("name"), has_column(products, "raw_text")))
    usable = usable.withColumn("_simple", simple_score(tiers))
    order = ["_simple desc", "id"]
    most = L.STORE_FLOORS[0][1]
    # per group: the best of each category, and the best rows of distinct (name, price); both bounded by the floor
    by_cat = cut_lineage(top_per_group(usable, [*group_cols, "category"], order, 1))  # read twice below
    distinct = top_per_group(usable, [*group_cols, "name", "sale_price"], order, 1)
    pool = top_per_group(distinct, group_cols, order, 2 * most + 2)
    both = by_cat.withColumn("_pass", F.lit(0)).unionByName(pool.withColumn("_pass", F.lit(1)))
    # few rows a group: dealt once, for the names that a category's best has taken, the ranks and the floor
    both = both.repartition(*group_cols).withColumn("_first", F.min("_pass").over(Window.partitionBy(*group_cols, "name", "sale_price")))
    ranked = both.filter(F.col("_pass") == F.col("_first")).drop("_first").withColumn("_pick", F.row_number().over(
        Window.partitionBy(*group_cols).orderBy("_pass", F.col("_simple").desc(), "id")))
    picked = ranked.join(needed.select(*group_cols, "n_needed"), group_cols).filter(F.col("_pick") <= F.col("n_needed"))
    return picked.withColumn("deal_score", F.least(F.lit(L.GUARANTEE_SCORE_CAP), F.col("_simple")).cast("int")).drop(
        "_simple", "_pass", "_pick", "n_needed")


def relaxed_backfill(judged: DataFrame, group_cols: list[str]) -> DataFrame:
    """Rows kept by the strict gate plus, where a store has fewer than its floor, the best relaxed rows.

    ``judged`` carries ``passed``, ``deal_score``, ``strict_ok`` and ``relaxed_ok`` for every listing of the store.
    """
    sizes = judged.groupBy(*group_cols).agg(
        F.count("*").alias("n_products"), F.sum((F.col("passed") & F.col("strict_ok")).cast("long")).alias("n_strict"))
    short = sizes.withColumn("_gap", store_floor(F.col("n_products")) - F.col("n_strict")).filter("_gap > 0")
    strict = judged.filter(F.col("passed") & F.col("strict_ok"))
    spare = judged.filter(F.col("passed") & ~F.col("strict_ok") & F.col("relaxed_ok"))
    fill = top_per_group(spare, group_cols, SCORE_ORDER, L.STORE_FLOORS[0][1], "_rank")
    fill = fill.join(short.select(*group_cols, "_gap"), group_cols).filter(F.col("_rank") <= F.col("_gap"))
    return strict.unionByName(fill.select(*strict.columns))


def top_cut(scored: DataFrame, selected: DataFrame, group_cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """Best qualifying offers that were not selected (by name and price), overall or per group."""
    cut = scored.join(selected.select("name", "sale_price").distinct(), ["name", "sale_price"], "left_anti")
    return top_per_group(cut, group_cols, SCORE_ORDER, n) if group_cols else top_n(cut, SCORE_ORDER, n)


def trending_at_store(deals: DataFrame) -> DataFrame:
    """Saves above 1.5 times the store average, stores with at least 3 offers."""
    stats = deals.groupBy("dispensary_id").agg(F.count("*").alias("_n"), F.sum("save_count").alias("_s"))
    joined = deals.join(stats, "dispensary_id")
    hot = (F.col("_n") >= 3) & (F.col("save_count") * 2 * F.col("_n") > 3 * F.col("_s"))
    return joined.withColumn("is_trending", hot).drop("_n", "_s")


def round_robin_assign(stores: DataFrame, shards: int) -> DataFrame:
    """Shard per store (position in its region modulo ``shards``) and the platform-interleaved position."""
    in_region = Window.partitionBy("region").orderBy("id")
    in_platform = Window.partitionBy("region", "platform").orderBy("id")
    out = stores.withColumn("shard", ((F.row_number().over(in_region) - 1) % shards + 1).cast("long"))
    out = out.withColumn("_turn", F.row_number().over(in_platform))
    return out.withColumn("position", F.row_number().over(
        Window.partitionBy("region").orderBy("_turn", "platform")).cast("long")).drop("_turn")
