"""Shop feed, filters, search and distances."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions import text as t
from leafmart.operators.catalog import not_blocked
from leafmart.operators.listings import normalize_deal
from leafmart.operators.ranking import SCORE_ORDER, cap_per_brand, cap_per_chain, top_n
from leafmart.session import cut_lineage


def active_deals(scored: DataFrame, region: str | None = None, limit: int = 500) -> DataFrame:
    """Live offers of a region (or all), best first."""
    rows = scored.filter(F.col("is_active") & (F.col("deal_score") > 0) & (F.col("sale_price") > 0))
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    best = top_n(rows, SCORE_ORDER, limit)
    return best.filter((F.length(F.coalesce("name", F.lit(""))) >= 5) & not_blocked(F.col("dispensary_id")))


def expired_deals(scored: DataFrame, region: str, as_of: str, hours: int = 48, limit: int = 200) -> DataFrame:
    """Offers that went inactive within the last 48 hours, behind the stricter feed caps."""
    since = F.lit((dt.datetime.fromisoformat(as_of) - dt.timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp_ntz")
    rows = scored.filter(~F.col("is_active") & (F.col("region") == region) & (F.col("deal_score") > 0) & (F.col("sale_price") > 0)
                         & (F.col("scraped_at") >= since))
    best = top_n(rows, SCORE_ORDER, limit)
    best = best.filter((F.length(F.coalesce("name", F.lit(""))) >= 5) & not_blocked(F.col("dispensary_id")))
    return feed_caps(best, 25, 4, 12)


def feed_caps(deals: DataFrame, per_chain: int = 40, per_category: int = 6, per_brand: int = 18) -> DataFrame:
    """Chain cap, then brand cap over the chain-capped order (guaranteed store offers first)."""
    capped = cap_per_chain(deals, per_chain).withColumn("_g", F.when(F.col("is_guaranteed"), 0).otherwise(1))
    return cap_per_brand(capped, per_category, per_brand, order=["_g", *SCORE_ORDER]).drop("_g")


def filter_deals(deals: DataFrame, categories: list[str] | None = None, stores: list[str] | None = None, brand: str | None = None,
                 min_price: float | None = None, max_price: float | None = None, min_discount: float | None = None,
                 query: str | None = None) -> DataFrame:
    out = deals
    if categories:
        out = out.filter(F.col("category").isin(categories))
    if stores:
        out = out.filter(F.col("dispensary_id").isin(stores))
    if brand:
        out = out.filter(F.col("brand") == brand)
    if min_price is not None:
        out = out.filter(F.col("sale_price") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("sale_price") <= max_price)
    if min_discount is not None:
        rate = (F.col("original_price") - F.col("sale_price")) / F.col("original_price") * 100
        out = out.filter((F.coalesce("original_price", F.lit(0)) == 0) | (rate >= min_discount))
    if query:
        q = query.lower()
        word = rf"(?i)\b{re.escape(q)}\b"
        hit = [F.coalesce(F.col(c), F.lit("")).rlike(word) for c in ("name", "brand", "dispensary_name")]
        part = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q)) for c in ("category", "weight")]
        out = out.filter(hit[0] | hit[1] | hit[2] | part[0] | part[1])
    return out


SHOP_CATEGORIES = ["flower", "preroll", "vape", "edible", "concentrate"]


def shop_rows(products: DataFrame, categories: list[str] | None = None, stores: list[str] | None = None, brand: str | None = None,
              min_price: float | None = None, max_price: float | None = None, min_discount: float | None = None, query: str | None = None,
              sizes: list[str] | None = None, mode: str = "and", ids: list[str] | None = None) -> DataFrame:
    """Shop rows of stored listings behind the filters of `filter_deals` and `weight_filter`.

    What can be told from stored columns is asked of the scan, before rows are repaired by `normalize_deal`; only the
    query (it may hit the weight text) and sizes are tested after. A category that the shop does not know counts as flower.
    """
    base = products
    if categories:
        wanted = F.col("category").isin(categories)
        if "flower" in categories:
            wanted = wanted | F.col("category").isNull() | ~F.col("category").isin(SHOP_CATEGORIES)
        base = base.filter(wanted)
    if ids is not None:
        base = base.filter(F.col("id").isin(ids))
    base = filter_deals(base, None, stores, brand, min_price, max_price, min_discount)
    if sizes == ["disposable"] or (sizes and "disposable" in sizes and mode == "and"):
        base = base.filter(F.col("product_subtype") == "disposable")
    return weight_filter(filter_deals(normalize_deal(base), categories, query=query), sizes or [], mode)


def grams(weight: Column) -> Column:
    """Grams of a weight text: fractions of an ounce, milligrams, ounces, then bare numbers."""
    w = F.lower(F.trim(weight))
    return (F.when(w.contains("1/8"), 3.5).when(w.contains("1/4"), 7.0).when(w.contains("1/2"), 14.0)
            .otherwise(F.coalesce(t.number(w, r"([0-9.]+)\s*mg") / 1000, t.number(w, r"([0-9.]+)\s*oz") * 28, t.number(w, r"([0-9.]+)\s*g?$"))))


def weight_matches(weight: Column, wanted: str) -> Column:
    mg, wanted_mg = t.number(weight, r"([0-9.]+)\s*mg"), re.search(r"([\d.]+)\s*mg", wanted, re.I)
    by_gram = F.abs(grams(weight) - grams(F.lit(wanted))) < 0.005
    if wanted_mg:
        by_gram = F.when(mg.isNotNull(), F.abs(mg - float(wanted_mg.group(1))) < 0.5).otherwise(by_gram)
    return F.coalesce((weight == wanted) | by_gram, F.lit(False))


def weight_filter(deals: DataFrame, filters: list[str], mode: str = "and") -> DataFrame:
    """Keeps offers of any wanted weight; 'disposable' narrows them (feed, ``and``) or adds to them (search, ``or``)."""
    if not filters:
        return deals
    sizes = [f for f in filters if f != "disposable"]
    disposable = F.coalesce(F.col("product_subtype") == "disposable", F.lit(False))
    size = F.lit(False)
    for wanted in sizes:
        size = size | weight_matches(F.col("weight"), wanted)
    if "disposable" not in filters:
        return deals.filter(size)
    if not sizes:
        return deals.filter(disposable)
    return deals.filter(disposable & size if mode == "and" else disposable | size)


# ---------------------------------------------------------------------------
# Distances
# ---------------------------------------------------------------------------

def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Miles between two points, NULL when one is unknown."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return L.EARTH_RADIUS_HAVERSINE * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def law_of_cosines(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    c = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return L.EARTH_RADIUS_COSINE * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def distance_to_points(stores: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of store and point within ``radius`` miles. Both sides meet in grid cells of the radius, so only
    neighbours are compared; longitude cells are widened for the latitude band (up to 60 degrees)."""
    step_lat, step_lng = radius / 69.0 * 1.01, radius / 34.0 * 1.01
    cell = lambda c, step: F.floor(F.col(c) / step).cast("long")
    s = stores.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumns(
        {"_x": cell("latitude", step_lat), "_y": cell("longitude", step_lng)})
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns(
        {"_x": cell("lat", step_lat) + F.col("_dx"), "_y": cell("lng", step_lng) + F.col("_dy")})
    pairs = s.join(p.select("point_id", "lat", "lng", "_x", "_y"), ["_x", "_y"])
    pairs = pairs.withColumn("miles", haversine(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude")))
    return pairs.filter(F.col("miles") <= radius).select("point_id", F.col("id").alias("store"), "miles")


def with_distance(deals: DataFrame, lat: float, lng: float) -> DataFrame:
    return deals.withColumn("miles", haversine(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude")))


def distance_filter(deals: DataFrame, most: float) -> DataFrame:
    """Within ``most`` miles; offers of stores without coordinates stay."""
    return deals.filter(F.col("miles").isNull() | (F.col("miles") < most))


def distance_label(miles: Column) -> Column:
    out = F.when(miles.isNull(), "")
    for most, label in L.DISTANCE_LABELS:
        out = out.when(miles < most, label)
    return out.otherwise("Far")


def nearest_reference(rows: DataFrame, points: list[tuple[str, float, float]], lat: str, lng: str) -> DataFrame:
    """Nearest of a fixed list of points by squared difference; the list is a literal, so there is no join."""
    ref = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(o)).alias("o"), F.lit(z).alias("z")) for z, a, o in points])
    gaps = F.transform(ref, lambda p: F.struct((F.pow(p["a"] - F.col(lat), 2) + F.pow(p["o"] - F.col(lng), 2)).alias("d"), p["z"].alias("z")))
    return rows.withColumn("nearest", F.array_min(gaps)["z"])


# ---------------------------------------------------------------------------
# Sorts and search
# ---------------------------------------------------------------------------

def feed_sort_key(kind: str) -> list[Column]:
    rate = F.when(F.coalesce("original_price", F.lit(0)) != 0, (F.col("original_price") - F.col("sale_price")) / F.col("original_price") * 100).otherwise(0)
    keys = {"deal_score": F.col("deal_score").desc(), "price_asc": F.col("sale_price").asc(), "price_desc": F.col("sale_price").desc(),
            "discount": rate.desc(), "distance": F.coalesce("miles", F.lit(999.0)).asc()}
    return [keys[kind], F.col("id").asc()]


def feed_ranks(offers: DataFrame, kind: str) -> DataFrame:
    """(id, position) of every offer in the sorted feed.

    Ranges of the sort key are sorted each for itself; a range's rows come after those of all ranges before, so one row a
    range is all that meets in one place.
    """
    keys = feed_sort_key(kind)
    narrow = offers.select("id", *[c for c in ("deal_score", "sale_price", "original_price", "miles") if c in offers.columns])
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", F.monotonically_increasing_id().alias("_at"))
    # the number of a range and the place in it, fixed before both are used
    placed = cut_lineage(ranged.select("id", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row")))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_range").select("id", (F.col("_before") + F.col("_row") + 1).alias("position"))


def search(scored: DataFrame, query: str, region: str, curated: DataFrame | None = None, limit: int = 200, shown: int = 60) -> DataFrame:
    """Two-step search: the best ``limit`` live listings that contain the text, then those with a word that starts
    with it, without the curated ones and without accessories; exact brand, discount and price order the ``shown`` rows."""
    q = query.strip()[:100]
    if len(q) < 2:
        return scored.limit(0)
    fields = ["name", "brand", "category", "product_subtype", "strain_type"]
    text = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}
    contains = [F.contains(F.lower(x), F.lit(q.lower())) for x in text.values()]
    prefix = [x.rlike(rf"(?i)\b{re.escape(q.lower())}") for x in text.values()]
    either = lambda cs: cs[0] | cs[1] | cs[2] | cs[3] | cs[4]
    rows = scored.filter(F.col("is_active") & (F.col("region") == region) & (F.col("sale_price") > 0)
                         & (F.col("discount_percent").isNull() | (F.col("discount_percent") > 0)) & either(contains))
    hits = top_n(rows, SCORE_ORDER, limit).filter(
        not_blocked(F.col("dispensary_id")) & (F.length("name") >= 5) & ~F.col("name").rlike("(?i)" + L.SEARCH_JUNK_PATTERN) & either(prefix))
    if curated is not None:
        hits = hits.join(curated.select("id"), "id", "left_anti")
    exact = F.when(F.lower(F.coalesce("brand", F.lit(""))) == q.lower(), 0).otherwise(1)
    rate = F.when(F.col("original_price") > F.col("sale_price"), (F.col("original_price") - F.col("sale_price")) / F.col("original_price")).otherwise(0)
    return hits.orderBy(exact, rate.desc(), "sale_price", "id").limit(shown)


# Local nicknames of stores.
STORE_ALIASES = {
    "p13": ["planet13"], "planet13": ["planet13"],
    "drh": ["deep-roots-cheyenne", "deep-roots-craig", "deep-roots-blue-diamond", "deep-roots-parkson", "deep-roots-willis"],
    "td": ["td-gibson", "td-decatur", "td-eastern"], "bh": ["beyond-hello-sahara", "beyond-hello-twain"],
    "b/h": ["beyond-hello-sahara", "beyond-hello-twain"], "gl": ["greenlight-downtown", "greenlight-paradise"],
    "nuleaf": ["beyond-hello-twain"], "nu leaf": ["beyond-hello-twain"], "apothecarium": ["beyond-hello-sahara"],
}


def store_lookup(stores: DataFrame, query: str, limit: int = 8, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    q = query.lower().strip()
    word = rf"(?i)\b{re.escape(q)}"
    ids = (aliases or STORE_ALIASES).get(q, [])
    hit = F.col("name").rlike(word) | F.col("address").rlike(word) | F.col("id").isin(ids)
    return stores.filter(hit if len(q) >= 2 else F.lit(False)).orderBy("id").limit(limit)


def brand_lookup(brands: DataFrame, query: str, limit: int = 6) -> DataFrame:
    q = query.lower()
    return brands.filter(F.contains(F.lower("brand"), F.lit(q)) if len(q) >= 2 else F.lit(False)).orderBy("brand").limit(limit)


def word_search(products: DataFrame, word: str, categories: list[str] | None = None, limit: int = 20, whole: bool = True,
                fields: tuple[str, ...] = ("name", "brand"), without: str | None = None) -> DataFrame:
    """Live listings with a word (whole or as a word start) in name or brand, cheapest first."""
    pattern = rf"(?i)\b{word}" + (r"\b" if whole else "")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.col(f), F.lit("")).rlike(pattern)
    rows = products.filter(F.col("is_active") & hit)
    if categories:
        rows = rows.filter(F.col("category").isin(categories))
    if without:
        rows = rows.filter(~F.col("name").rlike("(?i)" + without))
    return rows.orderBy("sale_price", "id").limit(limit)


def best_price_per_gram(products: DataFrame, weights: list[float], name_pattern: str, limit: int = 20) -> DataFrame:
    """Flower of the wanted sizes by price per gram, unknown sizes last."""
    w = F.col("weight_value")
    rows = products.filter(F.col("is_active") & (F.col("category") == "flower") & (F.col("weight_unit") == "g")
                           & (w.isin(weights) | F.col("name").rlike("(?i)" + name_pattern)))
    rows = rows.withColumn("price_per_gram", F.round((F.col("sale_price") / F.when(w > 0, w)).cast("decimal(30,10)"), 2).cast("double"))
    return rows.orderBy(F.col("price_per_gram").asc_nulls_last(), "id").limit(limit)


def multi_brand_search(products: DataFrame, brands: dict[str, str], category: str, limit: int = 30) -> DataFrame:
    """Listings of several brands, labelled by the brand whose word matched the brand field."""
    label, hit = None, F.lit(False)
    for word, name in brands.items():
        in_brand = F.coalesce("brand", F.lit("")).rlike(rf"(?i)\b{word}\b")
        label = F.when(in_brand, name) if label is None else label.when(in_brand, name)
        hit = hit | in_brand | F.col("name").rlike(rf"(?i)\b{word}\b")
    rows = products.filter(F.col("is_active") & (F.col("category") == category) & hit).withColumn("matched_brand", label.otherwise("Other"))
    return rows.orderBy("matched_brand", "sale_price", "id").limit(limit)


# ---------------------------------------------------------------------------
# Freshness and badges
# ---------------------------------------------------------------------------

def hours_since(col: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    return (F.unix_seconds(now) - F.unix_seconds(col.cast("timestamp"))) / 3600.0


def new_since(deals: DataFrame, as_of: str, first_seen: str = "first_seen", hours: int = 24) -> DataFrame:
    return deals.filter(hours_since(F.col(first_seen), as_of) <= hours)


def social_proof(deals: DataFrame, as_of: str) -> DataFrame:
    """Most important badge per offer. Needs save_count, recent_saves, created_at and deal_score."""
    now = F.lit(as_of).cast("timestamp_ntz")
    weekday, hour = F.dayofweek(now), F.hour(now)
    saves, recent = F.col("save_count"), F.col("recent_saves")
    weekend = weekday.isin(6, 7, 1)
    badge = lambda p, name: F.struct(F.lit(p).alias("priority"), F.lit(name).alias("badge"))
    options = F.array(
        F.when(saves >= 25, badge(100, "hot_deal")).when(saves >= 10, badge(80, "hot_deal")),
        F.when(recent >= 10, badge(90, "trending")).when(recent >= 5, badge(70, "trending")),
        F.when(hours_since(F.col("created_at"), as_of) <= 3, badge(60, "new_arrival")),
        F.when(weekend, badge(50, "weekend_special")).when((weekday == 2) & (hour < 12), badge(85, "last_day")),
        F.when(F.col("deal_score") >= 70, badge(40, "popular_store")))
    return deals.withColumn("_b", F.array_max(F.array_compact(options))).withColumns(
        {"badge": F.coalesce("_b.badge", F.lit("")), "priority": F.coalesce("_b.priority", F.lit(0)).cast("long")}).drop("_b")


# ---------------------------------------------------------------------------
# Places and times
# ---------------------------------------------------------------------------

def zip_to_state(zip_code: Column) -> Column:
    digits = F.regexp_replace(zip_code, r"[^0-9]", "")
    prefix = F.when(F.length(digits) >= 3, F.substring(digits, 1, 3)).try_cast("int")
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(state).alias("state")) for lo, hi, state in L.ZIP3_RANGES])
    return F.get(F.filter(ranges, lambda r: prefix.between(r["lo"], r["hi"])), F.lit(0))["state"]


def legality(state: Column) -> Column:
    return F.when(state.isin(L.RECREATIONAL_STATES), "recreational").when(state.isin(L.MEDICAL_STATES), "medical_only").otherwise("no_legal")


def nevada_region(zip_code: Column, state_rule: bool = False) -> Column:
    """Market of a Nevada ZIP; the two rules of the product disagree on 893 and 894 (``state_rule`` sends them north)."""
    five = F.substring(F.trim(zip_code), 1, 5)
    prefix = F.when(five.rlike("^[0-9]{5}$"), F.substring(five, 1, 3).try_cast("int"))
    if state_rule:
        return F.when(prefix >= 893, "northern-nv").otherwise("southern-nv")
    return F.when(prefix.between(890, 891) | prefix.between(893, 894), "southern-nv").when(prefix.between(895, 898), "northern-nv")


def region_from_latitude(lat: Column) -> Column:
    return F.when(lat > 37.5, "northern-nv").otherwise("southern-nv")


def next_local_midnight(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """UTC instant of the next midnight in a time zone."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.to_utc_timestamp(F.date_add(F.to_date(local), 1).cast("timestamp"), zone)
