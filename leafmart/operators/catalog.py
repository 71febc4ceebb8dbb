"""Listing audits, quality reports and browse counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart.functions.numbers import cents, count_if, flag, ratio, ratio_even
from leafmart.functions.pricing import case_of, selection_bucket
from leafmart.operators.prices import at_index, histogram
from leafmart.operators.ranking import top_per_group
from leafmart.session import cut_lineage


def _known(col: str, default: str) -> Column:
    return F.coalesce(F.col(col), F.lit(default))


def volume_audit(products: DataFrame) -> DataFrame:
    """Active listings by region, category, platform and (region, category), one pass with grouping sets."""
    live = products.filter("is_active").select(
        _known("region", "unknown").alias("region"), _known("category", "uncategorized").alias("category"),
        _known("source_platform", "unknown").alias("platform"))
    cols = [F.col("region"), F.col("category"), F.col("platform")]
    sets = [["region"], ["category"], ["platform"], ["region", "category"]]
    out = live.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g"))
    level = case_of(F.col("_g"), {3: "region", 5: "category", 6: "platform", 1: "region_category"})
    return out.select(level.alias("level"), *[F.coalesce(c, F.lit("")).alias(c_name) for c, c_name in
                                              zip(cols, ["region", "category", "platform"])], "n")


def brand_detection_audit(products: DataFrame) -> DataFrame:
    live = products.filter("is_active").select(
        _known("region", "unknown").alias("region"), _known("category", "uncategorized").alias("category"),
        flag(F.coalesce("brand", F.lit("")) != "").alias("b"))
    out = live.groupingSets([[F.col("region")], [F.col("category")]], F.col("region"), F.col("category")).agg(
        F.count("*").alias("total"), F.sum("b").alias("branded"))
    return out.select(F.coalesce("region", F.lit("")).alias("region"), F.coalesce("category", F.lit("")).alias("category"),
                      "total", "branded", (F.col("total") - F.col("branded")).alias("unbranded"),
                      ratio(F.col("branded"), F.col("total"), 4).alias("rate"))


def unmatched_brand_frequency(daily: DataFrame, as_of: str, days: int = 30, n: int = 50) -> DataFrame:
    """Most frequent unmatched names of the last days; ``names`` is a JSON array text or an array."""
    recent = daily.filter(F.col("run_date") >= F.date_sub(F.lit(as_of[:10]).cast("date"), days))
    names = F.col("names")
    if dict(recent.dtypes)["names"] == "string":
        names = F.from_json(names, "array<string>")
    words = recent.select(F.explode(names).alias("name")).filter(F.length("name") >= 3)
    return words.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(n)


def _price(col: str) -> Column:
    return F.coalesce(F.col(col).cast("double"), F.lit(0.0))


def suspicious_checks() -> dict[str, Column]:
    sale, original, discount = _price("sale_price"), _price("original_price"), _price("discount_percent")
    name = F.coalesce(F.col("name"), F.lit(""))
    return {
        "sale_gt_original": (sale > 0) & (original > 0) & (sale > original),
        "zero_weight": F.col("weight_value") == 0,
        "extreme_discount_high": discount > 80,
        "extreme_discount_low": (original > 0) & (discount > 0) & (discount < 5),
        "missing_category": F.coalesce("category", F.lit("")) == "",
        "missing_name": F.length(name) < 3,
        "very_low_price": (sale > 0) & (sale < 1),
        "very_high_price": sale > 200,
    }


def suspicious_data(products: DataFrame) -> DataFrame:
    """One row per check with the number of active listings that fail it."""
    checks = suspicious_checks()
    sums = products.filter("is_active").agg(*[count_if(c).alias(n) for n, c in checks.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in checks)
    return sums.selectExpr(f"stack({len(checks)}, {pairs}) AS (check_name, n)")


def suspicious_examples(products: DataFrame, per_check: int = 3) -> DataFrame:
    """Up to three listings for the two checks that show examples."""
    checks = suspicious_checks()
    live = products.filter("is_active")
    parts = [live.filter(checks[n]).select(F.lit(n).alias("check_name"), "id", F.substring("name", 1, 40).alias("name"))
             for n in ("extreme_discount_low", "very_high_price", "sale_gt_original", "extreme_discount_high")]
    return top_per_group(reduce(DataFrame.unionByName, parts), ["check_name"], ["id"], per_check)


def cap_reject_trend(daily_metrics: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Newest metrics row per region within the last days."""
    recent = daily_metrics.filter(F.col("run_date") >= F.date_sub(F.lit(as_of[:10]).cast("date"), days))
    fields = ["run_date", "price_cap_reject_count", "price_cap_reject_rate", "brand_detection_rate", "total_products"]
    newest = recent.groupBy("region").agg(F.max_by(F.struct(*fields), "run_date").alias("r"))
    return newest.select("region", *[F.col(f"r.{f}").alias(f) for f in fields])


def health_class(deals: Column, edibles: Column, prerolls: Column) -> Column:
    return (F.when(deals == 0, "down").when((deals < 50) | (edibles < 5) | (prerolls < 3), "degraded").otherwise("healthy"))


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                         (F.col("n_rows") > 0).alias("has_data")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def health_status(scored: DataFrame) -> DataFrame:
    live = F.col("is_active") & (F.col("deal_score") > 0)
    s = scored.agg(count_if(live).alias("deals"), count_if(live & (F.col("category") == "edible")).alias("edibles"),
                   count_if(live & (F.col("category") == "preroll")).alias("prerolls"))
    return s.withColumn("status", health_class(F.col("deals"), F.col("edibles"), F.col("prerolls")))


def day_over_day_by_store(scored: DataFrame, as_of: str) -> DataFrame:
    """Listings and offers yesterday and today per store, with platform subtotals and the total (rollup)."""
    d0 = F.lit(as_of[:10]).cast("date")
    d = F.to_date("scraped_at")
    deal = F.col("deal_score") > 0
    out = scored.filter(d.between(F.date_sub(d0, 1), d0)).rollup("source_platform", "dispensary_id").agg(
        count_if(d < d0).alias("products_yesterday"), count_if((d < d0) & deal).alias("deals_yesterday"),
        count_if(d == d0).alias("products_today"), count_if((d == d0) & deal).alias("deals_today"))
    return out.select(F.coalesce("source_platform", F.lit("(all)")).alias("platform"),
                      F.coalesce("dispensary_id", F.lit("(all)")).alias("store"),
                      "products_yesterday", "deals_yesterday", "products_today", "deals_today")


def top_names(rows: DataFrame, keys: list[str], name: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent names per key, as an array ``top_names``, ties by name. Names are counted with map-side sums, and each
    task passes on its first ``n`` of a key only, so a key with most of the rows costs no more than others."""
    counts = rows.groupBy(*keys, name).agg(F.count("*").alias("_c"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_c"), name))
    best = counts.withColumn("_p", place).filter(F.col("_p") <= n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", name))), lambda x: x[name]).alias("top_names"))


def daily_metrics(top_deals: DataFrame, judged: DataFrame, unmatched: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Quality metrics per (run_date, region): ``top_deals`` are the selected offers, ``judged`` all listings.

    The middle score comes from a score histogram (at most 101 values per group) and is cut to a whole number. With ``unmatched``
    (run_date, region, name: a row a listing without brand) the 20 most frequent names are added, with ``runs`` (run_date, region,
    sites_scraped, sites_failed, runtime_seconds: a row a run) the sums of the runs; both are empty where a day has none.
    """
    keys = ["run_date", "region"]
    cat = lambda c: count_if(F.col("category") == c).alias(f"{c}_count")
    score = F.col("deal_score")
    # four reports read the offers: their steps are not repeated for each
    top_deals = cut_lineage(top_deals.select(*keys, "category", "brand", "dispensary_id", "deal_score"))
    deals = top_deals.groupBy(*keys).agg(
        F.count("*").alias("qualifying_deals"), *[cat(c) for c in ("flower", "vape", "edible", "concentrate", "preroll")],
        F.sum(score).alias("_sum"), F.min(score).alias("min_deal_score"), F.max(score).alias("max_deal_score"),
        count_if(score >= 85).alias("steal_count"), count_if((score >= 70) & (score < 85)).alias("fire_count"),
        count_if((score >= 50) & (score < 70)).alias("solid_count"))
    hist = histogram(top_deals, keys, score.cast("long"))
    n = F.col("n")
    mid = hist.groupBy(*keys).agg(at_index(F.floor((n - 1) / 2)).alias("_lo"), at_index(F.floor(n / 2)).alias("_hi")).select(
        *keys, F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long").alias("median_deal_score"))
    brands = top_deals.filter(F.coalesce("brand", F.lit("")) != "").select(*keys, "brand").distinct().groupBy(*keys).agg(
        F.count("*").alias("unique_brands"))
    stores = top_deals.select(*keys, "dispensary_id").distinct().groupBy(*keys).agg(F.count("*").alias("unique_dispensaries"))
    totals = judged.groupBy(*keys).agg(
        F.count("*").alias("total_products"), count_if(F.coalesce("brand", F.lit("")) == "").alias("brand_null_count"),
        count_if(~F.col("passed") & F.col("cap_failed")).alias("price_cap_reject_count"))
    out = totals.join(deals, keys, "left").join(mid, keys, "left").join(brands, keys, "left").join(stores, keys, "left")
    counts = [c for c in out.columns if c not in keys and c != "_sum"]
    out = out.na.fill(0, [*counts, "_sum"])
    extra = []
    if unmatched is not None:
        out = out.join(top_names(unmatched, keys, "name"), keys, "left")
        extra.append(F.coalesce("top_names", F.array().cast("array<string>")).alias("top_unmatched_brands"))
    if runs is not None:
        sums = ["sites_scraped", "sites_failed", "runtime_seconds"]
        out = out.join(runs.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), keys, "left")
        extra += [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums]
    total = F.col("total_products")
    return out.select(
        *keys, *[F.col(c).cast("long").alias(c) for c in counts], *extra,
        F.coalesce(ratio_even(F.col("_sum"), F.col("qualifying_deals"), 2), F.lit(0.0)).alias("avg_deal_score"),
        ratio_even(total - F.col("brand_null_count"), total, 1, 100).alias("brand_detection_rate"),
        ratio_even(F.col("price_cap_reject_count"), total, 1, 100).alias("price_cap_reject_rate"))


def brand_leaderboard(deals: DataFrame, n: int = 15) -> DataFrame:
    named = deals.withColumn("brand", F.when(F.coalesce("brand", F.lit("")) == "", "Unknown").otherwise(F.col("brand")))
    pairs = named.groupBy("brand", "dispensary_id").agg(F.count("*").alias("c"))
    return pairs.groupBy("brand").agg(F.sum("c").alias("n_deals"), F.count("*").alias("n_stores")).orderBy(
        F.col("n_deals").desc(), "brand").limit(n)


def category_distribution(deals: DataFrame) -> DataFrame:
    """Selected offers per selection bucket against its target and minimum, also for empty buckets."""
    spark = deals.sparkSession
    goals = spark.createDataFrame([(b, t, L.CATEGORY_MINIMUMS[b]) for b, t in L.CATEGORY_TARGETS.items()],
                                  "bucket string, target long, minimum long")
    counted = deals.groupBy(selection_bucket().alias("bucket")).agg(F.count("*").alias("actual"))
    out = goals.join(counted, "bucket", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("under_minimum", F.col("actual") < F.col("minimum"))


def subtype_breakdown(products: DataFrame) -> DataFrame:
    """Active vapes per brand and subtype, brands as rows."""
    vapes = products.filter(F.col("is_active") & (F.col("category") == "vape"))
    return vapes.withColumn("_s", F.coalesce("product_subtype", F.lit("unclassified"))).groupBy(
        F.coalesce("brand", F.lit("Unknown")).alias("brand")).pivot(
        "_s", ["disposable", "cartridge", "pod", "unclassified"]).agg(F.count(F.lit(1))).na.fill(0)


VAPE_WORDS = r"(?i)\b(?:disposable|all[- ]?in[- ]?one|aio|cart|cartridge|pod|vape|pen)\b"


def miscategorised_vapes(products: DataFrame) -> DataFrame:
    """Active listings outside the vape category whose name says vape."""
    return products.filter(F.col("is_active") & (F.col("category") != "vape") & F.col("name").rlike(VAPE_WORDS))


def browse_brands(deals: DataFrame) -> DataFrame:
    """Offers per brand with the index letter."""
    named = deals.filter(F.coalesce("brand", F.lit("")) != "")
    return named.groupBy("brand").agg(F.count("*").alias("n_deals")).withColumn("letter", F.upper(F.substring("brand", 1, 1)))


def browse_stores(stores: DataFrame, deals: DataFrame) -> DataFrame:
    """Active stores with their offer count and list position per region (with offers first, most first, then name)."""
    counted = deals.groupBy("dispensary_id").agg(F.count("*").alias("n_deals"))
    shown = stores.filter(F.col("is_active") & not_blocked(F.col("id")))
    out = shown.join(counted, shown["id"] == counted["dispensary_id"], "left").select(
        "id", "name", "region", F.coalesce("n_deals", F.lit(0)).alias("n_deals"))
    order = [F.col("n_deals").desc(), "name", "id"]
    return out.withColumn("position", F.row_number().over(Window.partitionBy("region").orderBy(*order)).cast("long")).withColumn(
        "letter", F.upper(F.substring("name", 1, 1)))


def not_blocked(store: Column) -> Column:
    """Stores whose id starts with a listed prefix are hidden."""
    return reduce(lambda a, b: a & b, [~store.startswith(p) for p in L.BLOCKED_STORE_PREFIXES])


def category_page_stats(deals: DataFrame) -> DataFrame:
    pairs = deals.groupBy("category", "dispensary_id").agg(
        F.count("*").alias("c"), F.min("sale_price").alias("lo"), F.max("sale_price").alias("hi"))
    return pairs.groupBy("category").agg(F.sum("c").alias("n_deals"), F.count("*").alias("n_stores"),
                                         F.min("lo").alias("min_price"), F.max("hi").alias("max_price"))


def category_top_brands(deals: DataFrame, n: int = 8) -> DataFrame:
    named = deals.filter((F.coalesce("brand", F.lit("")) != "") & (F.col("brand") != "Unknown"))
    counts = named.groupBy("category", "brand").agg(F.count("*").alias("n_deals"))
    return top_per_group(counts, ["category"], ["n_deals desc", "brand"], n)


def quality_by_category(products: DataFrame, max_price: float | None = None) -> DataFrame:
    live = products.filter("is_active")
    if max_price is not None:
        live = live.filter(F.col("sale_price") < max_price)
    s = live.groupBy("category").agg(F.count("*").alias("n"), F.sum(cents(F.col("sale_price"))).alias("_c"),
                                     F.min("sale_price").alias("min_price"), F.max("sale_price").alias("max_price"))
    return s.select("category", "n", (ratio(F.col("_c"), F.col("n"), 0) / 100).alias("avg_price"), "min_price", "max_price")


def quality_top_brands(products: DataFrame, n: int = 30) -> DataFrame:
    live = products.filter(F.col("is_active") & (F.coalesce("brand", F.lit("")) != ""))
    return live.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "brand").limit(n)


def quality_shares(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Share of listings with a brand, of stores with coordinates, and mean listings per store."""
    per_store = products.filter("is_active").groupBy("dispensary_id").agg(
        F.count("*").alias("c"), count_if(F.coalesce("brand", F.lit("")) != "").alias("b"))
    p = per_store.agg(F.sum("c").alias("total_active"), F.sum("b").alias("has_brand"), F.count("*").alias("n_stores")).na.fill(0)
    g = stores.filter("is_active").agg(F.count("*").alias("total_stores"), count_if(F.col("latitude").isNotNull()).alias("has_coordinates"))
    both = p.withColumn("_k", F.lit(1)).join(g.withColumn("_k", F.lit(1)), "_k")
    return both.select("total_active", "has_brand", ratio(F.col("has_brand"), F.col("total_active"), 1, 100).alias("brand_pct"),
                       "total_stores", "has_coordinates", ratio(F.col("has_coordinates"), F.col("total_stores"), 1, 100).alias("geo_pct"),
                       ratio(F.col("total_active"), F.col("n_stores"), 1).alias("avg_per_store"))


def score_histogram(scored: DataFrame) -> DataFrame:
    s = F.col("deal_score")
    tier = (F.when(s >= 85, "steal (85+)").when(s >= 70, "fire (70-84)").when(s >= 50, "solid (50-69)")
            .when(s > 0, "qualifying (1-49)").otherwise("not_curated (0)"))
    return scored.filter("is_active").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def store_group_stats(products: DataFrame, stores: DataFrame, predicate: Column) -> DataFrame:
    """Count, mean, lowest and highest price per store of a group given by a predicate on the store columns."""
    group = stores.filter(predicate).select(F.col("id").alias("_sid"), F.col("name").alias("store"), "address")
    joined = products.filter("is_active").join(group, F.col("dispensary_id") == F.col("_sid"))
    s = joined.groupBy("store", "address").agg(F.count("*").alias("n"), F.sum(cents(F.col("sale_price"))).alias("_c"),
                                               F.min("sale_price").alias("cheapest"), F.max("sale_price").alias("dearest"))
    return s.select("store", "address", "n", (ratio(F.col("_c"), F.col("n"), 0) / 100).alias("avg_price"), "cheapest", "dearest")


def zero_deal_reason(total: Column, passed: Column, kept: Column) -> Column:
    return (F.when(total == 0, "0 products scraped")
            .when(passed == 0, F.concat(F.lit("all "), total.cast("string"), F.lit(" failed hard filters (price/discount/brand)")))
            .when(kept == 0, F.concat(passed.cast("string"), F.lit(" passed filters but all failed quality gate")))
            .otherwise(F.concat(kept.cast("string"), F.lit(" scored but all cut during selection/dedup"))))


def site_funnel_report(staged: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per store: listings, passed, kept after the gates, selected, forced, cap rejects and the best cut offer.

    ``staged`` has one row per listing with the stage flags of the daily job (0/1).
    """
    best = F.when((F.col("is_kept") == 1) & (F.col("is_selected") == 0), F.struct(F.col("deal_score"), F.col("name")))
    s = staged.groupBy(*group_cols).agg(
        F.count("*").alias("total"), F.sum("is_passed").alias("passed"), F.sum("is_kept").alias("kept"),
        F.sum("is_selected").alias("selected"), F.sum("is_guaranteed").alias("guaranteed"),
        F.sum("is_cap_reject").alias("cap_rejects"), F.max(best).alias("_best"))
    reason = F.when(F.col("selected") == 0, zero_deal_reason(F.col("total"), F.col("passed"), F.col("kept"))).otherwise("")
    return s.select(*group_cols, "total", "passed", "kept", "selected", "guaranteed", "cap_rejects",
                    F.coalesce("_best.deal_score", F.lit(0)).cast("long").alias("best_cut_score"),
                    F.coalesce("_best.name", F.lit("")).alias("best_cut_name"), reason.alias("zero_reason"))


def constraint_violations(products: DataFrame, stores: DataFrame, runs: DataFrame, reports: DataFrame, saves: DataFrame,
                          product_ids: DataFrame) -> DataFrame:
    """Every value rule and reference as one row (rule, n_bad); each table is scanned once."""
    def bad(col: str, ok: Column) -> Column:
        return count_if(F.col(col).isNotNull() & ~ok)

    def scan(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        sums = df.agg(*[c.alias(n) for n, c in rules.items()])
        return sums.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{n}', {n}" for n in rules) + ") AS (rule, n_bad)")

    def orphans(df: DataFrame, col: str, target: DataFrame, rule: str) -> DataFrame:
        keys = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_key")).agg(F.count("*").alias("c"))
        lost = keys.join(target.select(F.col("id").alias("_id")), F.col("_key") == F.col("_id"), "left_anti")
        return lost.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")

    def between(col: str) -> Column:
        return F.col(col).between(0, 100)

    parts = [
        scan(products, {
            "products_category": bad("category", F.col("category").isin(L.CATEGORIES)),
            "products_deal_score": bad("deal_score", between("deal_score")),
            "products_sale_price": bad("sale_price", F.col("sale_price") > 0),
            "products_original_price": bad("original_price", F.col("original_price") > 0),
            "products_discount_percent": bad("discount_percent", between("discount_percent")),
            "products_weight_unit": bad("weight_unit", F.col("weight_unit").isin(L.WEIGHT_UNITS)),
            "products_subtype": bad("product_subtype", F.col("product_subtype").isin(L.SUBTYPES)),
            "products_strain_type": bad("strain_type", F.col("strain_type").isin(L.STRAINS)),
            "products_name_length": bad("name", F.length(F.trim("name")) >= 3),
        }),
        scan(stores, {"stores_platform": bad("platform", F.col("platform").isin(L.PLATFORMS)),
                      "stores_region": bad("region", F.col("region").isin(L.REGIONS))}),
        scan(runs, {"runs_status": bad("status", F.col("status").isin(L.RUN_STATUSES)),
                    "runs_platform_group": bad("platform_group", F.col("platform_group").isin("all", "stable", "new", "test"))}),
        scan(reports, {"reports_type": bad("report_type", F.col("report_type").isin(L.REPORT_TYPES))}),
        orphans(products, "dispensary_id", stores, "fk_products_store"),
        orphans(reports, "deal_id", product_ids, "fk_reports_product"),
        orphans(saves, "deal_id", product_ids, "fk_saves_product"),
    ]
    return reduce(DataFrame.unionByName, parts)


def contact_stats(contacts: DataFrame) -> DataFrame:
    source = lambda v: count_if(F.col("source") == v)
    return contacts.agg(
        F.count("*").alias("total"), count_if(F.coalesce("phone", F.lit("")) != "").alias("phones"),
        count_if(F.coalesce("email", F.lit("")) != "").alias("emails"), source("saved_deals_banner").alias("by_saved_deals"),
        source("out_of_market").alias("by_out_of_market"), source("early_bird_banner").alias("by_early_bird"))


def freshness(products: DataFrame, as_of: str, stale_hours: int = 14) -> DataFrame:
    """Newest scrape per region and whether it is from before today or older than 14 hours."""
    now = F.lit(as_of).cast("timestamp_ntz")
    s = products.groupBy("region").agg(F.max("scraped_at").alias("latest"))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("latest").cast("timestamp"))
    return s.select("region", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"),
                    (F.to_date("latest") != F.to_date(now)).alias("not_today"), (age > stale_hours * 3600).alias("is_stale"))


def savings_totals(saved: DataFrame) -> DataFrame:
    """Per user: what the saved offers would save, from prices where the original is higher."""
    gain = F.when(F.col("original_price") > F.col("sale_price"), cents(F.col("original_price")) - cents(F.col("sale_price"))).otherwise(0)
    live = F.when(F.col("is_active"), gain).otherwise(0)
    return saved.groupBy("user_id").agg((F.sum(live) / 100).alias("potential"), (F.sum(gain) / 100).alias("lifetime"),
                                        F.count("*").alias("n_saved"))


def js_discount(original: Column, sale: Column) -> Column:
    """Whole percent off, 0 without a higher original price."""
    higher = F.coalesce(original > sale, F.lit(False))
    return F.when(higher, F.floor((original - sale) / original * 100 + 0.5)).otherwise(0).cast("long")


def price_tier(price: Column) -> Column:
    return F.when(price < 20, "budget").when(price <= 75, "mid").otherwise("premium")
