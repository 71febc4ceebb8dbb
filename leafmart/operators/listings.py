"""From scraped cards to typed listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmart.functions import text as t
from leafmart.operators.brands import name_head, resolve_brand
from leafmart.operators.ranking import top_n, top_per_group


def with_prices(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds original_price, sale_price, discount_percent and strategy from the documented parser."""
    df = df.withColumn("_raw", t.extract_prices(F.col(text)))
    df = df.withColumn("_price", t.validate_prices(F.col("_raw")))
    return df.select(*[c for c in df.columns if not c.startswith("_")], "_price.*")


def with_weight(df: DataFrame, text: str = "text") -> DataFrame:
    df = df.withColumn("_weight", t.extract_weight(F.col(text)))
    return df.select(*[c for c in df.columns if not c.startswith("_")], "_weight.*")


def with_cannabinoids(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({f"{n.lower()}_percent": t.cannabinoid(F.col(text), n) for n in ("THC", "CBD")})


def resolve_category(df: DataFrame, card: str, name: str, scraped: str, target: str) -> DataFrame:
    """Category from the card text, overruled by the shop's own label, with concentrate and page-text corrections."""
    s = F.coalesce(F.col(scraped), F.lit(""))
    df = t.with_category(t.with_category(df, card, "_k0"), name, "_kn")
    use_label = (s != "") & (s != F.col("_k0")) & (F.col("_k0").isin("other", "skip") | (s != "other"))
    df = df.withColumn("_k1", F.when(use_label, s).otherwise(F.col("_k0")))
    concentrate = r"(?i)\b(?:badder|batter|budder|shatter|wax|sauce|sugar|crumble|rosin|diamonds?|live\s+resin|cured\s+resin)\b"
    vape = r"(?i)\b(?:cart|cartridge|pod|disposable|vape|pen|all-in-one)\b"
    check = F.when(F.coalesce(F.col(card), F.lit("")) != "", F.col(card)).otherwise(F.col(name))
    is_vape = F.col("_k1") == "vape"
    out = (F.when(is_vape & check.rlike(concentrate) & ~check.rlike(vape), "concentrate")
           .when(is_vape & ~F.col(name).rlike(vape) & ~F.col("_kn").isin("other", "vape"), F.col("_kn")).otherwise(F.col("_k1")))
    return df.withColumn(target, out).drop("_k0", "_k1", "_kn")


def _number(col: str) -> Column:
    return t.number(F.col(col), r"([0-9.]+)")


def parse_listings(raw: DataFrame, terms: DataFrame) -> DataFrame:
    """Typed listings: clean name, brand, category, prices, weight, strain, subtype and display name.

    ``raw`` has id, dispensary_id, name, raw_text, price, product_url, scraped_brand, scraped_category, source_platform.
    Refused cards fall out, as in the daily job.
    """
    df = t.with_clean_name(raw, "name", "_name").withColumn("_offer_free", t.strip_offer_text(F.col("raw_text")))
    df = df.withColumn("card", F.concat_ws(" ", "_name", "_offer_free"))
    df = df.drop("name").withColumnRenamed("_name", "name")
    df = resolve_brand(df, terms)
    df = resolve_category(df, "card", "name", "scraped_category", "category0")
    df = df.withColumn("_text", F.concat_ws(" ", "name", "_offer_free", "price"))
    df = t.keep_rows(t.with_live_parse(df, "_text", "p_"), ~F.col("p_refused"))
    weight = _number("p_weight")
    unit = F.regexp_extract("p_weight", r"(mg|g)$", 1)
    df = df.withColumn("_w", weight).withColumn("_u", F.when(unit != "", unit))
    cat = F.when((F.col("category0") == "other") & F.col("_w").isin(3.5, 7.0, 14.0, 28.0), "flower").otherwise(F.col("category0"))
    df = df.withColumn("_c1", cat)
    single = (F.col("_c1") == "flower") & (F.col("_u") == "g") & (F.col("_w") == 1.0) & ~F.col("name").rlike(r"(?i)\b(?:flower|bud)\b")
    df = df.withColumn("_c2", F.when(F.coalesce(single, F.lit(False)), "preroll").otherwise(F.col("_c1")))
    df = df.withColumn("_c3", F.when(F.col("_c2") == "other", F.col("p_category")).otherwise(F.col("_c2")))
    to_gram = (F.col("_u") == "mg") & F.col("_c3").isin("vape", "concentrate")
    df = df.withColumn("weight_value", F.when(to_gram, F.round(F.col("_w") / 1000, 3)).otherwise(F.col("_w")))
    df = df.withColumn("weight_unit", F.when(to_gram, "g").otherwise(F.col("_u")))
    df = t.with_display_name(df, "name", "brand", "_c3", "raw_text", "display")
    df = df.withColumn("_cls", t.classify_product(F.col("display"), F.col("brand"), F.col("_c3"), F.col("weight_value")))
    df = df.withColumn("category", F.coalesce("_cls.corrected_category", "_c3"))
    fallback = t.subtype_from_raw(F.concat_ws(" ", "name", "raw_text"))
    subtype = F.when((F.col("category") == "vape") & F.col("_cls.product_subtype").isNull(), fallback).otherwise(F.col("_cls.product_subtype"))
    return df.select(
        "id", "dispensary_id", F.col("display").alias("name"), "brand", "category", F.col("p_original_price").alias("original_price"),
        F.col("p_deal_price").alias("sale_price"), F.col("p_discount_percent").alias("discount_percent"), "weight_value", "weight_unit",
        F.col("p_thc_percent").alias("thc_percent"), F.col("p_strain_type").alias("strain_type"), F.col("_cls.is_infused").alias("is_infused"),
        subtype.alias("product_subtype"), "source_platform", "raw_text", F.col("name").alias("clean_name"),
        *[c for c in ("run_date", "region") if c in raw.columns])


def price_strategy_coverage(raw: DataFrame, text: str = "price") -> DataFrame:
    """How many cards each price wording explains."""
    return with_prices(raw.select(text), text).groupBy("strategy").agg(F.count("*").alias("n"))


def unmatched_candidates(parsed: DataFrame, per_store: int = 10, per_run: int = 20) -> DataFrame:
    """Most frequent name heads without a brand: ten per store vote, twenty per run are kept."""
    heads = parsed.filter(F.coalesce("brand", F.lit("")) == "").select(
        "dispensary_id", F.substring(name_head(F.col("clean_name")), 1, 50).alias("name")).filter(F.length("name") > 2)
    counts = heads.groupBy("dispensary_id", "name").agg(F.count("*").alias("n"))
    top = top_per_group(counts, ["dispensary_id"], ["n desc", "name"], per_store)
    return top_n(top.groupBy("name").agg(F.count("*").alias("n_stores")), ["n_stores desc", "name"], per_run)


def with_default_platform(raw: DataFrame, stores: DataFrame) -> DataFrame:
    """Fills a missing source platform from the store."""
    dim = stores.select(F.col("id").alias("dispensary_id"), F.col("platform").alias("_p"))
    out = raw.join(dim, "dispensary_id", "left")
    return out.withColumn("source_platform", F.coalesce("source_platform", "_p")).drop("_p")


# ---------------------------------------------------------------------------
# Rows of the shop window
# ---------------------------------------------------------------------------

def weight_from_name(name: Column) -> Column:
    """Weight text in a product name: milligrams, grams, ounces, then fractions; empty without one."""
    mg = F.regexp_extract(name, r"(?i)([0-9]+)\s*mg\b", 1)
    g = F.regexp_extract(name, r"(?:^|[\s(\[-])([0-9]*\.?[0-9]+)\s*[gG]\b", 1).try_cast("double")
    oz = F.regexp_extract(name, r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*oz\b", 1)
    fraction = t.pick(F.regexp_extract(name, r"\b(1/8|1/4|1/2)\b", 1), {"1/8": "3.5g", "1/4": "7g", "1/2": "14g"})
    return (F.when(mg != "", F.concat(mg, F.lit("mg"))).when(g > 0, t.weight_text(g)).when(oz != "", F.concat(oz, F.lit("oz")))
            .otherwise(F.coalesce(fraction, F.lit(""))))


def number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def normalize_deal(df: DataFrame) -> DataFrame:
    """Shop window row: default category, brand from the name, weight text repaired by category, slug of the brand."""
    df = df.withColumn("_nw", weight_from_name(F.col("name")))
    own = F.when(F.coalesce("weight_value", F.lit(0.0)) != 0, F.concat(number_text(F.col("weight_value")), F.coalesce("weight_unit", F.lit("g")))).otherwise("")
    df = df.withColumn("_w0", own)
    name_value = t.number(F.col("_nw"), r"^([0-9.]+)")
    shifted = (F.col("category") == "flower") & (F.col("weight_value") < 1) & (F.abs(F.col("weight_value") * 10 - name_value) < 0.01)
    df = df.withColumn("_w1", F.when((F.col("_nw") != "") & ((F.col("_w0") == "") | shifted), F.col("_nw")).otherwise(F.col("_w0")))
    df = t.with_correct_weight(df.withColumn("_lc", F.lower(F.coalesce("category", F.lit("")))), "_w1", "_lc")
    df = df.withColumn("_v", F.round("value", 2))
    weight = F.when(F.col("was_corrected"), F.concat(number_text(F.col("_v")), F.col("unit"))).otherwise(F.col("_w1"))
    from_name = F.regexp_extract("name", r"^([A-Za-z][A-Za-z0-9'.& ]{1,20}?)\s*[-–—]", 1)
    brand = F.when((F.coalesce("brand", F.lit("")) != "") & (F.col("brand") != "Unknown"), F.col("brand")).when(from_name != "", F.trim(from_name)).otherwise("Unknown")
    valid = F.col("category").isin("flower", "preroll", "vape", "edible", "concentrate")
    out = df.withColumns({"weight": weight, "brand_name": brand, "category": F.when(valid, F.col("category")).otherwise("flower")}).withColumn(
        "brand_id", F.regexp_replace(F.lower("brand_name"), r"\s+", "-"))
    out = out.drop("_nw", "_w0", "_w1", "_lc", "_v", "value", "unit", "is_valid", "was_corrected")
    # filters on the weight text must not be rewritten into the steps above
    return t.keep_rows(out, F.lit(True))


def unit_price(price: Column, weight: Column, category: Column) -> Column:
    """Text like $4.28/g, or $1.50/10mg for edibles; NULL without a usable weight."""
    g, mg = t.number(weight, r"([0-9]+\.?[0-9]*)\s*g\b"), t.number(weight, r"([0-9]+)\s*mg\b")
    money = lambda x: F.concat(F.lit("$"), F.format_string("%.2f", F.round(x.cast("decimal(30,10)"), 2).cast("double")))
    return (F.when((price > 0) & (g > 0) & category.isin("flower", "vape", "concentrate", "preroll"), F.concat(money(price / g), F.lit("/g")))
            .when((price > 0) & (mg > 0) & (category == "edible"), F.concat(money(price / mg * 10), F.lit("/10mg"))))
