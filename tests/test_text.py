"""Golden rows for the text jobs."""

from pyspark.sql import functions as F

from leafmart.functions import text as t
from leafmart.operators import listings as ls


def _prices(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    return [(r.original_price, r.sale_price, r.discount_percent) for r in ls.with_prices(df).orderBy("i").collect()]


def test_prices(spark):
    got = _prices(spark, ["was $50.00 now $35.00", "$25", "2/$55 $35", "Premium Cart $35 2/$60", "was $15 now $7 off", "BOGO $40", "$30 $8.00 off"])
    assert got == [(50.0, 35.0, 30.0), (None, 25.0, None), (55.0, 35.0, 36.4), (35.0, 30.0, 14.3), (15.0, 8.0, 46.7), (40.0, 20.0, 50.0), (30.0, 22.0, 26.7)]


def test_weights(spark):
    df = spark.createDataFrame([(0, "Blue Dream 3.5g"), (1, "Premium Eighth"), (2, "Rove 1/8oz"), (3, "Iced Tea 8oz 100mg"), (4, "Vape cart 5.0g"), (5, "1oz")],
                               "i int, text string")
    got = [(r.weight_value, r.weight_unit) for r in ls.with_weight(df).orderBy("i").collect()]
    assert got == [(3.5, "g"), (3.5, "g"), (3.5, "g"), (100.0, "mg"), (0.5, "g"), (28.0, "g")]


def test_categories(spark):
    cases = {
        "Gary Peyton Live Resin 1.0g": "concentrate", "Skywalker OG Cart 0.5g": "vape", "Gary Payton 3.5g": "flower", "Dogwalkers Indica 1g": "preroll",
        "Camino Gummies 100mg": "edible", "Disposable Vape 0.35g": "vape", "RSO Syringe 1g": "skip", "Drink Loud Pink Lemonade 100mg": "edible",
        "Diamond Infused Preroll 1g": "preroll", "City Budder 1g": "concentrate",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string").withColumn("got", t.detect_category(F.col("text")))
    assert [(r.text, r.got) for r in df.filter("got <> want").collect()] == []


def test_weight_in_context(spark):
    cases = [(".35g", "flower", "3.5g"), ("0.35g", "vape", "0.35g"), ("1g", "preroll", "1g"), ("2g", "preroll", None), ("95mg", "edible", "100mg"),
             ("10mg", "edible", None), ("7g", "flower", "7g")]
    df = spark.createDataFrame(cases, "w string, c string, want string").withColumn("got", t.validate_weight(F.col("w"), F.col("c")))
    assert df.filter("NOT (got <=> want)").count() == 0


def test_clean_name_drops_repeats(spark):
    df = spark.createDataFrame([("Casino Kush Casino Kush Preroll",), ("Blue Maui Black Label Add to cart",), ("",)], "name string")
    got = [r.clean for r in t.with_clean_name(df, "name", "clean").collect()]
    assert got == ["Casino Kush Preroll", "Blue Maui", "Unknown"]


def test_subtypes(spark):
    cases = [("Cloudy All-In-One 0.5g", "", "concentrate", None, "disposable", "vape"), ("Infused Tahoe OG", "", "preroll", None, "infused_preroll", None),
             ("Hash Rosin 1g", "", "concentrate", None, "hash_rosin", None), ("Gummies 10pk", "", "edible", None, "gummy", None),
             ("Casino Kush", "", "flower", 1.0, None, "preroll"), ("Green steam", "", "edible", None, None, None)]
    df = spark.createDataFrame(cases, "n string, b string, c string, w double, sub string, cat string")
    df = df.withColumn("r", t.classify_product(F.col("n"), F.col("b"), F.col("c"), F.col("w")))
    bad = df.filter("NOT (r.product_subtype <=> sub) OR NOT (r.corrected_category <=> cat)").collect()
    assert bad == []


def test_shared_steps_of_a_card_are_computed_once(spark):
    """Infusion and pack are looked for once a name; a card is cut at the same places as by the whole pattern, and squeezed the same."""
    names = spark.createDataFrame([("Infused 2pk", "", "flower", 1.0)], "n string, b string, c string, w double")
    plan = names.select(t.classify_product(F.col("n"), F.col("b"), F.col("c"), F.col("w")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("caviar") <= 1 and plan.count("multi[- ]?pack") <= 1
    cards = ["Kush\nSpecial Offers\n(1) 2/$40 other", "a  b\t\tc\n d \x0b", "Any two for 3", "3 for $20", "$5 1/8 oz\nget any", "many\nalso included: x", "Deal : 4", "xoffer shop", "offer shop now\nkeep", "", "ſelect $5 bundle"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cards)], "i int, x string")
    same = df.filter((t.strip_offer_text(F.col("x")) == F.trim(F.regexp_replace("x", t.OFFER_PATTERN, ""))) & (t.squeeze(F.col("x")) == F.trim(F.regexp_replace("x", r"\s+", " "))))
    assert same.count() == len(cards)
