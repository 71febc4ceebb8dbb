"""Invariants and brute-force checks on small fixtures."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafmart.functions import pricing
from leafmart.operators import brands, maintenance, prices, ranking
from leafmart.sources import sinks

PRODUCT = {"id": "1", "name": "Test Product 3.5g", "brand": "Connected", "category": "flower", "sale_price": 15.0, "original_price": 30.0,
           "discount_percent": 50.0, "weight_value": 3.5, "weight_unit": "g", "dispensary_id": "planet13", "product_subtype": None, "region": None,
           "source_platform": None}
SCHEMA = ("id string, name string, brand string, category string, sale_price double, original_price double, discount_percent double, weight_value double, "
          "weight_unit string, dispensary_id string, product_subtype string, region string, source_platform string")


def rows(spark, *changes):
    return spark.createDataFrame([{**PRODUCT, "id": str(i), **c} for i, c in enumerate(changes)], SCHEMA)


def test_filter_and_score_of_default_product(spark):
    r = pricing.scored(rows(spark, {})).first()
    assert r.passed and r.deal_score == 35 + 6 + 20 + 12 + 8 + 12 + 5


def test_first_failing_reason(spark):
    df = pricing.hard_filters(rows(spark, {"sale_price": 2.0}, {"sale_price": 23.0}, {"name": "Logo Hoodie"}, {"discount_percent": 90.0},
                                   {"sale_price": 23.0, "region": "new-jersey-2"}, {"sale_price": 28.0, "source_platform": "jane", "discount_percent": None}))
    got = [r.reject_reason for r in df.orderBy("id").collect()]
    assert got == ["price_floor", "price_cap", "merchandise", "discount_high", None, None]


def test_chain_and_shard_rules(spark):
    df = spark.createDataFrame([("deep-roots-craig", "michigan-2"), ("curaleaf-strip", "ohio")], "d string, r string")
    got = df.select(pricing.chain_of(F.col("d")), pricing.strip_shard(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("deep-roots", "michigan"), ("curaleaf", "ohio")]


def test_index_percentiles_match_sorting(spark):
    rnd = random.Random(1)
    data = [("r", "flower", 3.5, round(rnd.uniform(5, 60), 2)) for _ in range(31)]
    df = spark.createDataFrame(data, "region string, category string, weight_value double, sale_price double").withColumn("is_active", F.lit(True))
    got = prices.price_distribution(df).first()
    s = sorted(d[3] for d in data)
    assert (got.p25, got.p50, got.p75, got.sample_size) == (s[31 // 4], s[15], s[93 // 4], 31)


def test_brand_cap_equals_scan(spark):
    rnd = random.Random(2)
    changes = [{"brand": rnd.choice("abc"), "category": rnd.choice(["flower", "vape"]), "id": f"{i:03d}"} for i in range(80)]
    df = rows(spark, *changes).withColumn("deal_score", F.lit(5))
    got = {r.id for r in ranking.cap_per_brand(df, 4, 6).collect()}
    seen, per, want = {}, {}, set()
    for c in changes:
        if seen.get(c["brand"], 0) < 6 and per.get((c["brand"], c["category"]), 0) < 4:
            seen[c["brand"]] = seen.get(c["brand"], 0) + 1
            per[c["brand"], c["category"]] = per.get((c["brand"], c["category"]), 0) + 1
            want.add(c["id"])
    assert got == want


def test_upsert_null_keys_are_equal(spark):
    old = spark.createDataFrame([("a", None, 1, "2020")], "k string, w double, v int, created string")
    new = spark.createDataFrame([("a", None, 2, "2021", 1), ("a", None, 3, "2022", 2), ("b", 1.0, 9, "2022", 1)], "k string, w double, v int, created string, seq int")
    got = maintenance.upsert(old.withColumn("seq", F.lit(0)), new, ["k", "w"], "seq", keep=["created"])
    assert sorted((r.k, r.v, r.created) for r in got.collect()) == [("a", 3, "2020"), ("b", 9, "2022")]


NAMES = ["cloud nine", "cloud nin", "clod nine", "green farm", "greene farm", "abcd", "abdc", "stiiizy", "stizy", "stiizy", "haze", "hazel", "raw", "rows"]


def test_similar_pairs_are_complete(spark):
    for threshold in (0.70, 0.85):
        left = spark.createDataFrame([(n,) for n in NAMES], "a string")
        right = spark.createDataFrame([(n,) for n in NAMES], "b string")
        got = {(r.a, r.b) for r in brands.similar_pairs(left, right, threshold).collect()}
        assert got == {(x, y) for x in NAMES for y in NAMES if SequenceMatcher(None, x, y).ratio() >= threshold}


def test_leader_clusters_equal_greedy(spark):
    got = {r.name: r.leader for r in brands.leader_clusters(spark.createDataFrame([(n,) for n in NAMES], "name string")).collect()}
    leaders, want = [], {}
    for n in sorted(NAMES, key=lambda x: (-len(x), x)):
        hit = next((x for x in leaders if SequenceMatcher(None, n, x).ratio() >= 0.80), None)
        want[n] = hit or n
        leaders += [] if hit else [n]
    assert got == want


def test_brand_detection(spark):
    terms = brands.dictionary(spark.createDataFrame([("Haze",), ("City Trees",), ("Airo",), ("&Shine",)], "brand string"),
                              spark.createDataFrame([("airo pro", "Airo")], "variation string, canonical string"))
    texts = spark.createDataFrame([(1, "Purple Haze 3.5g"), (2, "City Trees Garlic 1g"), (3, "the Airo Pro pod"), (4, "cart &Shine 1g"), (5, "Hazel nut")], "i int, text string")
    got = {r.i: r.brand for r in brands.detect_brands(texts, terms, ["i"]).collect()}
    assert got == {2: "City Trees", 3: "Airo", 4: "&Shine"}


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', {"k": "v"})], "id int, name string, props map<string,string>")
    sinks.write_csv_export(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == '"id","name","props"\n"1","say ""hi""","{""k"":""v""}"\n'


def test_raw_listings_keep_broken_lines(spark, tmp_path):
    from leafmart.sources.tables import read_raw_listings

    (tmp_path / "cards.json").write_text('{"name": "Blue Maui", "price": "$20"}\n{broken\n')
    got = sorted((r.name or "", r["_corrupt_record"] or "") for r in read_raw_listings(spark, str(tmp_path / "cards.json")).collect())
    assert got == [("", "{broken"), ("Blue Maui", "")]


def test_six_part_brand_slug(spark):
    from leafmart.operators import brands

    terms = brands.dictionary(spark.createDataFrame([("One Two Three Four Five Six",), ("One Two",)], "brand string"))
    cards = spark.createDataFrame([(1, "https://x.org/s/product/one-two-three-four-five-six-gummies"), (2, "https://x.org/s/product/one-two-gummies")], "id long, product_url string")
    got = {r["id"]: r["brand"] for r in brands.brands_from_url(cards, terms, "id").collect()}
    assert got == {1: "One Two Three Four Five Six", 2: "One Two"}


@pytest.mark.parametrize("many", [300, 400, 4000])
def test_small_store_keeps_its_minimum_beside_a_big_one(spark, many):
    from leafmart.operators import selection

    def rows(store, n):
        return [(f"{store}-{i:05d}", store, f"{store} item {i}", "brand a" if store == "big" else "brand b", "flower", None, 3.5, 90 - (store == "small") * 40, 10.0 + i / 100, 30.0 + i, 60.0, "r") for i in range(n)]

    schema = "id string, dispensary_id string, name string, brand string, category string, product_subtype string, weight_value double, deal_score int, sale_price double, original_price double, discount_percent double, region string"
    got = selection.select_top_deals(spark.createDataFrame(rows("big", many) + rows("small", 3), schema), ["region"]).groupBy("dispensary_id").count().collect()
    assert {r["dispensary_id"] for r in got} == {"big", "small"}
