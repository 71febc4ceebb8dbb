"""Guarantees of the selection in a large region, and the order of the shop window."""

import pyarrow as pa
from pyspark.sql import functions as F

from leafmart.operators import curation, ranking, selection

SCHEMA = ("id string, dispensary_id string, name string, brand string, category string, product_subtype string, weight_value double, deal_score int, "
          "sale_price double, original_price double, discount_percent double, region string")


def offers(store, n, category="flower", weight=3.5, score=90, brands=30, subtype=None):
    return [(f"{store}-{category}-{weight}-{i:04d}", store, f"{store} {category} {weight} {i}", f"{store[:3]} brand {i % brands}", category, subtype, weight, score, 10.0 + i / 100, 30.0 + i, 60.0, "r") for i in range(n)]


def test_anchor_ounce_and_disposable_show_beside_many_better_offers(spark):
    rows = offers("oasis", 90, score=90) + offers("oasis", 1, weight=28.0, score=11) + offers("oasis", 80, "vape", 1.0, 88) + offers("oasis", 1, "vape", 0.5, 12, subtype="disposable")
    for k in range(12):
        rows += offers(f"s{k}-shop", 60, score=95) + offers(f"s{k}-shop", 40, "edible", 100.0, 94)
    got = selection.select_top_deals(spark.createDataFrame(rows, SCHEMA), ["region"]).cache()
    chosen = {r["id"]: r["display_rank"] for r in got.collect()}
    assert "oasis-flower-28.0-0000" in chosen and "oasis-vape-0.5-0000" in chosen
    assert len(chosen) <= 300 and sorted(chosen.values()) == list(range(1, len(chosen) + 1))
    per_store = {r["dispensary_id"]: r["n"] for r in got.groupBy("dispensary_id").agg(F.count("*").alias("n")).collect()}
    assert set(per_store) == {"oasis", *[f"s{k}-shop" for k in range(12)]} and max(per_store.values()) <= 24 + 4


def test_ninth_brand_gives_a_store_its_minimum(spark):
    """Eight brands are used up elsewhere; a store whose best 64 offers are of those still shows its ninth."""
    used = [(f"big{j}-{b}-{i:03d}", f"big{j}-x", f"big{j} {b} {i}", f"used {b}", c, None, 3.5, 95, 10.0 + i + j / 10, 99.0, 60.0, "r")
            for j in range(6) for b in range(8) for i, c in enumerate(["flower", "vape", "edible", "concentrate", "preroll"])]
    small = [(f"small-{b}-{i:02d}", "small-x", f"small {b} {i}", f"used {b}", "flower", None, 3.5, 80, 50.0 + i, 99.0, 60.0, "r") for b in range(8) for i in range(9)]
    small += [("small-own", "small-x", "small own", "own brand", "flower", None, 3.5, 20, 77.0, 99.0, 60.0, "r")]
    got = {r["id"] for r in selection.select_top_deals(spark.createDataFrame(used + small, SCHEMA), ["region"]).collect()}
    assert any(i.startswith("small-") for i in got)


def cards(n):
    rows = [(f"c{i:03d}", f"shop{i % 5}-a", f"name {i}", f"brand {i % 4}", ["flower", "vape", "edible", "concentrate", "preroll"][i % 3 + (i % 7 == 0)], None, 3.5, 99 - i, 10.0 + i, 30.0, 60.0, "r") for i in range(n)]
    return rows


def test_shop_window_orders(spark):
    feed = spark.createDataFrame(cards(60), SCHEMA).withColumn("weight_unit", F.lit("g"))
    spaced = [r["id"] for r in curation.spaced_feed(feed, ["region"]).orderBy("position").collect()]
    mixed = [r["id"] for r in curation.tier_shuffle(feed, ["region"], "day:").orderBy("position").collect()]
    assert sorted(spaced) == sorted(mixed) == [f"c{i:03d}" for i in range(60)]
    brand = {r[0]: r[3] for r in cards(60)}
    together = lambda ids: sum(brand[a] == brand[b] for a, b in zip(ids, ids[1:], strict=False))
    assert together(spaced) < 10 and together(mixed[7:]) < 10  # of 59, with four brands
    assert mixed == [r["id"] for r in curation.tier_shuffle(feed.repartition(5), ["region"], "day:").orderBy("position").collect()]
    assert mixed != [r["id"] for r in curation.tier_shuffle(feed, ["region"], "other:").orderBy("position").collect()]


def test_spacing_of_four_cards(spark):
    """a a b c: the second a moves behind, as that repairs the brand at its place."""
    rows = [("1", "s1", "n", "a", "flower", None, 3.5, 90, 1.0, 2.0, 50.0, "r"), ("2", "s2", "n", "a", "vape", None, 1.0, 80, 1.0, 2.0, 50.0, "r"),
            ("3", "s3", "n", "b", "preroll", None, 1.0, 70, 1.0, 2.0, 50.0, "r"), ("4", "s4", "n", "c", "edible", None, 100.0, 60, 1.0, 2.0, 50.0, "r"),
            ("5", "s5", "n", "d", "concentrate", None, 1.0, 50, 1.0, 2.0, 50.0, "r")]
    out = [r["id"] for r in curation.spaced_feed(spark.createDataFrame(rows, SCHEMA), ["region"]).orderBy("position").collect()]
    assert out[0] == "1" and out.index("2") == 4


def test_choice_counts_what_is_taken_instead_of_looking_through_it():
    """20,000 offers of one bucket, brand cap met early: each offer costs a few look-ups in each of the three steps."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    n = 20_000
    items = {"bucket": Counted([0] * n), "tier": Counted(["t"] * n), "maker": Counted([f"m{i % 25}" for i in range(n)]),
             "store": Counted([f"s{i % 400}" for i in range(n)]), "key": Counted([f"k{i // 2}" for i in range(n)])}
    picks = selection.fill_slots([], items, [200], 7, 4, 18)
    assert len(picks) == 100 and len({items["key"][i] for i in picks}) == 100  # 25 brands, four of a bucket each
    assert Counted.reads < 3 * 5 * n + 1_000


def test_short_lists_are_read_together_and_stay_apart(monkeypatch):
    monkeypatch.setattr(selection, "SPAN", 4)
    rows = [[{"a": i, "b": str(i)} for i in range(k)] for k in (1, 0, 9, 2, 2, 3, 0)]
    lists = pa.array([[], *rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())]))).slice(1)
    assert list(selection.groups_of(lists, ("a", "b"))) == [{"a": [x["a"] for x in r], "b": [x["b"] for x in r]} for r in rows]


def test_forced_picks_read_the_offers_twice(spark):
    """The best offer of each category is found once, although two steps use it."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        reads.add(1)
        return name

    rows = offers("oasis", 20) + offers("oasis", 10, "edible", 100.0, 80)
    known = spark.createDataFrame(rows, SCHEMA).withColumn("name", counted.asNondeterministic()("name"))
    needed = spark.createDataFrame([("oasis", 4)], "dispensary_id string, n_needed int")
    got = ranking.guaranteed_picks(known, ["dispensary_id"], needed).collect()
    assert len(got) == 4 and {r["category"] for r in got} == {"flower", "edible"} and reads.value <= 2 * len(rows)


def _day_of_offers(spark):
    rows = [(f"o{i:03d}", f"s{i % 7}", f"Green Offer {i % 23}", ["Acme", "Bolt", None][i % 3], ["flower", "vape", "edible", "other"][i % 4], 40.0 + i % 5, 20.0 + i % 9, 50.0, 3.5, None, "west", f"2024-01-0{i % 3 + 1}") for i in range(260)]
    return spark.createDataFrame(rows, "id string, dispensary_id string, name string, brand string, category string, original_price double, sale_price double, discount_percent double, weight_value double,"
                                 " product_subtype string, region string, run_date string").withColumn("source_platform", F.lit("dutchie"))


def test_flags_join_stored_picks_only(spark):
    """Forced picks are a table when all listings meet their flags: no rank is left in that plan, so no shuffle of it lies on disk."""
    plan = selection.detect_deals(_day_of_offers(spark), ["run_date", "dispensary_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_offers_of_a_store_are_dealt_once(spark):
    """After the first of each key, the limits of a store's offers share one exchange; forced picks share one after their ranks."""
    offers = _day_of_offers(spark).withColumn("deal_score", F.lit(50))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    store, region = (exchanges(selection.candidates(offers, g, 24)) for g in (["run_date", "dispensary_id"], ["run_date", "region"]))
    assert store <= region - 2
    needed = offers.select("run_date", "dispensary_id").distinct().withColumn("n_needed", F.lit(3))
    picks = ranking.guaranteed_picks(offers, ["run_date", "dispensary_id"], needed)
    assert "LeftAnti" not in picks._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in picks.groupBy("run_date", "dispensary_id").agg(F.count("*"), F.countDistinct("name", "sale_price")).collect()]
    assert len(got) == 21 and all(n == names == 3 for _, _, n, names in got)
