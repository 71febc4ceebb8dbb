"""Tables that are touched in part."""

import random

from pyspark.sql import functions as F

from leafmart.operators import feed, stored


def stamps(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = tmp_path / "t"
    schema = "k long, seq long, v string, created string"
    stored.create_table(spark.createDataFrame([(i, 0, f"old {i}", "first") for i in range(200)] + [(None, 0, "none", "first")], schema), str(path), ["k"], 8)
    before = stamps(path)
    touched = stored.upsert_buckets(str(path), spark.createDataFrame([(3, 1, "late", "x"), (3, 2, "new 3", "x"), (999, 1, "more", "x")], schema), ["k"], "seq", ["created"], 8)
    after = stamps(path)
    assert len(touched) <= 2
    for b in range(8):
        own = {f: t for f, t in before.items() if f.startswith(f"_bucket={b}/")}
        assert (own == {f: t for f, t in after.items() if f.startswith(f"_bucket={b}/")}) == (b not in touched)
    rows = {r["k"]: (r["v"], r["created"]) for r in stored.read_table(spark, str(path)).collect()}
    assert len(rows) == 202 and rows[3] == ("new 3", "first") and rows[999] == ("more", "x") and rows[None] == ("none", "first") and rows[4] == ("old 4", "first")
    assert stored.upsert_buckets(str(path), spark.createDataFrame([], schema), ["k"], "seq", buckets=8) == [] and stamps(path) == after


def test_index_gives_the_same_rows_from_fewer_blocks(spark, tmp_path):
    rng = random.Random(4)
    words = ["ring", "gear", "bolt", "lamp", "x"]
    rows = [(f"p{i}", f"{rng.choice(words)} number {i} {'Zanzibar' if i % 97 == 5 else ''}", rng.choice(["Acme", None, "Zan Co"]), "flower", None, None, True, "r", "store-1", 10.0 + i % 50, 60.0, 50.0, i % 100) for i in range(2000)]
    offers = spark.createDataFrame(rows, "id string, name string, brand string, category string, product_subtype string, strain_type string, is_active boolean, region string, dispensary_id string, sale_price double, original_price double, discount_percent double, deal_score int")
    root = str(tmp_path / "index")
    stored.build_search_index(offers, root, blocks=64, shelves=8)
    for q in ("zanzibar", "ring", "Zan", "zan co", "zz top", "x", "acme", "number 1"):
        want = [r["id"] for r in feed.search(offers, q, "r").collect()]
        assert [r["id"] for r in stored.search_index(spark, root, q, "r", shelves=8).collect()] == want
    assert stored.pruned_offers(spark, root, "zanzibar", 8).count() < 0.5 * 2000
    assert stored.pruned_offers(spark, root, "qqq", 8).count() == 0
    plan = stored.pruned_offers(spark, root, "zanzibar", 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_block" in plan.split("PartitionFilters:")[1][:80]


def test_shop_filters_reach_the_scan(spark, tmp_path):
    rows = [(f"p{i}", f"shop{i % 3}", f"Acme - ring {i} 1g", "Acme", ["vape", "weird", None, "edible"][i % 4], None, "x", 1.0, "g", 5.0 + i, 50.0, 60.0) for i in range(40)]
    schema = "id string, dispensary_id string, name string, brand string, category string, product_subtype string, dispensary_name string, weight_value double, weight_unit string, sale_price double, original_price double, discount_percent double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "p"))
    stored_rows = spark.read.parquet(str(tmp_path / "p"))
    got = feed.shop_rows(stored_rows, ["flower"], ["shop1"], max_price=30.0, query="ring")
    assert {r["id"] for r in got.collect()} == {r[0] for r in rows if r[1] == "shop1" and r[9] <= 30 and r[4] in ("weird", None)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans print the whole list
    got = feed.shop_rows(spark.read.parquet(str(tmp_path / "p")), ["flower"], ["shop1"], max_price=30.0, query="ring")
    pushed = got._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "dispensary_id" in pushed and "LessThanOrEqual(sale_price,30.0)" in pushed and "category" in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_buckets_are_written_in_turns(spark, tmp_path, monkeypatch):
    """No turn merges all buckets, and the table is that of one merge; order and values of a row are one struct in the shuffle."""
    rows = [(i % 70, f"k{i % 40}" if i % 11 else None, i, float(i % 7), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b string, id long, price double, created long")
    old, new = df.filter("id < 250"), df.filter("id >= 250")
    want = stored.upsert(stored.upsert(old.limit(0), old, ["a", "b"], "id", ["created"]), new, ["a", "b"], "id", ["created"])
    plan = want._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "min_by" not in plan
    by_hand: dict = {}
    for a, b_, i, price, created in rows:
        by_hand[a, b_] = (i, price, by_hand.get((a, b_), (0, 0, created))[2])
    last_old = {(a, b_): created for a, b_, i, _, created in reversed(rows) if i < 250}
    first_new = {(a, b_): created for a, b_, i, _, created in reversed(rows) if i >= 250}
    assert {(r["a"], r["b"]): (r["id"], r["price"], r["created"]) for r in want.collect()} == {
        k: (i, p, last_old.get(k, first_new.get(k))) for k, (i, p, _) in by_hand.items()}
    path, merged, upsert = str(tmp_path / "t"), [], stored.upsert
    stored.create_table(upsert(old.limit(0), old, ["a", "b"], "id", ["created"]), path, ["a", "b"], 8)
    monkeypatch.setattr(stored, "upsert", lambda target, *more: merged.append(target.select("_bucket").distinct().count()) or upsert(target, *more))
    touched = stored.upsert_buckets(path, new, ["a", "b"], "id", ["created"], 8)
    assert len(touched) == 8 and max(merged) == 2 and len(merged) == 4
    assert sorted(map(str, stored.read_table(spark, path).select(*want.columns).collect())) == sorted(map(str, want.collect()))
