"""Brand detection both ways, similar names against all pairs, candidates over several runs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmart.operators import brands as b


def names(rng, n, letters="abcdegilnorst"):
    out = set()
    while len(out) < n:
        base = "".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 10, 12, 14])))
        out.add(base)
        for _ in range(2):  # relatives
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)]])
            if len(w) > 1:
                out.add("".join(w))
    return sorted(out)[:n]


@pytest.mark.parametrize("threshold", [0.70, 0.85])
def test_similar_pairs_are_all_found(spark, threshold):
    rng = random.Random(int(threshold * 100))
    pool = names(rng, 320)
    left, right = rng.sample(pool, 220), rng.sample(pool, 160)
    frames = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r["a"], r["b"]): r["ratio"] for r in b.similar_pairs(*frames, threshold).collect()}
    want = {(x, y): r for x in left for y in right if (r := SequenceMatcher(None, x, y).ratio()) >= threshold}
    assert got == want and len(want) > 50


def test_candidates_are_few(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(7, 13))) for _ in range(1600)})
    frame = spark.createDataFrame([(w,) for w in words], "a string")
    near = b.candidate_pairs(frame, frame.withColumnRenamed("a", "b"), 0.85).count()
    assert len(words) <= near < 0.02 * len(words) ** 2  # each name meets itself


TERMS = [("STIIIZY",), ("Kiva",), ("Kiva Lost Farm",), ("&Shine",), ("Haze",), ("Raw Garden",), ("Dr. Zodiak",), ("AMA",)]


def terms(spark, **more):
    return b.dictionary(spark.createDataFrame(TERMS, "brand string"), spark.createDataFrame([("alternative medical association", "AMA"), ("kiva confections", "Kiva")], "variation string, canonical string"),
                        spark.createDataFrame([("Raw Garden", "RG")], "name string, canonical string"), **more)


def test_trie_and_join_agree(spark):
    rng = random.Random(2)
    words = ["stiiizy", "Kiva", "lost", "farm", "Kiva Lost Farm", "&Shine", "x&shine", "hazel", "HAZE", "purple haze", "raw garden", "strawberry", "Dr. Zodiak", "dr. zodiaks", "ama", "alternative medical association", "-", "|", "none", "1g", "kiva confections"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(300)] + [(900, None), (901, ""), (902, "none Kiva"), (903, "Purple Haze"), (904, "&shine bar")]
    texts, known = spark.createDataFrame(rows, "id long, text string"), terms(spark)
    one = sorted(map(tuple, b.detect_brands(texts, known, ["id"]).collect()))
    two = sorted(map(tuple, b._by_join(texts, known, ["id"], "text", b.STRAIN_BLOCKERS).collect()))
    assert one == two and len(one) > 200
    found = {i: n for i, n, _ in one}
    assert 903 not in found and 902 not in found and found[904] == "&Shine"


def test_similar_head_is_the_last_resort(spark):
    rows = [(1, "Stiizy - pod 1g"), (2, "Rw Garden | live resin"), (3, "Unknown - Kiva bar"), (4, "Totally Other"), (5, "none Stiizy"), (6, None)]
    got = {r["id"]: (r["brand"], r["score"]) for r in b.detect_brands(spark.createDataFrame(rows, "id long, text string"), terms(spark), ["id"], similar=True).collect()}
    assert got == {1: ("STIIIZY", 0), 2: ("RG", 0), 3: ("Kiva", 4)}


def test_texts_are_read_once_for_similar_heads(spark):
    """Known names, similar heads and the names to compare come from one pass over the texts."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    texts = spark.createDataFrame([(i, f"Stiizy - pod {i}") for i in range(40)] + [(90, "Kiva bar")], "id long, text string").withColumn("text", counted.asNondeterministic()("text"))
    got = b.detect_brands(texts, terms(spark), ["id"], similar=True).collect()
    assert len(got) == 41 and reads.value == 41


def test_approved_candidates_become_brands(spark):
    candidates = spark.createDataFrame([("Green Hum", "approved", None), ("green hum", "approved", ""), ("kiva", "approved", None), ("Blue Hum", "pending", None), ("Rd Hum", "approved", "Red Hum")], "name string, status string, canonical_name string")
    known = terms(spark, candidates=candidates)
    assert {r["canonical"] for r in known.filter("is_variation = 0").collect()} == {t for t, in TERMS} | {"Green Hum", "Red Hum"}
    texts = spark.createDataFrame([(1, "GREEN HUM flower"), (2, "Blue Hum flower")], "id long, text string")
    assert [(r["id"], r["brand"]) for r in b.detect_brands(texts, known, ["id"]).collect()] == [(1, "Green Hum")]


def test_learning_again_changes_nothing(spark):
    rng = random.Random(9)
    shop = ["Mellow Fields", "Mellow Feilds", "Mello Fields", "Quartz Lab", "Quartz Labs", "Oddity", "Kiva", "Sunny Daze"]
    daily = spark.createDataFrame([(f"r{i % 3}", f"2024-01-{i % 28 + 1:02d}", [rng.choice(shop) for _ in range(6)]) for i in range(60)], "region string, run_date string, names array<string>").withColumn("run_date", F.to_date("run_date"))
    known = spark.createDataFrame([("Kiva",)], "brand string")
    empty = spark.createDataFrame([], "name string, status string")
    learned = b.learn_brands(daily, known, empty, "2024-01-30", 30, 10)
    first = spark.createDataFrame(learned.collect(), learned.schema)
    assert {r["name"] for r in first.collect()} == {"Mellow Feilds", "Oddity", "Quartz", "Sunny Daze"}
    judged = first.withColumn("status", F.when(F.col("name") == "Oddity", "rejected").otherwise(F.col("status")))
    again = b.learn_brands(daily, known, judged, "2024-01-30", 30, 10)
    key = lambda df: sorted((r["name"], r["observation_count"], r["state_count"], r["status"]) for r in df.collect())
    assert key(again) == key(judged)
    more = daily.unionByName(spark.createDataFrame([("r9", ["Mellow Fieldsss"] * 12)], "region string, names array<string>").withColumn("run_date", F.to_date(F.lit("2024-01-29"))))
    third = {r["name"]: r["observation_count"] for r in b.learn_brands(more, known, judged, "2024-01-30", 30, 10).collect()}
    assert "Mellow Fieldsss" not in third and third["Mellow Feilds"] == {r["name"]: r["observation_count"] for r in judged.collect()}["Mellow Feilds"] + 12


def test_brand_of_a_listing_in_the_row_and_by_join(spark, monkeypatch):
    rows = [("1", "Kiva", "", "x", "x"), ("2", "", "raw garden cart", "raw garden cart", "raw garden cart 1g"), ("3", None, None, "purple haze", "purple haze by STIIIZY"),
            ("4", "none Kiva", "/product/kiva-bar-10", "bar", None), ("5", "", "", "", "")]
    cards = spark.createDataFrame(rows, "id string, scraped_brand string, product_url string, name string, card string").withColumn("raw_text", F.col("card"))
    known = terms(spark).localCheckpoint()
    one = b.resolve_brand(cards, known)
    assert "_src" not in one._jdf.queryExecution().toString()  # no row a text, no join back
    found = {r["id"]: r["brand"] for r in one.collect()}
    monkeypatch.setattr(b, "TRIE_TERMS", 0)
    assert found == {r["id"]: r["brand"] for r in b.resolve_brand(cards, known).collect()}
    assert found["1"] == "Kiva" and found["2"] == "RG" and found["3"] == "STIIIZY" and found["5"] is None


def test_ratio_of_many_pairs_is_that_of_the_matcher():
    """Equal runs, repeated letters, empty and long names (the matcher leaves out frequent letters of long ones)."""
    random.seed(11)
    word = lambda: "".join(random.choice("abé \U0001F33F") for _ in range(random.randint(0, 13)))
    left, right = [word() for _ in range(3000)] + ["ab" * 60, "abc" * 90], [word() for _ in range(3000)] + ["ba" * 80, "cab" * 90]
    assert list(b.ratios(pd.Series(left), pd.Series(right))) == [SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)]


def test_short_names_meet_by_what_is_left_of_them(spark):
    """4,000 names of few syllables share pairs of characters with hundreds of others; only those within the ratio are candidates."""
    random.seed(5)
    names = sorted({"".join(random.choice(["en", "st", "th", "er", "tion", "ch", "ou"]) for _ in range(4)) for _ in range(4000)})
    frame = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = b.candidate_pairs(frame, frame.withColumnRenamed("a", "b"), 0.80)
    got = pairs.count()
    good = b.similar_pairs(frame, frame.withColumnRenamed("a", "b"), 0.80).count()
    assert good <= got <= 2 * good


def test_chain_of_similar_names_alternates(spark):
    """A name that resembles only one that does not lead is a leader again, and a name alone leads itself."""
    names = ["abcdefghij", "abcdefghi", "abcdefgh", "abcdefg", "abcdef", "abcde", "zzzz"]
    got = {r["name"]: r["leader"] for r in b.leader_clusters(spark.createDataFrame([(n,) for n in names], "name string"), 0.94).collect()}
    assert got == {"abcdefghij": "abcdefghij", "abcdefghi": "abcdefghij", "abcdefgh": "abcdefgh", "abcdefg": "abcdefg", "abcdef": "abcdef", "abcde": "abcde", "zzzz": "zzzz"}


def test_names_meet_leaders_not_all_names(spark, monkeypatch):
    """Bands give the clusters of a greedy pass over all names, and far fewer names meet than in one comparison of all."""
    rng = random.Random(21)
    pool = names(rng, 420) + ["Abİcdef", "ABICDEF", "abcdeg", "Abcdeg"]
    want, leaders = {}, []
    for name in sorted(set(pool), key=lambda x: (-len(x), x.encode())):
        want[name] = next((x for x in leaders if SequenceMatcher(None, name.lower(), x.lower()).ratio() >= 0.80), name)
        leaders += [name] * (want[name] == name)
    met, similar = [], b.similar_pairs

    def counted(left, right, *more, **named):
        met.append(left.count() * right.count())
        return similar(left, right, *more, **named)

    monkeypatch.setattr(b, "similar_pairs", counted)
    monkeypatch.setattr(b, "BAND", 60, raising=False)
    monkeypatch.setattr(b, "SETTLED_AT_ONCE", 20, raising=False)
    got = {r["name"]: r["leader"] for r in b.leader_clusters(spark.createDataFrame([(x,) for x in pool], "name string"), 0.80).collect()}
    assert got == want and len(leaders) < 0.8 * len(want)
    assert len(met) > 8 and sum(met) < 0.6 * len(want) ** 2


def test_address_and_label_lines_are_read_in_the_row(spark, monkeypatch):
    """Odd addresses and cards give the same brand in the row, where nothing is joined, and by joins."""
    rng = random.Random(33)
    bits = ["/product/", "/products/", "/brands/", "kiva", "Kiva-Lost-Farm", "raw-garden", "stiiizy", "-", "/", "?", "brand=", "&", "kiva-bar-10", "&shine", "dr.-zodiak", " ", "\n", "\r", "shop", " "]
    lines = ["Kiva", " kiva. ", "STIIIZY", "Raw Garden", "|ama|", "kiva confections", "Kiva bar", "", "Haze:", "x" * 31]
    rows = [(str(i), rng.choice(["", "", None, "Kiva", "Haze"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) if i % 9 else None,
             "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 5))) if i % 7 else None, rng.choice(["x", "stiiizy pod", None]), rng.choice(["", "by ama", None])) for i in range(500)]
    cards = spark.createDataFrame(rows, "id string, scraped_brand string, product_url string, raw_text string, name string, card string")
    known = terms(spark).localCheckpoint()
    in_row = b.resolve_brand(cards, known)
    plan = in_row._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    one = {r["id"]: r["brand"] for r in in_row.collect()}
    monkeypatch.setattr(b, "TRIE_TERMS", 0)
    two = {r["id"]: r["brand"] for r in b.resolve_brand(cards, known).collect()}
    assert one == two and len({x for x in one.values() if x}) >= 6


def test_stored_names_are_not_compared_again(spark, monkeypatch):
    """A name that is a stored leader keeps itself without a comparison; only the others meet the leaders."""
    met, similar = [], b.similar_pairs

    def counted(left, right, *more, **named):
        met.append(sorted(r[0] for r in left.collect()))
        return similar(left, right, *more, **named)

    monkeypatch.setattr(b, "similar_pairs", counted)
    stored = spark.createDataFrame([("Mellow Fields",), ("Quartz",), ("Mellow Fieldss",)], "name string")
    seen = spark.createDataFrame([("Mellow Fields",), ("Quartz",), ("Mellow Feilds",), ("Oddity",)], "name string")
    got = {r["name"]: r["leader"] for r in b.clusters_with(seen, stored, 0.80).collect()}
    assert got == {"Mellow Fields": "Mellow Fields", "Quartz": "Quartz", "Mellow Feilds": "Mellow Fieldss", "Oddity": "Oddity"}
    assert met[0] == ["mellow feilds", "oddity"]
