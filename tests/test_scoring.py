"""Scores are computed once for a query, and the search for words finds what a plain search finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmart import lookups as L
from leafmart import registry
from leafmart.functions import pricing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["top_cut", "best_cut_per_store", "curated_exclusion", "daily_metrics", "top_100_curated"])
def test_scores_are_not_repeated_by_each_step(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" not in plan and "rlike" not in plan.lower()


def test_words_are_found_as_by_a_plain_search():
    rnd = random.Random(5)
    parts = [*L.MERCH_WORDS, *(w[:-1] for w in L.MERCH_WORDS), "x", " ", "-", "gift", "\u212a", "ä"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 3))) for _ in range(3000)]
    found = re.compile(pricing.MERCH_PATTERN)
    assert [bool(found.search(t)) for t in texts] == [any(w in t for w in L.MERCH_WORDS) for t in texts]


def test_names_that_repeat_or_promise(spark):
    names = ["Badder Badder", "badder\tBADDER", "ab ab ab", "ab abc", "abc ab", "a  a\n", "12345 12345", "Buy 2 get 1 gummies", "BOGO gummies", "4 for $40 mints", "2/$40 mints",
             "Mix & Match pack", "bundle of joy", "Amix and match", "sunbuy 2 get", "plain mints", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", F.lit("b").alias("brand"), F.lit(1.0).alias("weight_value"), F.lit("flower").alias("category"), F.lit("x").alias("product_subtype"))
    for r in df.select("name", *pricing.quality_flags()).collect():
        bare = (r.name or "").lower().strip(" ")
        words = re.split(r"\s+", bare)
        relaxed = len(bare) >= 5 and not (len(words) == 2 and words[0] == words[1])
        assert r.relaxed_ok == relaxed, r.name
        assert r.strict_ok == (relaxed and not re.search("(?i)" + L.PROMO_NAME_PATTERN, r.name or "")), r.name


def test_stored_steps_of_the_selection_hold_what_is_read(spark):
    plan = registry.queries()["detect_deals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "dispensary_name" not in plan and "strain_type" not in plan and "l_partkey" not in plan


@pytest.mark.parametrize(("name", "step", "at"), [("upsert_by_bucket", "upsert_buckets", 1), ("search_by_index", "search_index", 4)])
def test_stored_offers_are_not_scored_again(spark, monkeypatch, name, step, at):
    from leafmart.operators import stored

    plans, whole = [], getattr(stored, step)

    def watched(*args):
        plans.append(args[at]._jdf.queryExecution().optimizedPlan().toString())
        return whole(*args)

    monkeypatch.setattr(stored, step, watched)
    registry.queries()[name](spark, SF)
    assert plans and "p_brand" not in plans[0]  # a column of the tables below the offers
