"""Registered queries against their checking SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["top_100_curated", "hard_filter_reasons", "price_cap_recommendations", "slot_allocation", "weekly_cohorts", "acquisition_channels",
          "run_rollup", "upsert_products", "validate_prices", "detect_brand", "session_touch", "hourly_saves"]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    verdict, _ = check.compare(entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name])
    assert verdict == "ok"


def test_curated_store_lists_keep_the_caps(spark):
    out = entry.queries()["select_top_deals"](spark, SF).toPandas()
    assert out["id"].is_unique and (out.groupby("deal_group").size() <= 24 + 3).all()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
