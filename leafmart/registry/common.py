"""Helpers shared by the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmart import bridge
from leafmart.functions import pricing

TIERS = bridge.BRIDGE_BRAND_TIERS
EVENTS_AS_OF = bridge.EVENTS_AS_OF
PRODUCTS_AS_OF = bridge.PRODUCTS_AS_OF


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bridge.view(spark, sf_dir, name)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "products")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.scored(products(spark, sf_dir), tiers=TIERS)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("*", *pricing.quality_flags())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "analytics_events")


def day_text(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def as_long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})
