"""Typed readers. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "dispensaries": "id string, name string, url string, platform string, city string, state string, is_active boolean, config map<string,string>, "
                    "region string, latitude decimal(10,7), longitude decimal(10,7)",
    "products": "id string, dispensary_id string, name string, brand string, category string, original_price decimal(10,2), sale_price decimal(10,2), "
                "discount_percent decimal(5,1), weight_value double, weight_unit string, thc_percent decimal(5,2), cbd_percent decimal(5,2), raw_text string, "
                "product_url string, is_active boolean, deal_score int, product_subtype string, strain_type string, is_infused boolean, scraped_at timestamp, "
                "created_at timestamp",
    "deals": "id string, product_id string, dispensary_id string, deal_score decimal(5,1), is_posted boolean, posted_at timestamp, created_at timestamp",
    "scrape_runs": "id string, started_at timestamp, completed_at timestamp, status string, total_products long, qualifying_deals long, "
                   "sites_scraped array<string>, sites_failed array<struct<slug:string,error:string>>, runtime_seconds long, region string, platform_group string",
    "price_history": "product_id string, observed_date date, dispensary_id string, sale_price decimal(10,2), original_price decimal(10,2), "
                     "discount_percent decimal(5,1), name string, brand string, category string, weight_value double, weight_unit string, deal_score int",
    "deal_history": "product_id string, dispensary_id string, deal_score int, sale_price decimal(10,2), original_price decimal(10,2), "
                    "discount_percent decimal(5,1), name string, brand string, category string, first_seen timestamp, last_seen timestamp, is_active boolean, times_seen long",
    "daily_metrics": "run_date date, region string, total_products long, qualifying_deals long, brand_detection_rate double, price_cap_reject_count long, "
                     "price_cap_reject_rate double, top_unmatched_brands array<string>",
    "enrichment_snapshots": "snapshot_date date, snapshot_type string, region string, category string, weight_tier string, brand string, sample_size long, "
                            "p25 decimal(8,2), p50 decimal(8,2), p75 decimal(8,2), p_min decimal(8,2), p_max decimal(8,2)",
    "ml_price_caps": "region string, category string, weight_tier string, recommended_cap double, p25 double, p30 double, p50 double, p75 double, "
                     "sample_size long, hardcoded_cap double, cap_delta_pct double, is_active boolean",
    "brand_candidates": "name string, canonical_name string, observation_count long, state_count long, regions_seen array<string>, samples array<string>, "
                        "closest_existing_brand string, similarity_score decimal(4,3), status string",
    "analytics_events": "id long, anon_id string, event_name string, properties map<string,string>, created_at timestamp",
    "user_events": "id long, user_id string, event_type string, deal_id string, metadata map<string,string>, created_at timestamp",
    "user_sessions": "user_id string, zip_code string, first_seen timestamp, last_seen timestamp, acquisition_source string, acquisition_medium string, "
                     "acquisition_campaign string",
    "user_saved_deals": "user_id string, deal_id string, saved_at timestamp",
    "user_dismissed_deals": "user_id string, deal_id string, dismissed_at timestamp",
    "deal_reports": "id string, deal_id string, anon_id string, report_type string, report_message string, deal_price decimal(10,2), dispensary_name string, "
                    "brand_name string, product_name string, reviewed boolean, report_date date, created_at timestamp",
    "shared_saves": "id string, anon_id string, deal_ids array<string>, created_at timestamp, expires_at timestamp, view_count long",
    "user_contacts": "id string, phone string, email string, source string, saved_deals_count int, zip_entered string, created_at timestamp",
}
RAW_LISTING = ("name string, raw_text string, price string, product_url string, scraped_brand string, scraped_category string, source_platform string, "
               "dispensary_id string, _corrupt_record string")


def read_table(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name])
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def read_raw_listings(spark: SparkSession, path: str) -> DataFrame:
    """Scraped cards as JSON lines; a broken line keeps its text in ``_corrupt_record``."""
    return spark.read.schema(RAW_LISTING).option("mode", "PERMISSIVE").json(path)


def parse_raw_listings(lines: DataFrame, text: str = "value") -> DataFrame:
    """The same for cards that arrive as text rows."""
    return lines.select(F.from_json(text, RAW_LISTING, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
