"""Sinks: quoted CSV exports and refreshable parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*fields: Column) -> Column:
    """One CSV line with every field quoted and inner quotes doubled; NULL becomes an empty field."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    return F.concat_ws(",", *quoted)


def write_csv_export(df: DataFrame, path: str) -> None:
    """Header, every field quoted, struct and map columns as JSON. Writes one file per partition."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array") else
            F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def materialize(df: DataFrame, path: str, view: str | None = None) -> DataFrame:
    """Refresh a derived table: write it whole, read it back and publish it under ``view``."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if view:
        out.createOrReplaceTempView(view)
    return out


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (daily tables stay idempotent on a re-run)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def next_version(df: DataFrame, root: str, version: int) -> str:
    """Write a new version folder of a table without touching the older ones, as plain parquet has no MERGE."""
    path = f"{root}/v={version:010d}"
    df.write.mode("overwrite").parquet(path)
    return path
