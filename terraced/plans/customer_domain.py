"""Customer domain: inbound views -> normalised tables -> dimensions and star fact -> ACCESS."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.functions.columns import instant, surrogate_key
from terraced.schemas import HIGH_VALUE, published


def inbound(grain: DataFrame) -> DataFrame:
    """A domain sees exactly what the producer publishes."""
    return grain.select("*")


def customers_3nf(entity_grain: DataFrame) -> DataFrame:
    return entity_grain.drop("cleaned_at")


def regions_3nf(region_grain: DataFrame) -> DataFrame:
    return region_grain.select("*")


def segments_3nf(segment_grain: DataFrame) -> DataFrame:
    return segment_grain.select("*")


def taxes_3nf(taxes_grain: DataFrame) -> DataFrame:
    return taxes_grain.drop("loaded_at", "cleaned_at")


def dim_regions(regions: DataFrame) -> DataFrame:
    return regions.drop("latest_cleaned_at").withColumn("region_sk", surrogate_key(F.col("region")))


def dim_segments(segments: DataFrame) -> DataFrame:
    return segments.drop("latest_cleaned_at").withColumn("segment_sk", surrogate_key(F.col("segment")))


def fct_customer_value_star(
    customers: DataFrame, regions: DataFrame, segments: DataFrame, as_of: datetime
) -> DataFrame:
    """Customers with the keys of their region and segment.

    No join is hinted. The dimensions are stored tables, so the planner knows
    their size and broadcasts them while they are small.
    """
    return (
        customers.join(regions.select("region", "region_sk"), "region", "left")
        .join(segments.select("segment", "segment_sk"), "segment", "left")
        .select(*customers.columns, "region_sk", "segment_sk", instant(as_of).alias("modeled_at"))
    )


def customers_complete(fact: DataFrame) -> DataFrame:
    lead = ["customer_id", "customer_name", "region", "segment", "region_sk", "segment_sk"]
    return fact.select(*lead, *[c for c in fact.columns if c not in lead])


def customers_high_value(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("customer_value_band") == HIGH_VALUE).select(*published("customers_high_value"))


def customers_only(fact: DataFrame) -> DataFrame:
    return fact.select(*published("customers_only"))


def taxes_only(taxes: DataFrame) -> DataFrame:
    return taxes.select(*published("taxes_only"))
