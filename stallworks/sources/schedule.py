"""Schedule files and the two state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallworks import rules
from stallworks.functions import dates as D

SHOWS = (
    "id bigint, name string, event_date date, place string, source_url string, run_offset_days int, "
    "run_at timestamp_ntz, status string, approval_required boolean, approved_at timestamp_ntz, "
    "latest_export_path string, company_count int, failure_count int, last_error string, "
    "notification_status string, clay_status string, heyreach_status string, smartlead_status string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
RUNS = (
    "id bigint, show_id bigint, status string, output_path string, company_count int, failure_count int, "
    "error_message string, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz"
)
REQUIRED = ["show", "date", "place", "link"]


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a schedule file: show, date, place, link and their position.

    Header names are matched without case and outer spaces; of several headers
    for one field the last counts.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("encoding", "UTF-8").csv(path)
    )
    chosen: dict[str, str] = {}
    for name in raw.columns:
        field = rules.HEADER_ALIASES.get(name.strip("﻿ \t").lower())
        if field:
            chosen[field] = name
    missing = [field for field in REQUIRED if field not in chosen]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    fields = [F.trim(F.coalesce(F.col(f"`{chosen[f]}`"), F.lit(""))).alias(f) for f in REQUIRED]
    return raw.select(*fields, F.monotonically_increasing_id().alias("row_no"))


def complete_rows(schedule: DataFrame) -> DataFrame:
    return schedule.filter("show <> '' AND date <> '' AND place <> '' AND link <> ''")


def skipped_rows(schedule: DataFrame) -> DataFrame:
    return schedule.filter("show = '' OR date = '' OR place = '' OR link = ''")


def parsed_schedule(schedule: DataFrame, today: str, run_offset_days: int = rules.RUN_OFFSET_DAYS) -> DataFrame:
    """Complete rows with event date and trigger time; event_date is NULL for unknown date forms."""
    today_col = F.to_date(F.lit(today))
    rows = complete_rows(schedule).withColumn("event_date", D.parse_show_date("date", today_col))
    return rows.withColumn("run_offset_days", F.lit(run_offset_days)).withColumn(
        "run_at", D.run_at("event_date", F.col("run_offset_days"))
    )


def read_shows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHOWS).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def listed_shows(shows: DataFrame) -> DataFrame:
    """By event date, the newest entry of a day first."""
    return shows.orderBy(F.asc("event_date"), F.desc("created_at"))


def write_state(df: DataFrame, path: str) -> None:
    """Write one new snapshot; snapshots are never changed in place."""
    df.write.mode("overwrite").parquet(path)
