"""Export of company tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallworks.functions import text as T

COLUMNS = ["company_name", "website_url", "Location", "Conference"]


def conference_file_stem(conference: Column | str) -> Column:
    return F.coalesce(F.nullif(T.slug(conference, "_", 80), F.lit("")), F.lit("conference_directory"))


def show_file_stem(name: Column | str, date: Column | str) -> Column:
    stem = F.coalesce(F.nullif(T.slug(name, "-", None), F.lit("")), F.lit("show"))
    return F.concat(stem, F.lit("_"), F.date_format(date, "yyyy-MM-dd"))


def write_export(rows: DataFrame, path: str, stem: str = "show") -> None:
    """One folder of CSV files per show, rows in directory order.

    Range partitioning on (show, order) keeps the order across the files of a
    show and splits a giant show over many tasks.
    """
    (
        rows.repartitionByRange(F.col(stem), F.col("sort_index"))
        .sortWithinPartitions(stem, "sort_index")
        .select(stem, *COLUMNS)
        .write.mode("overwrite")
        .partitionBy(stem)
        .option("header", True)
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def write_lead_export(leads: DataFrame, path: str) -> None:
    """CSV folders of the shows that the leads name, replacing what these shows had; other shows' files are not touched."""
    columns = [c for c in leads.columns if c != "show_id"]
    (
        leads.repartitionByRange(F.col("show_id"), F.lower(F.trim("email")))
        .sortWithinPartitions("show_id", F.lower(F.trim("email")))
        .select("show_id", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("show_id")
        .option("header", True)
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export read back; columns without a name are dropped, missing values are ''."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    named = [c for c in rows.columns if c.strip() and not c.startswith("_c")]
    return rows.select(*named).na.fill("")
