"""Tables that several queries of one session read: written once, then reused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallworks.session import cut_lineage
from stallworks.sources import pages as P, signals as G
from workloads import sites

_TABLES: dict[tuple, DataFrame] = {}


def clear() -> None:
    """Forget all written tables (the benchmark measures each query in full)."""
    _TABLES.clear()


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = cut_lineage(build())
    return _TABLES[key]


#: rows in a part of a table that is dealt out: more rows make more parts, not larger ones
PART_ROWS = 50_000


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table over all cores, however few splits its files give: short texts compress so well that one row group holds them all."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS)))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "pages", lambda: P.read_pages(spark, f"{sf_dir}/pages.parquet"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "page_signals", lambda: G.page_signals(spread(spark, page_table(spark, sf_dir))))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "site_pages", lambda: sites.site_pages(spark, sf_dir, lambda rows: spread(spark, rows)))


def site_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "site_signals", lambda: G.page_signals(spread(spark, site_pages(spark, sf_dir))))


def derived_pages(spark: SparkSession, sf_dir: str, name: str, url_sql: str, html_sql: str) -> DataFrame:
    """One page per customer from two SQL texts."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return written(
        spark, sf_dir, name,
        lambda: spread(spark, customer.select("c_custkey", "c_mktsegment")).select(F.expr(url_sql).alias("url"), F.expr(html_sql).alias("html")),
    )


def derived_signals(spark: SparkSession, sf_dir: str, name: str, pages: DataFrame) -> DataFrame:
    return written(spark, sf_dir, f"{name}_signals", lambda: G.page_signals(spread(spark, pages)))
