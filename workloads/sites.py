"""Exhibitor sites written by Spark from the customer table.

One site per nation and block of 2500 customer keys, one directory page per 500
keys, one profile page per customer; so sites, pages and companies grow with
the table.  Every third customer is on one site, which so holds a third of all.  Sites take turns in how they paginate: a stated page total, a page
parameter, or numbered paths that link to each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIRST = ["Amber", "Boreal", "Cedar", "Delta", "Ember", "Falcon", "Granite", "Harbor", "Indigo", "Juniper", "Keystone",
         "Lumen", "Marble", "Nimbus", "Orchid", "Prairie"]
SECOND = ["Works", "Foods", "Textiles", "Robotics", "Lighting", "Optics", "Paper", "Glass", "Motors", "Ceramics",
          "Tools", "Plastics", "Fabrics", "Organics", "Metals", "Audio"]
CITIES = [("Las Vegas", "NV"), ("Austin", "TX"), ("Orlando", "FL"), ("Chicago", "IL"), ("Atlanta", "GA"), ("Denver", "CO"),
          ("Toronto", "Ontario")]
BLOCK, PAGE_KEYS = 2500, 500


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as exhibitors: site, page, name, profile address, website on the profile."""
    k = F.col("c_custkey")
    first, second = _pick(FIRST, k), _pick(SECOND, F.floor(k / len(FIRST)))
    domain = F.concat(F.lit("https://www."), F.lower(first), F.lower(second), F.lit(".com/"))
    hot = k % 3 == 0
    nation = F.when(hot, 0).otherwise(F.col("c_nationkey"))
    site = F.concat(nation.cast("string"), F.lit("-"), F.when(hot, "hot").otherwise(F.floor(k / BLOCK).cast("string")))
    mode = (nation % 3).cast("int")
    host = F.concat(F.lit("https://expo-"), F.col("site"), F.lit(".example.com"))
    base = F.concat(host, F.lit("/exhibitors"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("key"), nation.alias("c_nationkey"), "c_mktsegment", site.alias("site"), mode.alias("mode"),
        (F.floor(F.when(hot, k).otherwise(k % BLOCK) / PAGE_KEYS) + 1).alias("page_no"),
        F.concat_ws(" ", first, second, F.initcap("c_mktsegment")).alias("name"),
        F.when(k % 5 == 0, F.lit("")).when(k % 7 == 0, F.lit("https://www.qzvx-hub.net/")).otherwise(domain).alias("website"),
    )
    return rows.select(
        "*", host.alias("host"),
        F.when(F.col("mode") == 2, F.concat(base, F.lit("/page/1"))).otherwise(base).alias("seed_url"),
        F.concat(base, F.lit("/company/"), F.col("key").cast("string")).alias("profile_url"),
    )


def _page_address(number: Column) -> Column:
    base = F.concat(F.col("host"), F.lit("/exhibitors"))
    text = number.cast("string")
    return (
        F.when(F.col("mode") == 2, F.concat(base, F.lit("/page/"), text))
        .when(number == 1, base)
        .otherwise(F.concat(base, F.lit("?page="), text))
    )


def event_title(nation: Column) -> Column:
    return F.concat(F.lit("Harbor Expo "), nation.cast("string"))


def directory_pages(rows: DataFrame) -> DataFrame:
    """Directory pages: a page lists at most 500 keys, so its list of cards stays small."""
    card = F.format_string(
        '<li class="card"><a class="name" href="/exhibitors/company/%d">%s</a></li>', "key", "name"
    )
    pages = rows.groupBy("site", "host", "seed_url", "mode", "c_nationkey", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", card.alias("card")))), lambda s: s["card"]), "").alias("cards")
    )
    totals = rows.groupBy("site").agg(F.max("page_no").alias("total"))
    pages = pages.join(totals, "site")
    others = F.filter(F.sequence(F.lit(1), F.col("total")), lambda p: p != F.col("page_no"))
    pager = F.array_join(
        F.transform(others, lambda p: F.concat(F.lit('<a href="'), _page_address(p), F.lit('">'), p.cast("string"), F.lit("</a>"))), " "
    )
    title = event_title(F.col("c_nationkey"))
    cities = F.array(*[F.lit(f"{city}, {region}") for city, region in CITIES])
    city = F.element_at(cities, (F.col("c_nationkey") % len(CITIES) + 1).cast("int"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), title, F.lit(" | Exhibitor Directory</title>"),
        F.lit('<meta name="description" content="Held in '), city, F.lit('">'),
        F.when(F.col("mode") == 0, F.concat(F.lit("<script>var totalPages = "), F.col("total").cast("string"), F.lit(";</script>"))).otherwise(""),
        F.lit('</head><body><nav><a href="/about">About</a><a href="/faq">FAQ</a></nav><h1>'), title,
        F.lit('</h1><main><ul class="list">'), F.col("cards"), F.lit("</ul></main>"),
        F.when(F.col("mode") > 0, F.concat(F.lit('<div class="pager">'), pager, F.lit("</div>"))).otherwise(""),
        F.lit('<footer><a href="https://www.platform-vendor.net/">Powered by</a></footer></body></html>'),
    )
    return pages.select(_page_address(F.col("page_no")).alias("url"), html.alias("html"))


def profile_pages(rows: DataFrame) -> DataFrame:
    link = F.when(
        F.col("website") != "", F.concat(F.lit('<a class="site" href="'), F.col("website"), F.lit('">Visit website</a>'))
    ).otherwise("")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("name"), F.lit(" | "), event_title(F.col("c_nationkey")),
        F.lit("</title></head><body><nav><a href=\"/exhibitors\">All</a></nav><main><h1>"), F.col("name"), F.lit("</h1><p>Booth A"),
        F.col("key").cast("string"), F.lit("<p>"), link,
        F.lit('<a class="social" href="https://www.facebook.com/company">Facebook</a></main><footer><a href="https://www.platform-vendor.net/">Powered by</a></footer></body></html>'),
    )
    return rows.select(F.col("profile_url").alias("url"), html.alias("html"))


def site_pages(spark: SparkSession, sf_dir: str, spread: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    rows = companies(spark, sf_dir)
    return directory_pages(rows).unionByName(profile_pages(spread(rows)))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = companies(spark, sf_dir).select("seed_url").distinct()
    none = F.lit(None).cast("int")
    return rows.select(
        "seed_url", none.alias("start_page"), none.alias("end_page"),
        F.lit("").alias("conference_name"), F.lit("").alias("conference_location"),
    )
