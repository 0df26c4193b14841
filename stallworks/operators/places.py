"""Place of an event: a weighted vote over all mentions of "City, Region"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallworks import rules
from stallworks.functions import text as T
from stallworks.functions.binding import let
from stallworks.sources import pages as P

WINDOW = 80


def hits_in_context(html: Column | str) -> Column:
    """Every mention with the 80 characters around it: struct(hit, context).

    The text between the mentions gives their offsets in one pass.
    """
    html = F.col(html) if isinstance(html, str) else html
    hits = F.regexp_extract_all(html, F.lit(rules.CITY_REGION), F.lit(0))
    gaps = F.split(html, rules.CITY_REGION, -1)
    start_state = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        return F.struct(
            (start + F.length(pair["hit"])).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts")
        )

    def placed(hit_list: Column) -> Column:
        pairs = F.arrays_zip(hit_list.alias("hit"), F.slice(gaps, F.lit(1), F.size(hit_list)).alias("gap"))
        starts = F.aggregate(pairs, start_state, step, lambda state: state["starts"])
        return F.transform(
            F.arrays_zip(hit_list.alias("hit"), starts.alias("start")),
            lambda p: F.struct(
                p["hit"].alias("hit"),
                F.substr(
                    html,
                    F.greatest(p["start"] - WINDOW, F.lit(1)),
                    F.least(p["start"] - 1, F.lit(WINDOW)) + F.length(p["hit"]) + WINDOW,
                ).alias("context"),
            ),
        )

    return let(hits, placed)


def location_mentions(pages: DataFrame, *keep: str) -> DataFrame:
    """All mentions in title, headings, meta tags and text: (city, region, weight, context).

    ``pages`` needs url, html, title, h1_texts.
    """
    keys = list(dict.fromkeys(("url", *keep)))

    def from_text(df: DataFrame, text: str, weight: Column, context: Column) -> DataFrame:
        found = df.select(*keys, weight.alias("weight"), context.alias("context"), F.explode(T.city_region_pairs(text)).alias("p"))
        return found.select(*keys, "p.city", "p.region", "weight", "context")

    titles = from_text(pages, "title", F.lit(120.0), F.col("title"))
    heads = pages.select(*keys, F.explode("h1_texts").alias("head"))
    heads = from_text(heads, "head", F.lit(110.0), F.col("head"))
    meta = P.meta_tags(pages, *keys).withColumn(
        "key", F.lower(T.normalize_text(F.coalesce(F.nullif("name", F.lit("")), "property")))
    ).withColumn("content", T.normalize_text("content"))
    meta_weight = F.when(F.col("key").contains("location"), 115.0).when(F.col("key").contains("description"), 85.0).otherwise(95.0)
    meta = from_text(meta, "content", meta_weight, F.concat_ws(" ", "key", "content"))
    raw = pages.select(*keys, F.explode(hits_in_context("html")).alias("h")).select(
        *keys,
        T.location_city(F.regexp_extract("h.hit", rules.CITY_REGION, 1)).alias("city"),
        T.region_abbr(F.regexp_extract("h.hit", rules.CITY_REGION, 2)).alias("region"),
        F.lit(40.0).alias("weight"),
        F.col("h.context").alias("context"),
    ).filter("city <> '' AND region <> ''")
    return titles.unionByName(heads).unionByName(meta).unionByName(raw)


def location_scores(mentions: DataFrame, key: str, conference: str | None = None) -> DataFrame:
    """Sum of votes per place."""
    near = T.contains_any(F.lower("context"), rules.LOCATION_HINTS)
    weight = F.col("weight") + F.when(near, 20.0).otherwise(0.0)
    if conference is not None:
        label = T.canonical_label(F.coalesce(conference, F.lit("")))
        weight = weight + F.when((label != "") & label.contains(T.canonical_label("city")), 20.0).otherwise(0.0)
    return mentions.groupBy(key, F.concat_ws(", ", "city", "region").alias("location")).agg(
        F.sum(weight).alias("score"), F.count("*").alias("mentions")
    )


def best_location(scores: DataFrame, key: str) -> DataFrame:
    """Best place of enough weight per key; of equals the first in the alphabet."""
    ranked = scores.filter(F.col("score") >= rules.LOCATION_MIN_SCORE)
    return ranked.groupBy(key).agg(
        F.min_by("location", F.struct(-F.col("score"), F.col("location"))).alias("conference_location")
    )
