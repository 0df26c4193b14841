"""From directory entries to the clean company table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallworks.functions import text as T, url as U
from stallworks.operators import names, places, websites
from stallworks.session import cut_lineage


def company_records(
    entries: DataFrame, pages: DataFrame, signals: DataFrame, rendered: DataFrame | None = None
) -> DataFrame:
    """Company, profile and website of every entry; a left join with the profile pages.

    Only pages that are somebody's profile, or the site of a company with a poor
    name, are read.
    """
    wanted = entries.select(F.col("profile_url").alias("url")).filter("url <> ''").distinct()
    profiles = signals.join(wanted, "url", "left_semi")
    found = websites.profile_websites(profiles, websites.scripted_websites(pages))
    records = cut_lineage(websites.resolve_profiles(entries, found))
    if rendered is not None:
        records = websites.resolve_blank_from_rendered(records, rendered)
    looked = records.filter("website_url <> '' AND NOT looked_up").select(U.lookup_url("website_url").alias("url")).distinct()
    return names.enriched_names(records, signals.join(looked, "url", "left_semi"), names.weighted_meta(pages))


def conference_facts(seeds: DataFrame, pages: DataFrame, signals: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Name and place of the event per seed: as asked for, else from its page.

    ``seeds`` has conference_name and conference_location (NULL or '' where not
    given); ``titles`` (seed_url, data_title) holds titles found in data.
    """
    rows = (
        seeds.select("seed_url", F.coalesce("conference_name", F.lit("")).alias("asked_name"),
                     F.coalesce("conference_location", F.lit("")).alias("asked_place"))
        .join(signals.select(F.col("url").alias("seed_url"), "title", "h1_texts"), "seed_url", "left")
        .join(pages.select(F.col("url").alias("seed_url"), "html"), "seed_url", "left")
    )
    if titles is not None:
        rows = rows.join(titles, "seed_url", "left")
        retitled = F.coalesce(F.nullif("data_title", F.lit("")), "title")
        rows = rows.withColumn(
            "h1_texts", names.retitled_headings(F.coalesce("data_title", F.lit("")), F.col("h1_texts"))
        ).withColumn("title", retitled)
    inferred = T.conference_label(
        names.conference_name("seed_url", F.coalesce("title", F.lit("")), F.coalesce("h1_texts", F.array().cast("array<string>")))
    )
    asked = T.conference_label("asked_name")
    rows = rows.withColumn("conference_name", F.coalesce(F.nullif(asked, F.lit("")), inferred))
    mentions = places.location_mentions(
        rows.filter("asked_place = ''").withColumn("url", F.col("seed_url")), "seed_url", "conference_name"
    )
    # the name travels with each mention, so the vote needs no join
    best = places.best_location(places.location_scores(mentions, "seed_url", "conference_name"), "seed_url")
    return rows.join(best, "seed_url", "left").select(
        "seed_url", "conference_name",
        F.coalesce(F.nullif(T.normalize_text("asked_place"), F.lit("")), "conference_location", F.lit("")).alias(
            "conference_location"
        ),
    )


def export_rows(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of the export, with the keys that order and split it."""
    return records.join(facts, "seed_url").select(
        "seed_url", "sort_index", "company_name", "website_url",
        F.col("conference_location").alias("Location"), F.col("conference_name").alias("Conference"),
    )
