"""Names of companies from their own sites, and names of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.functions.binding import let
from stallworks.sources import pages as P


def weight_of(key: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def weighted_meta(pages: DataFrame) -> DataFrame:
    """Meta tags that name a site, with their weight: a map over the pages, few small rows out."""
    key = F.lower(F.coalesce(F.nullif("property", F.lit("")), "name"))
    return P.meta_tags(pages, "url").withColumn("weight", weight_of(key, rules.META_WEIGHTS)).filter("weight > 0")


def linked_names(sites: DataFrame) -> DataFrame:
    """(url, pos, weight, text): names in linked data, weighed by the types of the objects that bear them.

    An object's types are its ``@type`` values, or its ``type`` values where it has no others.
    """
    texts = sites.select("url", F.inline("linked"))
    kinds = texts.filter(F.col("label").isin("@type", "type") & (F.col("text") != "")).groupBy("url", "owner").agg(*(
        F.max(F.when(F.col("label") == label, weight_of(F.lower("text"), rules.JSON_LD_WEIGHTS))).alias(name)
        for label, name in (("@type", "marked"), ("type", "plain"))))
    named = texts.withColumn("field", F.array_position(F.lit(rules.JSON_LD_NAMES), F.col("key"))).filter("field > 0")
    weighed = named.join(kinds, ["url", "owner"]).withColumn("weight", F.coalesce("marked", "plain"))
    return weighed.filter("weight > 0").select("url", (F.col("owner") * 4 + F.col("field")).cast("int").alias("pos"), "weight", "text")


def name_candidates(sites: DataFrame, meta: DataFrame) -> DataFrame:
    """All names a site gives itself: (url, src, pos, weight, name), source order kept for ties.

    ``sites`` are signals, ``meta`` their weighted meta tags.
    """

    def rows(df: DataFrame, src: int, weight: Column, text: Column, pos: Column) -> DataFrame:
        found = df.select("url", F.lit(src).alias("src"), pos.alias("pos"), weight.alias("weight"),
                          T.brandish_candidates(text).alias("names"))
        return found.select("url", "src", "pos", "weight", F.posexplode("names").alias("sub", "name"))

    meta = meta.join(sites.select("url"), "url", "left_semi")
    ld = linked_names(sites)
    parts = sites.select("url", F.posexplode(T.split_title("title")).alias("pos", "part"))
    heads = sites.select("url", F.posexplode("h1_texts").alias("pos", "part"))
    return (
        rows(meta, 0, F.col("weight"), F.col("content"), F.col("pos"))
        .unionByName(rows(ld, 1, F.col("weight"), F.col("text"), F.col("pos")))
        .unionByName(rows(parts, 2, F.lit(90.0), F.col("part"), F.col("pos")))
        .unionByName(rows(sites, 3, F.lit(55.0), F.col("title"), F.lit(0)))
        .unionByName(rows(heads, 4, F.lit(75.0), F.col("part"), F.col("pos")))
    )


def site_names(sites: DataFrame, meta: DataFrame) -> DataFrame:
    """(lookup_url, site_name): the best name of a site; its domain where none fits, '' where that is poor.

    First mention per spelling and arg-max are both aggregates.
    """
    candidates = name_candidates(sites, meta)
    first = candidates.groupBy("url", F.lower("name").alias("name_key")).agg(
        F.min_by(F.struct("weight", "name", "src", "pos", "sub"), F.struct("src", "pos", "sub")).alias("c")
    )
    scored = first.select("url", "c.*").withColumn(
        "score", S.company_name_score(F.col("name"), F.col("url"), F.col("weight"))
    ).filter("score IS NOT NULL")
    best = scored.groupBy("url").agg(
        F.max_by(
            F.struct("name", "weight"),
            F.struct("score", -F.col("src"), -F.col("pos"), -F.col("sub")),
        ).alias("best")
    )
    domain_name = T.clean_company_name(U.infer_name_from_url("url"))
    own = S.brand_match(F.col("best.name"), F.col("url")) | (F.col("best.weight") >= 150)
    fallback = let(domain_name, lambda n: F.when(T.is_low_confidence_name(n), "").otherwise(n))
    return best.select(
        F.col("url").alias("lookup_url"),
        F.when(own, F.col("best.name")).otherwise(fallback).alias("site_name"),
    )


def enriched_names(records: DataFrame, sites: DataFrame, meta: DataFrame) -> DataFrame:
    """Better names for poor ones: cleaned, then from the company's own site.

    Only rows that were not looked up are touched, and only poor ones with a
    website meet the site table, once per distinct site.
    """
    cleaned = records.withColumn(
        "clean_name", F.when(F.col("looked_up"), F.col("company_name")).otherwise(T.clean_company_name("company_name"))
    )
    poor = ~F.col("looked_up") & (F.col("website_url") != "") & T.is_low_confidence_name("clean_name")
    marked = cleaned.withColumn("lookup_url", F.when(poor, U.lookup_url("website_url")))
    kept = marked.filter("lookup_url IS NULL").select(
        *[F.col("clean_name").alias(c) if c == "company_name" else F.col(c) for c in records.columns]
    )
    better = marked.filter("lookup_url IS NOT NULL").join(site_names(sites, meta), "lookup_url", "left")
    name = T.clean_company_name(F.coalesce(F.nullif("site_name", F.lit("")), "clean_name"))
    return kept.unionByName(
        better.select(*[name.alias(c) if c == "company_name" else F.col(c) for c in records.columns])
    )


def host_words(url: Column | str) -> Column:
    """Readable host, for pages that name no event."""
    parts = F.filter(F.split(U.host_key(url), r"\."), lambda p: (p != "") & ~p.isin(rules.HOST_SUFFIX_LABELS))
    return F.coalesce(F.nullif(F.initcap(F.array_join(parts, " ")), F.lit("")), F.lit("conference_directory"))


def conference_name(url: Column | str, title: Column | str, headings: Column | str) -> Column:
    """Name of the event from title parts, title and headings; else from the host."""
    title = F.col(title) if isinstance(title, str) else title
    headings = F.col(headings) if isinstance(headings, str) else headings
    candidates = T.distinct_texts(F.concat(T.split_title(title), F.array(title), headings))
    return F.coalesce(T.best_conference_text(candidates), host_words(url))


def retitled_headings(title: Column, headings: Column) -> Column:
    """Headings with a title found in the data put first, unless they have it already."""
    known = F.exists(headings, lambda h: F.lower(h) == F.lower(title))
    return F.when((title == "") | known, headings).otherwise(F.concat(F.array(title), headings))
