"""The company's own website: from its profile page, checked against its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.sources import pages as P, signals as G


def page_brand_keys() -> Column:
    """Brand keys of the cleaned names in headings and title of a page."""
    names = F.filter(F.transform(F.concat("h1_texts", T.split_title("title")), T.clean_company_name), lambda b: b != "")
    return F.array_distinct(F.transform(names, T.brand_key))


def json_ld_urls(profiles: DataFrame) -> DataFrame:
    """First plausible off-site address in a profile's linked data."""
    leaves = profiles.select("url", F.posexplode("linked").alias("pos", "leaf")).filter(
        F.col("leaf.label").isin("url", "sameAs")
    )
    leaves = leaves.withColumn("target", U.normalize_http_url("leaf.text")).filter("target IS NOT NULL")
    return (
        leaves.filter(S.plausible_website("target", F.col("url")))
        .groupBy("url")
        .agg(F.min_by("target", "pos").alias("ld_url"))
    )


def best_external_link(profiles: DataFrame) -> DataFrame:
    """Best scoring off-site link of each profile that may be a company's own."""
    keep = ("brands",)
    rows = profiles.withColumn("brands", page_brand_keys())
    links = G.anchors(rows, *keep).withColumn("src", F.lit(0)).unionByName(
        G.non_anchor_actions(G.actions(rows, *keep)).withColumn("src", F.lit(1))
    )
    links = links.filter(~U.same_site("absolute_url", "url"))
    preference = F.struct(
        (F.col("display_text") != "").cast("int"), S.domain_text(F.col("display_text")).cast("int"),
        F.length("display_text"), -F.col("src"), -F.col("ord"),
    )
    others = [c for c in links.columns if c not in ("url", "absolute_url", "brands", "src")]
    best = links.groupBy("url", "absolute_url").agg(
        F.max_by(F.struct(*others), preference).alias("link"),
        F.first("brands").alias("brands"),
        F.min(F.struct("src", "ord")).alias("first_seen"),
    )
    best = best.select("url", "absolute_url", "brands", "first_seen", "link.*")
    scored = best.withColumn("score", S.external_link_score(S.row, F.col("url"))).filter("score >= 35")
    scored = scored.withColumn("host_brand", S.host_brand_key("absolute_url")).withColumn(
        "branded", F.when(F.size("brands") > 0, F.exists("brands", lambda b: S.keys_match(b, F.col("host_brand"))))
    )
    fit = scored.filter((F.col("score") >= 55) | F.coalesce("branded", F.lit(True))).filter(
        S.plausible_website("absolute_url", F.col("url"), F.col("branded"))
    )
    return fit.groupBy("url").agg(
        F.max_by("absolute_url", F.struct("score", -F.col("first_seen.src"), -F.col("first_seen.ord"))).alias("link_url")
    )


def scripted_websites(pages: DataFrame) -> DataFrame:
    """(url, scripted_url) of pages whose scripts name the website: a map over the pages, few small rows out."""
    marked = reduce(lambda a, b: a | b, [F.lower("html").contains(f.lower()) for f in rules.EMBEDDED_WEBSITE_FIELDS])
    return pages.filter(marked).select("url", P.embedded_url("html").alias("scripted_url")).filter("scripted_url <> ''")


def profile_websites(profiles: DataFrame, scripted: DataFrame) -> DataFrame:
    """(profile_url, website_url) for page rows (signals).

    The address in the page's scripts comes first, then linked data, then the
    best link; '' where none fits.  Page texts take no part in the joins.
    """
    joined = (
        profiles.select("url").distinct()
        .join(scripted, "url", "left")
        .join(json_ld_urls(profiles), "url", "left")
        .join(best_external_link(profiles), "url", "left")
    )
    return joined.select(
        F.col("url").alias("profile_url"), F.coalesce("scripted_url", "ld_url", "link_url", F.lit("")).alias("website_url")
    )


def resolve_profiles(entries: DataFrame, websites: DataFrame) -> DataFrame:
    """Records of all entries: website by hint or by the profile looked up.

    Only entries that need it meet the profile table.  Where no profile page is
    known the record stays without website and counts as a failure.
    """
    hinted = entries.withColumn("hint", S.validated_website("company_name", "website_url_hint")).withColumn(
        "needs_lookup",
        (F.col("hint") == "") & (F.col("profile_url") != "") & (U.fragment("profile_url") == ""),
    )
    direct = hinted.filter(~F.col("needs_lookup")).select(
        *entries.columns, F.col("hint").alias("website_url"), F.lit(False).alias("looked_up"), F.lit(False).alias("failed")
    )
    held = websites.groupBy("profile_url").agg(F.max("website_url").alias("found"))
    found = (
        hinted.filter("needs_lookup")
        .join(held, "profile_url", "left")
        .select(
            *entries.columns,
            F.when(F.coalesce("found", F.lit("")) != "", S.validated_website("company_name", "found"))
            .otherwise("").alias("website_url"),
            F.lit(True).alias("looked_up"),
            F.col("found").isNull().alias("failed"),
        )
    )
    return direct.unionByName(found)


def resolve_blank_from_rendered(records: DataFrame, rendered: DataFrame) -> DataFrame:
    """Second look for records still without website, in a table of rendered profiles."""
    blank = (F.col("website_url") == "") & (F.col("profile_url") != "")
    held = rendered.filter("website_url <> ''").groupBy("profile_url").agg(F.min("website_url").alias("found"))
    found = (
        records.filter(blank)
        .join(held, "profile_url", "left")
        .withColumn("website_url", S.validated_website("company_name", F.coalesce("found", F.lit(""))))
        .select(*records.columns)
    )
    return records.filter(~blank).unionByName(found)


def require_website(records: DataFrame) -> DataFrame:
    return records.filter("website_url <> ''")


def run_metrics(records: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Counts per seed: companies, with website, dropped when a website is required, failures.

    With ``seeds``, a seed without records has its row of zeros.
    """
    counts = records.groupBy("seed_url").agg(
        F.count("*").alias("record_count"),
        F.count_if(F.col("website_url") != "").alias("company_count"),
        F.count_if(F.col("website_url") == "").alias("dropped_count"),
        F.count_if("failed").alias("failures"),
    )
    if seeds is None:
        return counts
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "seed_url"]
    return seeds.select("seed_url").distinct().join(counts, "seed_url", "left").select("seed_url", *zero)
