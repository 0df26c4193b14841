"""Which repeated links or containers of a directory page list its companies.

Tables: ``candidates`` (seed_url, page_url, source_kind, signature, url_group,
name, url, ord) and ``strategies`` (seed_url, source_kind, signature, url_group,
base_score, unique_urls, sample_names, rank).  A page list is (seed_url,
directory_page, page_url).

All groupings over a seed are plain aggregates with map-side partial results or
"first k" windows, which Spark also cuts down before the shuffle; so a seed that
holds a third of all rows needs no special care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.functions.binding import let
from stallworks.session import cut_lineage
from stallworks.sources import signals as G

KEYS = ["seed_url", "source_kind", "signature", "url_group"]
PAGE = ["seed_url", "page_url"]
LISTED = ["seed_url", "page_url", "directory_page"]
KINDS = ["anchor", "action", "container", "text_container"]

# --- fixed values: weights per kind (per URL, diversity, constant, smallest group) ---
WEIGHTS = {"anchor": (12, 30, 0, 3), "action": (12, 30, 0, 3), "container": (14, 35, 0, 3), "text_container": (10, 18, 8, 3)}
FALLBACK_WEIGHTS = {"anchor": (12, 20, 5, 3), "action": (12, 20, 5, 3), "container": (14, 30, 10, 3), "text_container": (10, 15, 0, 5)}


def by_kind(table: dict, position: int) -> Column:
    out = F.lit(None)
    for kind, values in table.items():
        out = F.when(F.col("source_kind") == kind, F.lit(float(values[position]))).otherwise(out)
    return out


def company_links(links: DataFrame, seed: str = "seed_url") -> DataFrame:
    """Same-site links outside header, footer and navigation whose text may be a name.

    The cheap region flags come first: filters keep their order in the plan.
    """
    return links.filter(~(F.col("in_header") | F.col("in_footer") | F.col("in_nav"))).filter(
        U.same_site("absolute_url", seed) & ~U.looks_like_asset("absolute_url") & T.is_companyish("display_text")
    )


def link_candidates(pages: DataFrame) -> DataFrame:
    """Candidates from anchors and from other navigable actions (page rows with ``page_url``)."""
    keep = ("seed_url", "page_url")
    outside = lambda a: ~(a["in_header"] | a["in_footer"] | a["in_nav"])
    links = G.anchors(pages, *keep, worth=outside).unionByName(G.non_anchor_actions(G.actions(pages, *keep, worth=outside)))
    return company_links(links).select(
        *PAGE, "source_kind", "signature",
        U.url_group("absolute_url").alias("url_group"),
        F.col("display_text").alias("name"), F.col("absolute_url").alias("url"), "ord",
    )


def with_scored_actions(pages: DataFrame) -> DataFrame:
    """Page rows whose actions carry address and profile score, each computed once per page."""

    def scored(action: Column) -> Column:
        base = F.struct(
            F.coalesce(U.resolve_target(F.col("url"), action["raw_url"]), F.lit("")).alias("absolute_url"),
            T.display_text(action["text"], action["title_attr"], action["aria_label"]).alias("display_text"),
            *[action[f].alias(f) for f in ("tag", "source_attr", "in_header", "in_footer", "in_nav", "in_main")],
        )
        return let(
            base,
            lambda a: F.struct(
                a["absolute_url"].alias("url"), S.profile_action_score(a, F.col("seed_url")).alias("score")
            ),
        )

    return pages.withColumn("scored", F.transform("actions", scored))


def containers(pages: DataFrame) -> DataFrame:
    """One row per container that may be an entry, with its headings and actions cut out.

    The cutting happens inside the page's row, and wrappers of many links drop
    out there, so a page's lists are not copied once per container.  A container
    may be an entry if it leads to one to three profiles, or holds one to four
    actions in all.
    """

    def cut(c: Column) -> Column:
        actions = F.filter(F.slice("scored", c["first_action"] + 1, c["action_count"]), lambda a: a["url"] != "")
        return F.struct(
            *[c[f].alias(f) for f in ("signature", "ord", "in_main", "text_length", "text")],
            F.slice("headings", c["first_heading"] + 1, c["heading_count"]).alias("heading_texts"),
            actions.alias("actions"),
        )

    def profiles(c: Column) -> Column:
        valid = F.filter(c["actions"], lambda a: a["score"].isNotNull())
        return F.size(F.array_distinct(F.transform(valid, lambda a: a["url"])))

    outside = lambda c: c["in_header"] | c["in_footer"] | c["in_nav"]
    worth = F.filter(
        "containers", lambda c: ~outside(c) & ((c["heading_count"] > 0) | c["text"].isNotNull())
    )
    kept = F.filter(F.transform(worth, cut), lambda c: F.size(c["actions"]).between(1, 4) | profiles(c).between(1, 3))
    return with_scored_actions(pages).select(*PAGE, "url", F.inline(kept))


def container_candidates(rows: DataFrame) -> DataFrame:
    """Cards: best heading as name, best action as profile link."""
    headings = T.distinct_texts(F.col("heading_texts"))
    scored_names = F.filter(
        F.transform(
            F.col("distinct_headings"),
            lambda h, i: F.struct(S.container_name_score(h).alias("score"), (-i).alias("place"), h.alias("name")),
        ),
        lambda s: s["score"].isNotNull(),
    )
    valid = F.filter("actions", lambda a: a["score"].isNotNull())
    best = F.array_max(
        F.transform(
            F.col("valid"), lambda a, i: F.struct(a["score"].alias("score"), (-i).alias("place"), a["url"].alias("url"))
        )
    )
    out = (
        rows.withColumn("distinct_headings", headings)
        .filter(F.size("distinct_headings") <= 5)
        .withColumn("valid", valid)
        .filter(F.size(F.array_distinct(F.transform("valid", lambda a: a["url"]))).between(1, 3))
        .withColumn("best", best)
        .filter("best.score >= 18")
        .withColumn("heading", F.coalesce(F.array_max(scored_names)["name"], F.lit("")))
        .withColumn(
            "name",
            F.when(F.col("heading") != "", F.col("heading")).otherwise(
                F.coalesce(T.booth_and_name(F.coalesce("text", F.lit("")))["name"], F.lit(""))
            ),
        )
        .filter("name <> ''")
    )
    return out.select(
        *PAGE, F.lit("container").alias("source_kind"), "signature",
        U.url_group("best.url").alias("url_group"), "name", F.col("best.url").alias("url"), "ord",
    )


def text_container_candidates(rows: DataFrame) -> DataFrame:
    """Short cards in the main part that link to no profile; their address is made up from the page's."""
    texts = F.filter(F.concat("heading_texts", F.array("text")), lambda t: t.isNotNull())
    named = F.filter(F.transform(texts, T.booth_and_name), lambda p: p["name"] != "")
    out = (
        rows.filter(f"in_main AND text_length BETWEEN 1 AND {rules.SHORT_TEXT} AND size(actions) BETWEEN 1 AND 4")
        .filter(~F.exists("actions", lambda a: F.coalesce(a["score"] >= 35, F.lit(False))))
        .withColumn("pair", F.get(named, F.lit(0)))
        .filter("pair IS NOT NULL")
    )
    return out.select(
        *PAGE, F.lit("text_container").alias("source_kind"), "signature", F.lit("#text").alias("url_group"),
        F.col("pair.name").alias("name"),
        U.text_fragment_url("url", F.col("pair.name"), F.col("pair.booth")).alias("url"), "ord",
    )


def listing_candidates(pages: DataFrame, page: Column | None = None) -> DataFrame:
    """Union of the four kinds for page rows (signals with seed_url).

    ``page`` names the page where its address does not (answers of a paginator).
    """
    pages = pages.withColumn("page_url", F.col("url") if page is None else page)
    rows = cut_lineage(containers(pages))  # read for cards and for texts
    return (
        link_candidates(pages)
        .unionByName(container_candidates(rows))
        .unionByName(text_container_candidates(rows))
    )


def best_link_per_url(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One name per URL: for links a domain text first, then the longer text; the earlier of equals."""
    preference = F.struct(
        (S.domain_text(F.col("name")) & F.col("source_kind").isin("anchor", "action")).cast("int"),
        F.length("name"),
        -F.col("ord"),
    )
    return candidates.groupBy(*keys, "url").agg(
        F.max_by("name", preference).alias("name"), F.min("ord").alias("first_ord")
    )


def first_names(rows: DataFrame, keys: list[str], order: str, count: int = 3) -> DataFrame:
    """The first names per key; the cut happens before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(order, "url")
    return (
        rows.withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= count)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("sample_names"))
    )


def specific_strategies(candidates: DataFrame) -> DataFrame:
    """One strategy per (kind, signature, URL shape) with enough distinct URLs."""
    links = best_link_per_url(candidates, KEYS)
    groups = links.groupBy(*KEYS).agg(
        F.count("*").alias("unique_urls"),
        F.countDistinct(F.lower("name")).alias("unique_names"),
        F.avg(F.length("name")).alias("average_length"),
        F.bool_or(F.lower("name").startswith("www.")).alias("any_www"),
        F.min("first_ord").alias("first_ord"),
    )
    bonus = F.when(
        F.col("source_kind") == "text_container", F.lit(0.0)
    ).otherwise(S.listing_bonus(F.col("url_group"), F.col("average_length"), F.col("any_www")))
    score = (
        F.col("unique_urls") * by_kind(WEIGHTS, 0)
        + F.col("unique_names") / F.col("unique_urls") * by_kind(WEIGHTS, 1)
        + by_kind(WEIGHTS, 2)
        + bonus
    )
    return (
        groups.filter(F.col("unique_urls") >= by_kind(WEIGHTS, 3))
        .withColumn("base_score", score)
        .join(first_names(links, KEYS, "first_ord"), KEYS)
        .select(*KEYS, "base_score", "unique_urls", "sample_names", "first_ord", F.lit(0).alias("is_fallback"))
    )


def fallback_strategies(candidates: DataFrame) -> DataFrame:
    """One catch-all strategy per kind, for directories without a common shape."""
    keys = ["seed_url", "source_kind"]
    groups = candidates.groupBy(*keys).agg(
        F.countDistinct("url").alias("unique_urls"), F.countDistinct(F.lower("name")).alias("unique_names")
    )
    score = (
        F.col("unique_urls") * by_kind(FALLBACK_WEIGHTS, 0)
        + F.col("unique_names") / F.col("unique_urls") * by_kind(FALLBACK_WEIGHTS, 1)
        + by_kind(FALLBACK_WEIGHTS, 2)
    )
    return (
        groups.filter(F.col("unique_urls") >= by_kind(FALLBACK_WEIGHTS, 3))
        .withColumn("base_score", score)
        .join(first_names(candidates, keys, "ord"), keys)
        .select(
            "seed_url", "source_kind", F.array().cast("array<string>").alias("signature"), F.lit("*").alias("url_group"),
            "base_score", "unique_urls", "sample_names", F.lit(0).alias("first_ord"), F.lit(1).alias("is_fallback"),
        )
    )


def rank_strategies(strategies: DataFrame, limit: int | None = None) -> DataFrame:
    """Strategies per seed, by score then size; equals keep kind, then page order."""
    kind = F.array_position(F.lit(KINDS), F.col("source_kind"))
    window = Window.partitionBy("seed_url").orderBy(
        F.desc("base_score"), F.desc("unique_urls"), kind, "is_fallback", "first_ord",
        F.array_join("signature", " "), "url_group",
    )
    ranked = strategies.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def listing_strategies(candidates: DataFrame) -> DataFrame:
    """Ranked strategies of all kinds for the candidates of the seed pages."""
    return rank_strategies(specific_strategies(candidates).unionByName(fallback_strategies(candidates)))


def matching_entries(candidates: DataFrame, strategies: DataFrame) -> DataFrame:
    """Entries that a strategy finds on each listed page, by relaxing the match where it finds fewer than two.

    The counting window is over one page and one strategy, hence bounded by a
    document.  AQE picks the join and splits a hot seed.
    """
    chosen = strategies.select(
        "seed_url", "source_kind", "rank",
        F.col("signature").alias("s_signature"), F.col("url_group").alias("s_group"),
    )
    rows = candidates.join(chosen, ["seed_url", "source_kind"])
    any_signature = F.size("s_signature") == 0
    is_text = F.col("source_kind") == "text_container"
    rows = rows.withColumn("sig_ok", any_signature | (F.col("signature") == F.col("s_signature"))).withColumn(
        "group_ok", is_text | (F.col("s_group") == "*") | (F.col("url_group") == F.col("s_group"))
    ).filter("sig_ok OR group_ok")
    window = Window.partitionBy(*LISTED, "source_kind", "rank")
    rows = rows.withColumn("n_both", F.count_if(F.col("sig_ok") & F.col("group_ok")).over(window)).withColumn(
        "n_sig", F.count_if("sig_ok").over(window)
    )
    relaxed = F.when(any_signature, F.col("n_both")).otherwise(F.col("n_sig"))
    by_group = (F.col("n_both") < 2) & (relaxed < 2) & (F.col("s_group") != "*") & ~is_text
    kept = (
        F.when(F.col("n_both") >= 2, F.col("sig_ok") & F.col("group_ok"))
        .when(by_group, F.col("group_ok"))
        .when(any_signature, F.col("sig_ok") & F.col("group_ok"))
        .otherwise(F.col("sig_ok"))
    )
    return best_link_per_url(rows.filter(kept), [*LISTED, "source_kind", "rank"]).filter("name <> ''")


def strategy_support(
    strategies: DataFrame, seed_entries: DataFrame, websites: DataFrame, weight: int = rules.SUPPORT_WEIGHT
) -> DataFrame:
    """Score of each strategy after looking at the profiles of all its entries: their mean points times a weight.

    ``websites`` holds (profile_url, website_url) of profiles already read.
    """
    keys = ["seed_url", "source_kind", "rank"]
    found = websites.groupBy(F.col("profile_url").alias("url")).agg(F.max("website_url").alias("website_url"))
    sampled = seed_entries.join(found, "url", "left")
    points = F.when(U.fragment("url") != "", 5.0).when(F.coalesce("website_url", F.lit("")) != "", 90.0).otherwise(5.0)
    sampled = sampled.groupBy(*keys).agg((F.avg(points) * weight).alias("sample_points"))
    counts = seed_entries.groupBy(*keys).agg(F.count("*").alias("entry_count"))
    return (
        strategies.join(counts, keys)
        .join(sampled, keys)
        .withColumn("score", F.col("base_score") + F.least("entry_count", F.lit(20)) + F.col("sample_points"))
    )


def choose_strategy(supported: DataFrame) -> DataFrame:
    """The best strategy per seed; the better ranked of equals."""
    window = Window.partitionBy("seed_url").orderBy(F.desc("score"), "rank")
    return supported.withColumn("choice", F.row_number().over(window)).filter("choice = 1").drop("choice")
