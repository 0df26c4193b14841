"""From seeds and a page snapshot to the entries of each directory.

Every step takes all seeds at once.  What several later steps read is written
down once (``cut_lineage``): page signals, listing candidates, page lists.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.operators import crawl, embedded, lines, listing, websites
from stallworks.operators.entries import at_least, best_source, dedupe_entries, page_range
from stallworks.session import cut_lineage
from stallworks.sources import embedded as E, pages as P, signals as G

# Order in which the kinds of source are asked; the first that has entries wins.
SOURCES = ["platform", "gallery", "richtext", "ocr", "table", "listing", "embedded"]
CANDIDATE = ["seed_url", "directory_page", "visit_no", "page_url", "company_name", "profile_url", "website_url_hint",
             "name_key", "first_ord", "source_kind", "data_title"]


def profile_table(urls: DataFrame, pages: DataFrame, signals: DataFrame) -> DataFrame:
    """(profile_url, website_url) of the pages with these addresses (column ``url``), each read once."""
    profiles = signals.join(urls.select("url").distinct().hint("merge"), "url", "left_semi")
    return websites.profile_websites(profiles, websites.scripted_websites(pages))


def seed_strategies(seeds: DataFrame, candidates: DataFrame, profiles: DataFrame):
    """(chosen strategy per seed, entries it finds on the seed page)."""
    on_seed = candidates.join(seeds.select("seed_url"), "seed_url", "left_semi").filter("page_url = seed_url").withColumn(
        "directory_page", F.lit(1).cast("bigint")
    )
    ranked = cut_lineage(listing.listing_strategies(on_seed))
    entries = cut_lineage(listing.matching_entries(on_seed, ranked))
    supported = listing.strategy_support(ranked, entries, profiles)
    chosen = cut_lineage(listing.choose_strategy(supported))
    own = entries.join(chosen.select("seed_url", "source_kind", "rank"), ["seed_url", "source_kind", "rank"], "left_semi")
    return chosen, own.withColumnRenamed("url", "profile_url")


def listing_entries(
    seeds: DataFrame, pages: DataFrame, signals: DataFrame, candidates: DataFrame, profiles: DataFrame,
    fragments: DataFrame | None = None, max_pages: int | None = None, own: DataFrame | None = None,
) -> DataFrame:
    """Entries found by the chosen listing strategy over all pages of each directory.

    ``candidates``: listing candidates of all pages that may belong to a seed; ``own``: signals of these pages;
    ``profiles``: (profile_url, website_url).  Each seed goes one way: stated
    page total, scripted paginator, page parameter, or links between pages.
    """
    chosen, seed_entries = seed_strategies(seeds, candidates, profiles)
    seeds = seeds.join(chosen.select("seed_url"), "seed_url", "left_semi")
    known = cut_lineage(signals.select("url", crawl.listing_key("url").alias("listing")))
    seed_pages = pages.join(seeds.select(F.col("seed_url").alias("url")), "url", "left_semi")
    own = crawl.page_rows(seeds, signals) if own is None else own.join(seeds.select("seed_url"), "seed_url", "left_semi")
    links = cut_lineage(G.anchors(own, "seed_url"))

    explicit = cut_lineage(crawl.explicit_pages(seeds, seed_pages, known, candidates, chosen, seed_entries))
    rest = seeds.join(explicit.select("seed_url"), "seed_url", "left_anti")
    by_script = None
    if fragments is not None:
        configs, tokens = P.paginator_calls(seed_pages), P.form_tokens(seed_pages, "url")
        by_script = cut_lineage(
            crawl.paginator_pages(rest, configs, tokens, fragments, G.page_signals, chosen, seed_entries, max_pages)
        )
        rest = rest.join(by_script.select("seed_url"), "seed_url", "left_anti")
    params = cut_lineage(crawl.query_param_votes(rest, links.filter("url = seed_url")))
    probed = crawl.query_probe_pages(rest, params, known, max_pages)
    walked = rest.join(params, "seed_url", "left_anti")
    reached = crawl.crawl_reachable(walked, crawl.pagination_edges(links), known, max_pages)

    numbered = explicit.withColumn("mode", F.lit("explicit")).unionByName(probed.withColumn("mode", F.lit("probe")))
    page_list = numbered.withColumn("visit_no", F.col("directory_page")).unionByName(
        reached.withColumn("mode", F.lit("walk")).withColumnRenamed("place", "visit_no")
    )
    page_list = cut_lineage(page_list.withColumn("directory_page", F.col("directory_page").cast("bigint")))
    numbers = page_list.select("seed_url", "page_url", F.struct("directory_page", "visit_no", "mode").alias("directory_page"))
    found = cut_lineage(
        crawl.entries_of(numbers, candidates, chosen)
        .withColumns({"visit_no": F.col("directory_page.visit_no"), "mode": F.col("directory_page.mode")})
        .withColumn("directory_page", F.col("directory_page.directory_page"))
    )
    by_number = crawl.query_probe(page_list.filter("mode = 'probe'"), found.filter("mode = 'probe'"))
    rows = found.filter("mode <> 'probe'").unionByName(by_number)
    if by_script is not None:
        rows = rows.unionByName(by_script.withColumn("visit_no", F.col("directory_page")), allowMissingColumns=True)
    return rows.select(
        "seed_url", "directory_page", "visit_no", "page_url", F.col("name").alias("company_name"), "profile_url",
        F.lit("").alias("website_url_hint"), F.lower("name").alias("name_key"), "first_ord", "source_kind",
        F.lit("").alias("data_title"),
    )


def _one_page(rows: DataFrame, kind: str) -> DataFrame:
    """Entries that a seed page (or its data) holds as a whole, in the order found."""
    have = rows.columns
    return rows.select(
        "seed_url",
        (F.col("directory_page") if "directory_page" in have else F.lit(1)).cast("bigint").alias("directory_page"),
        (F.col("directory_page") if "directory_page" in have else F.lit(1)).cast("bigint").alias("visit_no"),
        (F.col("page_url") if "page_url" in have else F.col("seed_url")).alias("page_url"),
        "company_name",
        (F.col("profile_url") if "profile_url" in have else F.lit("")).alias("profile_url"),
        (F.col("website_url_hint") if "website_url_hint" in have else F.lit("")).alias("website_url_hint"),
        F.lit("").alias("name_key"), F.col("ord").cast("int").alias("first_ord"), F.lit(kind).alias("source_kind"),
        (F.col("data_title") if "data_title" in have else F.lit("")).alias("data_title"),
    )


def table_mode(seeds: DataFrame, pages: DataFrame, signals: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Entries of directories that list companies in tables, over all their pages."""
    seed_key = seeds.select(F.col("seed_url").alias("url"))
    seed_pages = pages.join(seed_key, "url", "left_semi")
    first = at_least(lines.table_entries(seed_pages), ["url"], rules.MIN_TABLE)
    ready = cut_lineage(seeds.join(first.select(F.col("url").alias("seed_url")).distinct(), "seed_url", "left_semi"))
    links = G.anchors(signals.join(ready.select(F.col("seed_url").alias("url")), "url", "left_semi"))
    params = crawl.query_param_votes(ready, links)
    page_list = cut_lineage(crawl.table_pages(ready, links, params, crawl.pagination_edges(links), max_pages))
    held = pages.join(page_list.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi")
    found = lines.table_entries(held).withColumnRenamed("url", "page_url")
    return crawl.until_empty(page_list, page_list.join(found, "page_url"))


def page_marks(seed_pages: DataFrame) -> dict[str, bool]:
    """Which kinds of source occur at all: one aggregate row, so that absent kinds cost no job."""
    html = F.col("html")
    state = reduce(lambda a, b: a | b, [html.contains(v) for v in ("__NEXT_DATA__", *rules.STATE_VARIABLES)])
    marks = {
        "gallery": html.contains("wix-warmup-data"), "richtext": html.contains("richTextElement"),
        "table": html.rlike("(?i)<tr"), "state": state,
    }
    row = seed_pages.agg(*[F.coalesce(F.bool_or(mark), F.lit(False)).alias(name) for name, mark in marks.items()]).first()
    return row.asDict()


def directory_candidates(
    seeds: DataFrame, pages: DataFrame, signals: DataFrame, *, fragments: DataFrame | None = None,
    search_payloads: DataFrame | None = None, floorplan_payloads: DataFrame | None = None,
    ocr_lines: DataFrame | None = None, max_pages: int | None = None,
) -> DataFrame:
    """Candidates of the best source of each seed.

    Sources that need no other page are read first; only seeds that none of them
    serves go on to the costlier ones.
    """
    # written down: a filter on what is read from a text goes below the join, to the texts of all pages
    seed_pages = cut_lineage(pages.join(seeds.select(F.col("seed_url").alias("url")), "url", "left_semi"))
    as_seed = lambda df: df.withColumnRenamed("url", "seed_url")
    found = []
    if search_payloads is not None:
        found.append(("platform", E.search_payload_entries(search_payloads)))
    if floorplan_payloads is not None:
        found.append(("platform", E.floorplan_payload_entries(floorplan_payloads).withColumnRenamed("plan_title", "data_title")))
    marks = page_marks(seed_pages)
    if marks["gallery"]:
        found.append(("gallery", as_seed(embedded.gallery_entries(E.gallery_items(seed_pages)))))
    if marks["richtext"]:
        found.append(("richtext", as_seed(lines.richtext_entries(seed_pages))))
    if ocr_lines is not None:
        pairs = lines.name_url_pairs(ocr_lines)
        found.append(("ocr", pairs.withColumn("ord", F.col("image_rank") * 1000000 + F.col("line_no"))))
    if marks["table"]:
        found.append(("table", table_mode(seeds, pages, signals, max_pages)))
    parts = [_one_page(rows, kind).withColumn("priority", F.lit(SOURCES.index(kind))) for kind, rows in found]
    rest, out = seeds, []
    if parts:
        direct = cut_lineage(best_source(reduce(DataFrame.unionByName, parts)).drop("priority"))
        rest = cut_lineage(seeds.join(direct.select("seed_url"), "seed_url", "left_anti"))
        out.append(direct)
    own = cut_lineage(crawl.page_rows(rest, signals))
    candidates = cut_lineage(listing.listing_candidates(own))
    profiles = cut_lineage(profile_table(candidates.filter("page_url = seed_url"), pages, signals))
    listed = cut_lineage(
        listing_entries(rest, seed_pages, signals, candidates, profiles, fragments, max_pages, own)
    )
    out.append(listed)
    if marks["state"]:
        last = rest.join(listed.select("seed_url"), "seed_url", "left_anti").select(F.col("seed_url").alias("url"))
        state = E.embedded_state(seed_pages.join(last, "url", "left_semi"))
        out.append(_one_page(as_seed(embedded.embedded_entries(state)), "embedded"))
    return reduce(DataFrame.unionByName, out)


def directory_entries(candidates: DataFrame) -> DataFrame:
    """First entry per company in page order, numbered from 0 per seed."""
    kept = candidates.select(*(c for c in CANDIDATE if c != "data_title"))
    rows = dedupe_entries(kept, ["visit_no", "page_url"], ["name_key", "first_ord"])
    return rows.select(
        "seed_url", "sort_index", "directory_page", "company_name", "profile_url", "website_url_hint", "source_kind"
    )


def data_titles(candidates: DataFrame) -> DataFrame:
    """(seed_url, data_title): the title that a seed's data gives its event, of several the first in page order."""
    titled = candidates.filter("data_title <> ''")
    return titled.groupBy("seed_url").agg(F.min_by("data_title", F.struct("visit_no", "page_url", "first_ord")).alias("data_title"))


UNKNOWN, EMPTY_RANGE, NO_ENTRIES = "page is not in the snapshot", "start page is greater than end page", "no entries"


class Run(NamedTuple):
    entries: DataFrame  #: of every asked seed, numbered from 0
    outcomes: DataFrame  #: (seed_url, resolved_url, entries, error): every asked seed once, with entries or one reason
    titles: DataFrame  #: (seed_url, data_title)


def directory_run(seeds: DataFrame, pages: DataFrame, signals: DataFrame, **options) -> Run:
    """The whole way for every asked seed (seed_url, start_page, end_page): resolve it, read its directory, keep its pages.

    Seeds that lead to the same directory share its analysis, those that ask for the same of its pages also their entries.  Page
    ranges hold for every kind of source.
    ``options`` go to ``directory_candidates``.
    """
    hops = cut_lineage(crawl.seed_hops(pages, signals))
    resolved = crawl.resolve_seeds(seeds.select("seed_url").distinct(), hops)
    asked = seeds.select("seed_url", "start_page", "end_page").dropDuplicates(["seed_url"]).join(resolved.hint("merge"), "seed_url", "left")
    asked = asked.join(hops.select(F.col("url").alias("resolved_url"), F.lit(True).alias("held")).hint("merge"), "resolved_url", "left")
    empty = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1)) > F.col("end_page")
    refused = F.when(F.col("held").isNull(), UNKNOWN).when(empty, EMPTY_RANGE)
    first = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1)).alias("start_page")
    asked = asked.withColumn("refused", refused)
    asked = cut_lineage(asked.withColumn("share", F.when(F.col("refused").isNull(), F.to_json(F.struct("resolved_url", first, "end_page")))))
    good = asked.filter("refused IS NULL")
    none = F.lit(None).cast("int")
    places = cut_lineage(good.select(F.col("resolved_url").alias("seed_url")).distinct().withColumns({"start_page": none, "end_page": none}))
    candidates = cut_lineage(directory_candidates(places, pages, signals, **options))
    shares = cut_lineage(good.select(F.col("share").alias("seed_url"), "resolved_url", first, "end_page").distinct())
    mine = shares.select("seed_url", "resolved_url").hint("merge").join(candidates.withColumnRenamed("seed_url", "resolved_url"), "resolved_url").drop("resolved_url")
    limits = shares.select("seed_url", "start_page", "end_page", none.alias("max_pages"))
    kept = cut_lineage(page_range(mine, limits.hint("merge"))[0])
    entries = cut_lineage(directory_entries(kept))
    counts = entries.groupBy(F.col("seed_url").alias("share")).agg(F.count("*").alias("entries"))
    outcomes = asked.join(counts.hint("merge"), "share", "left").select(
        "seed_url", "resolved_url", F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("refused", F.when(F.col("entries").isNull(), NO_ENTRIES)).alias("error"))

    def of_seeds(rows: DataFrame) -> DataFrame:
        """Rows of a share for each of its seeds."""
        found = good.select("seed_url", "share").hint("merge").join(rows.withColumnRenamed("seed_url", "share"), "share")
        return found.select("seed_url", *(c for c in rows.columns if c != "seed_url"))

    return Run(of_seeds(entries), outcomes, of_seeds(data_titles(kept)))
