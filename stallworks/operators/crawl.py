"""Which pages belong to a directory: the crawl as joins over page and link tables.

``seeds`` (seed_url, ...), ``pages`` (url, html), ``signals`` (one row per url).
A page list is (seed_url, directory_page, page_url).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.operators import listing
from stallworks.operators.entries import number_rows, same_url_set, stall_cut
from stallworks.session import cut_lineage, shared_folder
from stallworks.sources import pages as P, signals as G

PAGE_LIST = ["seed_url", "directory_page", "page_url"]


def listing_key(url: Column | str) -> Column:
    """What all pages of one listing share, however they are numbered."""
    series = U.page_series(url)
    return F.to_json(
        F.struct(series["host"], F.regexp_replace(series["path"], r"(?:/page/\{page\})?/*$", "").alias("path"), series["params"])
    )


def page_rows(seeds: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of all pages that may belong to the listing of a seed: one equi join.

    Every way of numbering pages stays inside this table, so each page is
    analysed once, whatever steps ask for it later.  ``signals`` may bring the column ``listing``.
    """
    keyed = seeds.select("seed_url", listing_key("seed_url").alias("listing"))
    known = signals if "listing" in signals.columns else signals.withColumn("listing", listing_key("url"))
    return keyed.join(known, "listing").drop("listing")


# --- from the asked address to the directory itself --------------------------


def best_iframe(pages: DataFrame) -> DataFrame:
    """Frame that most likely holds the directory, per page."""
    scored = P.frame_scores(P.iframes(pages))
    return scored.groupBy("url").agg(F.max_by("src", F.struct("score", -F.col("pos"))).alias("frame_url"))


LEAST_PROMISE, SAME_SITE = 60, 20.0


def may_promise(anchor: Column) -> Column:
    """Could this bare anchor be a page's best directory link?  Labels tell more than they cost, addresses do not."""
    title, label = anchor["title_attr"], anchor["aria_label"]
    # no label without one of these words has points enough
    worded = F.lower(F.concat_ws(" ", anchor["text"], title, label)).rlike(U.any_of(["participating", *rules.DISCOVERY_WORDS]))
    scores = [S.discovery_label_score(c) for c in (T.display_text(anchor["text"], title, label), title, label)]
    return worded & (F.greatest(*scores) >= LEAST_PROMISE - SAME_SITE)


def best_directory_link(links: DataFrame) -> DataFrame:
    """Link whose label best promises the directory of participants, per page."""
    labels = [S.discovery_label_score(c) for c in ("display_text", "title_attr", "aria_label")]
    current = U.normalize_http_url("url")
    score = F.greatest(*labels) + F.when(F.col("absolute_url") == current, -10.0).when(
        U.same_site("absolute_url", "url"), SAME_SITE
    ).otherwise(0.0)
    # links without a score come last; a filter on the score would work it out twice
    scored = links.filter(~U.looks_like_asset("absolute_url")).withColumn("score", score)
    best = scored.groupBy("url").agg(
        F.max(F.struct("score", (-F.col("ord")).alias("place"), "absolute_url")).alias("best")
    )
    return best.filter(F.col("best.score") >= LEAST_PROMISE).select("url", F.col("best.absolute_url").alias("link_url"))


def seed_hops(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """Per page: is it a platform page, and where else may the directory be."""
    fixed = P.platform("url", "html").isin("mapyourshow", "expofp")
    return (
        pages.select("url", fixed.alias("is_platform"))
        .join(best_iframe(pages).hint("merge"), "url", "left")
        .join(best_directory_link(G.anchors(signals, worth=may_promise)).hint("merge"), "url", "left")
    )


def _ends(moves: DataFrame) -> DataFrame:
    """(url, to) -> (url, to, moving): where each page's chain of moves leads, by doubling the length of its jumps.

    After k rounds a jump spans 2^k moves, and chains that have ended take no part any more.  Where a round leads the others to
    as many pages as the round before, these pages are their own targets, hence circles: ``moving`` marks the chains that run into them.
    So the longest way to an end or into a circle and once around it sets the number of rounds, not the number of pages.
    Addresses compress so well that Spark would take tables of pages for small ones and send them through the driver: joins on them are merged.
    """
    jumps, reached = moves.select("url", "to", F.lit(True).alias("moving")), None
    while True:
        ahead = jumps.select(F.col("url").alias("to"), F.col("to").alias("further"), F.col("moving").alias("on"))
        farther = jumps.filter("moving").join(ahead.hint("merge"), "to", "left").select(
            "url", F.coalesce("further", "to").alias("to"), F.coalesce("on", F.lit(False)).alias("moving"))
        jumps = cut_lineage(farther.unionByName(jumps.filter("NOT moving")))
        before, reached = reached, jumps.filter("moving").select("to").distinct().count()
        if reached in (0, before):
            return jumps


def resolve_seeds(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """Follow frames and directory links until nothing new is found; (seed_url, resolved_url).

    Every page has one move: to its frame, else along its directory link; platform pages and pages whose target the snapshot
    lacks have none.  Jumps over moves are doubled for all pages at once, so a chain of n pages takes log2(n) rounds.
    A chain that runs into a circle ends on the page from which it would come back to the circle's first page.
    """
    known = hops.select("url", "is_platform", *(F.when(F.col(c) != F.col("url"), F.col(c)).alias(c) for c in ("frame_url", "link_url")))
    target = F.when(~F.col("is_platform"), F.coalesce("frame_url", "link_url"))
    second = F.when(F.col("link_url") != F.col("frame_url"), F.col("link_url"))
    moves = known.select("url", target.alias("to"), second.alias("second")).filter("to IS NOT NULL")
    moves = cut_lineage(moves.join(hops.select(F.col("url").alias("to")).hint("merge"), "to", "left_semi"))
    start = seeds.select("seed_url", U.normalize_http_url("seed_url").alias("url"))
    ends = _ends(moves)
    circle = cut_lineage(ends.filter("moving").select(F.col("to").alias("url")).distinct())
    if circle.isEmpty():
        return start.join(ends.hint("merge"), "url", "left").select("seed_url", F.coalesce("to", "url").alias("resolved_url"))
    # pages of circles end the chains that lead to them; the page before the first one met is the last of the chain
    ended, caught = ends.filter("NOT moving"), ends.filter("moving").select("url").distinct().join(circle.hint("merge"), "url", "left_anti")
    outside = moves.join(caught.hint("merge"), "url", "left_semi")
    into = ended.unionByName(_ends(outside)).select("url", F.col("to").alias("first")).unionByName(circle.withColumn("first", F.col("url")))
    before = moves.join(circle.hint("merge"), "url", "left_semi").select(F.col("to").alias("first"), F.col("url").alias("last"), "second")
    found = cut_lineage(start.join(into.hint("merge"), "url", "left").join(before.hint("merge"), "first", "left").select(
        "seed_url", F.coalesce("last", "first", "url").alias("resolved_url"), F.coalesce(F.col("second").isNotNull(), F.lit(False)).alias("open")))
    left = found.filter("open").select("seed_url")
    settled = found.filter("NOT open").select("seed_url", "resolved_url")
    return settled if left.isEmpty() else settled.unionByName(_resolve_by_steps(left, hops))


def _resolve_by_steps(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """Hop by hop with the visited pages at hand, for chains that may leave a circle by their second choice."""
    known = hops.select(F.col("url").alias("current_url"), "is_platform", "frame_url", "link_url")
    state = seeds.select("seed_url", U.normalize_http_url("seed_url").alias("current_url")).withColumn(
        "visited", F.array("current_url")
    )
    state = cut_lineage(state.join(known, "current_url", "left"))
    resting = []
    while True:
        frame, link = F.col("frame_url"), F.col("link_url")
        fresh = lambda u: u.isNotNull() & ~F.array_contains("visited", F.coalesce(u, F.lit("")))
        target = F.when(~F.coalesce("is_platform", F.lit(True)), F.when(fresh(frame), frame).when(fresh(link), link))
        ahead = hops.select(
            F.col("url").alias("target"), F.col("is_platform").alias("p2"), F.col("frame_url").alias("f2"),
            F.col("link_url").alias("l2"),
        )
        state = cut_lineage(state.withColumn("target", target).join(ahead, "target", "left"))
        moved = F.col("p2").isNotNull()
        resting.append(state.filter(~moved).select("seed_url", "current_url"))
        state = state.filter(moved)
        if state.isEmpty():
            break
        pick = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old)
        state = state.select(
            "seed_url", pick("target", "current_url"),
            F.when(moved, F.concat("visited", F.array("target"))).otherwise(F.col("visited")).alias("visited"),
            pick("p2", "is_platform"), pick("f2", "frame_url"), pick("l2", "link_url"),
        )
    return reduce(DataFrame.unionByName, resting).withColumnRenamed("current_url", "resolved_url")


# --- links between the pages of one listing -----------------------------------


def pagination_edges(links: DataFrame) -> DataFrame:
    """Links that may lead to another page of a listing: (src_url, dst_url, series, page_no)."""
    number = U.page_number("absolute_url")
    label = F.lower("display_text")
    worded = label.isin(rules.PAGINATION_TEXTS) | label.rlike(r"^\p{Nd}+$")
    rows = links.filter(F.col("absolute_url") != F.col("url")).withColumn("page_no", number)
    return (
        rows.filter(F.col("page_no").isNotNull() | worded)
        .select(
            F.col("url").alias("src_url"), F.col("absolute_url").alias("dst_url"),
            F.to_json(U.page_series("absolute_url")).alias("series"), "page_no",
        )
        .distinct()
    )


def pagination_links(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Pagination links on the seed pages, in page order."""
    series = F.to_json(U.page_series("seed_url"))
    return seeds.select("seed_url", series.alias("series")).join(
        edges.withColumnRenamed("src_url", "seed_url"), ["seed_url", "series"]
    ).select("seed_url", "dst_url", "page_no")


SLOTS, MERGE = 32, 8


class _Visited:
    """Pages seen so far, by slots of their seed: the newest rounds as tables of their own, older ones appended to one folder."""

    def __init__(self, spark) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.recent: list[DataFrame] = []
        self.schema = None

    def add(self, rows: DataFrame) -> None:
        self.recent.append(rows)
        if len(self.recent) > MERGE:
            older = reduce(DataFrame.unionByName, self.recent)
            self.schema = older.schema
            older.repartition("slot").write.mode("append").partitionBy("slot").parquet(self.folder)
            self.recent = []

    def of(self, slots: list[int] | None = None) -> DataFrame:
        """Pages of the seeds of some slots; only their folders are read."""
        parts = list(self.recent)
        if self.schema is not None:
            parts.append(self.spark.read.schema(self.schema).parquet(self.folder).select(*self.schema.names))
        rows = reduce(DataFrame.unionByName, parts)
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))


def crawl_reachable(
    seeds: DataFrame, edges: DataFrame, known: DataFrame, max_pages: int | None = None
) -> DataFrame:
    """Breadth-first walk along pagination links, all seeds at once; a page list.

    Visit order is (level, parent's place, page number, address); where
    ``max_pages`` is asked for, the first in that order are kept.  Each round joins the newest pages with their links, and what
    is found with the visited pages of those seeds only that still move; it is written down before the next one
    starts, so neither plans nor scans grow with the rounds of other seeds, and a lost executor costs one round.  Only pages that
    the snapshot holds (``known``: url) are visited.
    """
    slot = F.pmod(F.xxhash64("seed_url"), F.lit(SLOTS)).cast("int").alias("slot")
    frontier = seeds.select(
        "seed_url", F.col("seed_url").alias("page_url"), F.to_json(U.page_series("seed_url")).alias("series"),
        F.lit(1).cast("bigint").alias("place"), slot,
    )
    frontier = cut_lineage(frontier.join(known.withColumnRenamed("url", "page_url"), "page_url", "left_semi"))
    usable = cut_lineage(
        edges.join(known.withColumnRenamed("url", "dst_url"), "dst_url", "left_semi")
        .withColumnRenamed("src_url", "page_url")
    )
    visited = _Visited(seeds.sparkSession)
    visited.add(frontier)
    while True:
        active = [r.slot for r in frontier.select("slot").distinct().collect()]  # at most SLOTS
        if not active:
            break
        found = frontier.join(usable, ["page_url", "series"])
        order = F.struct(F.col("place").alias("parent"), F.coalesce("page_no", F.lit(10**9)).alias("page_no"))
        firsts = found.groupBy("seed_url", "series", "slot", F.col("dst_url").alias("new_url")).agg(F.min(order).alias("order"))
        firsts = firsts.select("seed_url", "series", "slot", F.col("new_url").alias("page_url"), "order.*").join(
            visited.of(active).select("seed_url", "page_url"), ["seed_url", "page_url"], "left_anti"
        )
        # places are dense, so the last of a seed's newest pages tells how many it has
        sizes = frontier.groupBy("seed_url").agg(F.max("place").alias("size"))
        ranked = number_rows(firsts, "seed_url", ["parent"], ["page_no", "page_url"], "n").join(sizes, "seed_url")
        ranked = ranked.withColumn("place", (F.col("size") + F.col("n") + 1).cast("bigint"))
        if max_pages is not None:
            ranked = ranked.filter(F.col("place") <= max_pages)
        frontier = cut_lineage(ranked.select("seed_url", "page_url", "series", "place", "slot"))
        visited.add(frontier)
    number = F.coalesce(U.page_number("page_url"), F.col("place"))
    return visited.of().select("seed_url", number.cast("bigint").alias("directory_page"), "page_url", "place")


# --- numbered pages -------------------------------------------------------------


def query_param_votes(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """The page parameter of a listing: the seed's own, else the most frequent in its links."""
    first_own = F.get(F.filter(U.query_pairs("seed_url"), lambda p: U.is_page_param(p["key"])), F.lit(0))["key"]
    votes = (
        links.select(F.col("url").alias("seed_url"), "absolute_url", "ord")
        .filter(U.same_site("absolute_url", "seed_url"))
        .select("seed_url", "ord", F.posexplode(U.query_pairs("absolute_url")).alias("pos", "pair"))
        .filter(U.is_page_param("pair.key") & F.col("pair.value").rlike(r"^\d+$"))
        .groupBy("seed_url", F.col("pair.key").alias("param"))
        .agg(F.count("*").alias("votes"), F.min(F.struct("ord", "pos")).alias("first"))
    )
    best = votes.groupBy("seed_url").agg(
        F.max_by("param", F.struct("votes", -F.col("first.ord"), -F.col("first.pos"))).alias("voted")
    )
    return (
        seeds.select("seed_url", first_own.alias("own"))
        .join(best, "seed_url", "left")
        .select("seed_url", F.coalesce("own", "voted").alias("param"))
        .filter("param IS NOT NULL")
    )


def max_linked_page(links: DataFrame) -> DataFrame:
    return links.groupBy("url").agg(F.coalesce(F.max(U.page_number("absolute_url")), F.lit(1)).alias("max_page"))


def page_url_patterns(seeds: DataFrame) -> DataFrame:
    """Ways in which a seed may address its pages, in the order to try: (seed_url, priority, param)."""
    own = F.filter(U.query_pairs("seed_url"), lambda p: U.is_page_param(p["key"]))
    numeric = F.filter(own, lambda p: p["value"].rlike(r"^\d+$"))
    known = F.coalesce(F.get(numeric, F.lit(0))["key"], F.try_element_at(own, F.lit(-1))["key"])
    common = F.array(*[F.lit(p) for p in rules.PAGE_PARAMS])
    patterns = F.when(known.isNull(), common).otherwise(
        F.concat(F.array(known), F.filter(common, lambda p: p != known))
    )
    return seeds.select("seed_url", F.posexplode(F.concat(patterns, F.array(F.lit("/page/{n}")))).alias("priority", "param"))


def page_url(param: Column, number: Column) -> Column:
    return F.when(param == "/page/{n}", U.path_page_url("seed_url", number)).otherwise(
        U.query_page_url("seed_url", param, number)
    )


def entries_of(page_list: DataFrame, candidates: DataFrame, strategies: DataFrame) -> DataFrame:
    """Entries that the chosen strategy of each seed finds on the listed pages."""
    listed = page_list.join(candidates, ["seed_url", "page_url"])
    return listing.matching_entries(listed, strategies).withColumnRenamed("url", "profile_url")


def _range_end(total: Column) -> tuple[Column, Column]:
    start = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1))
    return start, F.least(F.coalesce("end_page", total), total)


def explicit_pages(
    seeds: DataFrame, pages: DataFrame, known: DataFrame, candidates: DataFrame, strategies: DataFrame,
    seed_entries: DataFrame,
) -> DataFrame:
    """Page lists of seeds that state their total: by the first pattern whose page 2 lists other companies.

    ``seeds`` has start_page and end_page (NULL where not asked).
    """
    totals = pages.select(F.col("url").alias("seed_url"), P.total_pages("html").alias("total")).filter("total > 1")
    stated = cut_lineage(seeds.join(totals, "seed_url"))
    patterns = page_url_patterns(stated).withColumn("page_url", page_url(F.col("param"), F.lit(2)))
    # every pattern is probed as a seed of its own, so that one pass serves all
    probes = patterns.select("seed_url", F.col("priority").alias("directory_page"), "page_url")
    found = entries_of(probes, candidates, strategies).select(
        F.struct("seed_url", F.col("directory_page").alias("priority")).alias("probe"), "profile_url"
    )
    tried = found.select("probe").distinct()
    expected = tried.withColumn("seed_url", F.col("probe.seed_url")).join(
        seed_entries.select("seed_url", "profile_url"), "seed_url"
    ).select("probe", "profile_url")
    verdict = same_url_set(found, expected, key="probe").filter("n_a > 0 AND NOT same_set")
    best = verdict.groupBy(F.col("probe.seed_url").alias("seed_url")).agg(F.min("probe.priority").alias("priority"))
    # pages behind the last one that the snapshot may hold are all empty
    held = page_rows(stated, known).groupBy("seed_url").agg(
        F.greatest(F.coalesce(F.max(U.page_number("url")), F.lit(1)), F.count("*")).alias("last_page"))
    stated = stated.join(held, "seed_url", "left").withColumn("total", F.least("total", F.coalesce("last_page", F.lit(1))))
    start, end = _range_end(F.col("total"))
    numbered = (
        stated.join(best, "seed_url")
        .join(patterns.select("seed_url", "priority", "param"), ["seed_url", "priority"])
        .filter(start <= end)
        .select("seed_url", "param", F.explode(F.sequence(start.cast("bigint"), end.cast("bigint"))).alias("directory_page"))
    )
    addressed = numbered.select(
        "seed_url", "directory_page", page_url(F.col("param"), F.col("directory_page")).alias("page_url")
    )
    return first_page_is_seed(addressed, known)


def first_page_is_seed(page_list: DataFrame, known: DataFrame) -> DataFrame:
    """The page with the seed's own number is the seed; so is page 1 of a seed without
    number, where the snapshot has no other first page."""
    held = known.select(F.col("url").alias("page_url"), F.lit(True).alias("held"))
    is_seed = (U.page_number("seed_url") == F.col("directory_page")) | (
        (F.col("directory_page") == 1) & F.col("held").isNull() & U.page_number("seed_url").isNull()
    )
    return page_list.join(held, "page_url", "left").select(
        "seed_url", "directory_page",
        F.when(F.coalesce(is_seed, F.lit(False)), F.col("seed_url")).otherwise(F.col("page_url")).alias("page_url"),
    )


def query_probe_pages(seeds: DataFrame, params: DataFrame, known: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Numbered pages of seeds with a page parameter, whether the snapshot holds them or not.

    Numbers behind the last page that the snapshot holds of a listing are left
    out: those pages are all empty.
    """
    last = page_rows(seeds.join(params, "seed_url", "left_semi"), known).groupBy("seed_url").agg(
        F.coalesce(F.max(U.page_number("url")), F.lit(1)).alias("last_page")
    )
    start = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1)).cast("bigint")
    asked = F.coalesce("end_page", F.lit(max_pages)).cast("bigint")
    end = F.least(asked, F.coalesce("last_page", F.lit(1)))  # least() skips NULL
    rows = (
        seeds.join(params, "seed_url")
        .join(last, "seed_url", "left")
        .filter(start <= end)
        .select("seed_url", "param", F.explode(F.sequence(start, end)).alias("directory_page"))
        .withColumn("page_url", U.query_page_url("seed_url", F.col("param"), F.col("directory_page")))
    )
    return first_page_is_seed(rows.select("seed_url", "directory_page", "page_url"), known)


def query_probe(page_list: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of numbered pages up to the second page in a row without news."""
    every_page = page_list.select("seed_url", "directory_page", "page_url").join(
        entries.drop("page_url"), ["seed_url", "directory_page"], "left"
    )
    return stall_cut(every_page).filter("profile_url IS NOT NULL")


def table_pages(seeds: DataFrame, links: DataFrame, params: DataFrame, edges: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of seeds in table mode: by page parameter, else by the numbered links of the seed page."""
    linked = max_linked_page(links).withColumnRenamed("url", "seed_url")
    start = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1)).cast("bigint")
    last = F.coalesce("max_page", F.lit(1)).cast("bigint")
    asked = F.least(F.coalesce(F.col("end_page").cast("bigint"), last), start + F.lit(max_pages).cast("bigint") - 1)
    end = F.when(last > 1, F.least(asked, last)).otherwise(asked)
    rows = (
        seeds.join(linked, "seed_url", "left")
        .filter(start <= end)
        .select("seed_url", F.explode(F.sequence(start, end)).alias("directory_page"))
        .join(params, "seed_url", "left")
    )
    numbered = pagination_links(seeds, edges).groupBy("seed_url", F.col("page_no").alias("directory_page")).agg(
        F.min("dst_url").alias("linked_url")
    )
    rows = rows.join(numbered, ["seed_url", "directory_page"], "left")
    target = F.when(F.col("directory_page") == 1, F.col("seed_url")).otherwise(
        F.coalesce(U.query_page_url("seed_url", F.col("param"), F.col("directory_page")), "linked_url")
    )
    return rows.withColumn("page_url", target).select(*PAGE_LIST)


def until_empty(page_list: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the pages before the first page (after page 1) that has none."""
    filled = entries.select("seed_url", "directory_page").distinct().withColumn("filled", F.lit(True))
    empty = (
        page_list.join(filled, ["seed_url", "directory_page"], "left")
        .filter("filled IS NULL AND directory_page > 1")
        .groupBy("seed_url")
        .agg(F.min("directory_page").alias("first_empty"))
    )
    return entries.join(empty, "seed_url", "left").filter(
        F.col("first_empty").isNull() | (F.col("directory_page") < F.col("first_empty"))
    ).drop("first_empty")


def paginator_pages(
    seeds: DataFrame, configs: DataFrame, tokens: DataFrame, fragments: DataFrame, signals_of, strategies: DataFrame,
    seed_entries: DataFrame, max_pages: int | None = None,
) -> DataFrame:
    """Entries of scripted paginators.

    ``configs``/``tokens`` are read from the seed pages (url); ``fragments``
    holds the answers (seed_url, page_id, page_offset, data: URL-encoded HTML).
    ``signals_of`` turns (url, html) into signals.  A config counts if its first
    other page lists other companies than the seed page.
    """
    usable = (
        configs.join(tokens.select("url"), "url", "left_semi")
        .withColumnRenamed("url", "seed_url")
        .withColumn("pages", U.ajax_total_pages(F.col("limit"), F.col("total_results")))
        .filter("pages > 1")
        .join(seeds.select("seed_url", "start_page", "end_page"), "seed_url")
    )
    start = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1))
    end = F.least(F.coalesce("end_page", F.col("pages")), F.col("pages"), start + F.lit(max_pages).cast("bigint") - 1)
    usable = cut_lineage(usable.withColumns({"first": start, "last": end}).filter("first <= last"))
    wanted = usable.select(
        "seed_url", "page_id", "script_no", "call_no", "limit", "next_offset", "first", "last",
        F.explode(F.sequence(F.least("first", F.lit(2)), F.greatest("last", F.lit(2)))).alias("directory_page"),
    ).withColumn("page_offset", U.ajax_offset(F.col("limit"), F.col("next_offset"), F.col("directory_page")))
    answers = fragments.select(
        "seed_url", "page_id", "page_offset", F.coalesce(F.try_url_decode(F.replace("data", F.lit("+"), F.lit("%2B"))), "data").alias("html")
    )
    keyed = answers.withColumn("url", F.col("seed_url"))
    keyed = keyed.withColumn("answer", F.to_json(F.struct("seed_url", "page_id", "page_offset")))
    scanned = signals_of(keyed.select(F.col("answer").alias("url"), "html")).withColumnRenamed("url", "answer")
    rows = cut_lineage(
        keyed.select("answer", "seed_url", "page_id", "page_offset")
        .join(scanned, "answer")
        .join(wanted, ["seed_url", "page_id", "page_offset"])
        .withColumn("config", F.struct("script_no", "call_no"))
        .withColumn("url", F.col("seed_url"))
    )
    # one config at a time is a "seed" of the matching step: its pages carry distinct numbers
    numbers = rows.select("seed_url", F.col("answer").alias("page_url"), F.struct("config", "directory_page").alias("directory_page"))
    scanned_rows = rows.drop("config", "directory_page").dropDuplicates(["answer"])
    # one row of signals per answer; its address is the seed's, its name the answer's
    candidates = cut_lineage(
        listing.listing_candidates(scanned_rows.withColumn("url", F.col("seed_url")), page=F.col("answer"))
    )
    found = listing.matching_entries(
        numbers.join(candidates, ["seed_url", "page_url"]), strategies
    ).withColumnRenamed("url", "profile_url")
    found = cut_lineage(found.select(
        "seed_url", "page_url", "source_kind", "rank", "name", "profile_url", "first_ord",
        F.col("directory_page.config").alias("config"), F.col("directory_page.directory_page").alias("directory_page"),
    ))
    probe_page = F.when(F.col("first") > 1, F.col("first")).otherwise(2)
    probe = usable.select("seed_url", F.struct("script_no", "call_no").alias("config"), probe_page.alias("directory_page"))
    probed = found.join(probe, ["seed_url", "config", "directory_page"], "left_semi").select(
        F.struct("seed_url", "config").alias("probe"), "profile_url"
    )
    expected = probed.select("probe").distinct().withColumn("seed_url", F.col("probe.seed_url")).join(
        seed_entries.select("seed_url", "profile_url"), "seed_url"
    ).select("probe", "profile_url")
    good = same_url_set(probed, expected, key="probe").filter("n_a > 0 AND NOT same_set")
    best = good.groupBy(F.col("probe.seed_url").alias("seed_url")).agg(F.min("probe.config").alias("config"))
    limits = usable.select("seed_url", F.struct("script_no", "call_no").alias("config"), "first", "last")
    chosen = best.join(limits, ["seed_url", "config"])
    later = found.filter("directory_page > 1").join(chosen, ["seed_url", "config"]).filter(
        "directory_page BETWEEN first AND last"
    )
    columns = ["seed_url", "page_url", "source_kind", "rank", "name", "profile_url", "first_ord"]
    number = F.col("directory_page").cast("bigint").alias("directory_page")
    first_page = seed_entries.join(chosen.filter("first = 1"), "seed_url").select(
        *columns, F.lit(1).cast("bigint").alias("directory_page")
    )
    return first_page.unionByName(later.select(*columns, number))
