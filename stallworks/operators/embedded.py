"""Companies in embedded data: candidates from flat rows, joins for references, best source per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.functions.binding import let
from stallworks.operators.entries import entry_key, first_per_key, number_rows
from stallworks.session import cut_lineage


def _first(leaves: Column, keep, value) -> Column:
    found = F.filter(F.transform(F.filter(leaves, keep), value), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def candidate_fields(rows: DataFrame, seed: str = "url") -> DataFrame:
    """Name, profile address and website of each object, from its leaves."""
    seed_col = F.col(seed)
    last = lambda leaf: F.element_at(leaf["path"], -1)
    name = _first(
        F.col("leaves"),
        lambda l: T.is_one_of(last(l), rules.NAME_KEYS) & T.is_companyish(l["value"]),
        lambda l: T.normalize_text(l["value"]),
    )
    profile = _first(
        F.col("leaves"),
        lambda l: T.is_one_of(last(l), rules.PROFILE_URL_KEYS),
        lambda l: let(U.resolve_url(seed_col, l["value"]), lambda u: F.when(U.same_site(u, seed_col), u)),
    )
    website = _first(
        F.col("leaves"),
        lambda l: T.is_one_of(last(l), rules.WEBSITE_KEYS) | F.exists(l["path"], lambda p: p.contains("website")),
        lambda l: let(U.resolve_url(seed_col, l["value"]), lambda u: F.when(S.plausible_website(u, seed_col), u)),
    )
    return rows.withColumns({"company_name": name, "profile_url": profile, "website_url_hint": website})


def build_candidates(rows: DataFrame) -> DataFrame:
    """Objects that name a company and lead somewhere."""
    fields = candidate_fields(rows).filter("company_name <> ''")
    app_profile = (
        (F.col("profile_url") == "")
        & U.host_key("url").contains("swapcard.com")
        & (F.col("event_slug") != "")
        & (T.normalize_text("item_id") != "")
        & T.canonical_label("typename").contains("exhibitor")
    )
    profile = F.when(
        app_profile, U.app_profile_url("url", F.col("event_slug"), T.normalize_text("item_id"))
    ).otherwise(F.col("profile_url"))
    return fields.withColumn("profile_url", profile).filter("profile_url <> '' OR website_url_hint <> ''")


def resolve_state_refs(state: DataFrame) -> DataFrame:
    """Objects that the lists of a normalised cache refer to: self join of its nodes by reference."""
    refs = state.filter("kind = 'ref'").select("url", "source", "seq", F.col("ref").alias("node"), "event_slug", "titles")
    nodes = state.filter("kind = 'node'").select("url", "source", "node", "typename", "item_id", "leaves")
    return refs.join(nodes, ["url", "source", "node"])


def state_candidates(state: DataFrame) -> DataFrame:
    """Candidates of the state objects: listed in a cache, else typed nodes of it; then named lists.

    All objects go through one projection, which is written down, since three
    steps read it.
    """
    columns = ["url", "source", "seq", "kind", "typename", "item_id", "leaves", "event_slug", "titles"]
    held = resolve_state_refs(state).withColumn("kind", F.lit("held")).select(*columns)
    typed = (F.col("kind") != "node") | T.contains_any(T.canonical_label("typename"), rules.COMPANY_TYPE_WORDS)
    rows = state.filter("kind <> 'ref'").select(*columns).unionByName(held).filter(typed)
    built = cut_lineage(
        build_candidates(rows).select(
            "url", "source", "seq", "kind", "company_name", "profile_url", "website_url_hint", "titles"
        )
    )
    served = built.filter("kind = 'held'").select("url", "source", F.lit("node").alias("kind")).distinct()
    return built.join(served, ["url", "source", "kind"], "left_anti").withColumn(
        "stage", F.when(F.col("kind") == "listed", 1).otherwise(0)
    )


def embedded_entries(state: DataFrame, smallest: int = rules.MIN_EMBEDDED) -> DataFrame:
    """Entries of the state object with most of them, per page, and its title."""
    candidates = state_candidates(state).select(
        "url", "source", "stage", "seq", "company_name", "profile_url", "website_url_hint", "titles"
    ).withColumn("entry_key", entry_key())
    first = first_per_key(candidates, ["url", "source", "entry_key"], ["stage", "seq"])
    sizes = first.groupBy("url", "source").agg(F.count("*").alias("n"))
    best = sizes.groupBy("url").agg(F.max(F.struct("n", (-F.col("source")).alias("s"))).alias("b")).filter(
        F.col("b.n") >= smallest
    )
    kept = first.join(best.select("url", (-F.col("b.s")).alias("source")), ["url", "source"], "left_semi")
    titled = kept.withColumn("data_title", F.coalesce(T.best_conference_text(F.col("titles")), F.lit("")))
    chunked = titled.withColumn("chunk", F.floor(F.col("seq") / 4096))
    return number_rows(chunked, "url", ["stage", "chunk"], ["seq", "entry_key"], "ord").select(
        "url", "company_name", "profile_url", "website_url_hint", "ord", "data_title"
    )


def gallery_candidates(items: DataFrame) -> DataFrame:
    """Website and name of each gallery item that links to a company."""
    website = F.get(
        F.filter(
            F.transform("targets", lambda t: U.resolve_url(F.col("url"), t)), lambda u: S.plausible_website(u, F.col("url"))
        ),
        F.lit(0),
    )
    linked = items.withColumn("website_url_hint", website).filter("website_url_hint IS NOT NULL")
    raw = F.array(
        T.normalize_text("title"), T.normalize_text("alt"), T.clean_media_stem("file_name"),
        U.infer_name_from_url("website_url_hint"), T.clean_media_stem("name"),
    )
    names = F.filter(
        F.transform(raw, T.clean_company_name),
        lambda n: (n != "") & ~T.is_machine_name(n) & ~F.lower(n).startswith("http"),
    )
    return linked.withColumn("company_name", F.coalesce(F.get(names, F.lit(0)), F.lit("")))


def gallery_entries(items: DataFrame) -> DataFrame:
    """Entries of the best gallery of each page."""
    linked = cut_lineage(gallery_candidates(items))  # read for the scores and for the entries
    named = F.col("company_name") != ""
    scores = linked.groupBy("url", "gallery_no").agg(
        F.count("*").alias("external_links"),
        F.count_if(named).alias("candidates"),
        F.countDistinct(F.when(named, F.col("website_url_hint"))).alias("distinct_entries"),
        F.max("item_count").alias("item_count"),
    )
    scores = scores.filter("external_links >= 3 AND candidates >= 3 AND distinct_entries >= 3 AND item_count >= 3")
    score = F.col("external_links") * 8 + F.col("candidates") * 4 + F.when(
        F.col("external_links") / F.col("item_count") > 0.7, 40
    ).otherwise(0)
    best = scores.groupBy("url").agg(F.max_by("gallery_no", F.struct(score, -F.col("gallery_no"))).alias("gallery_no"))
    rows = linked.filter(named).join(best, ["url", "gallery_no"], "left_semi")
    return first_per_key(
        rows.select("url", "website_url_hint", "company_name", F.col("item_no").alias("ord")),
        ["url", "website_url_hint"], ["ord"],
    ).withColumn("profile_url", F.lit(""))
