"""Data embedded in pages or delivered beside them: state objects, galleries, platform payloads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.session import cut_lineage
from stallworks.sources import json_walk
from stallworks.sources.signals import ROWS_PER_BATCH

STATE_NODES = "url string, source int, no int, parent int, key string, kind string, text string, size int"
LEAVES = "url string, no int, path array<string>, members int, text string"
NEXT_DATA = r"""(?is)<script[^>]+\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
WARMUP_DATA = r"""(?is)<script[^>]+\bid=["']wix-warmup-data["'][^>]*>(.*?)</script>"""
SEARCH_PAYLOAD = (
    "DATA struct<results struct<exhibitor struct<found bigint, "
    "hit array<struct<fields struct<exhid_l string, exhname_t string>>>>>>"
)
FLOORPLAN_PAYLOAD = "title string, exhibitors array<struct<name string, externalId string, id string>>"


def _map(df: DataFrame, ddl: str, rows_of) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                rows: list[dict] = []
                for row in rows_of(record):
                    rows.append(row)
                    if len(rows) >= 50 * ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, ddl)


def state_nodes(pages: DataFrame) -> DataFrame:
    """All values of the state objects that a page's scripts hold, one row each.

    Pages without such scripts are dropped before any text goes to Python.
    """
    variables = list(rules.STATE_VARIABLES)
    markers = F.col("html").contains("__NEXT_DATA__")
    for variable in variables:
        markers = markers | F.col("html").contains(variable)
    found = pages.filter(markers).select("url", "html", F.regexp_extract("html", NEXT_DATA, 1).alias("next_data"))

    def rows_of(record: dict) -> Iterator[dict]:
        states = [json_walk.parse(record["next_data"])] if record["next_data"] else []
        states += [json_walk.assigned(record["html"], name) for name in variables]
        for source, data in enumerate(s for s in states if s is not None):
            if isinstance(data, dict):
                for row in json_walk.nodes(data):
                    yield {**row, "url": record["url"], "source": source}

    return _map(found, STATE_NODES, rows_of)


def embedded_state(pages: DataFrame) -> DataFrame:
    """Objects of the state that may be companies, with their fields, and references to such objects.

    (url, source, seq, kind, node, ref, typename, item_id, leaves, event_slug, titles)
    kind ``listed``: object of a list of at least three objects under a list-like
    key, at any depth; ``node``: entry of the normalised cache, named by ``node``;
    ``held`` and ``ref``: object in, and name of an entry in, a list-like
    connection of such an entry.  Every step joins values with what holds them.
    """
    document = ["url", "source"]
    values = cut_lineage(state_nodes(pages).withColumn("list_like", T.contains_any(T.canonical_label("key"), rules.LIST_KEY_WORDS)))

    def inside(owners: DataFrame, *keep: str) -> DataFrame:
        held = owners.select(*document, F.col("no").alias("parent"), *keep)
        return values.drop(*keep).join(held, [*document, "parent"])

    lists = values.filter("kind = 'list' AND list_like AND size >= 3")
    members = inside(lists)
    mixed = members.filter("kind <> 'object'").select(*document, "parent").distinct()
    listed = members.join(mixed, [*document, "parent"], "left_anti").select(*document, "no", F.lit("listed").alias("what"))

    root = values.filter("parent IS NULL")
    outer = inside(root)
    entries = inside(outer.filter("key = 'apolloState' AND kind = 'object'")).filter("kind = 'object'")
    connections = inside(entries).filter("list_like")
    parts = inside(connections.filter("kind = 'object'")).filter("kind = 'list' AND key IN ('nodes', 'edges')")
    by_nodes = parts.filter("key = 'nodes'")
    by_edges = parts.filter("key = 'edges'").join(by_nodes.select(*document, "parent"), [*document, "parent"], "left_anti")
    edge = inside(inside(by_edges).filter("kind = 'object'")).filter("key = 'node'")
    plain = inside(connections.filter("kind = 'list'").unionByName(by_nodes))
    items = cut_lineage(plain.unionByName(edge))
    objects = items.filter("kind = 'object' AND size > 0")
    named = inside(objects).filter("key = '__ref' AND kind = 'text'")
    refs = items.filter("kind = 'text'").select(*document, F.col("no").alias("seq"), F.col("text").alias("ref")).unionByName(
        named.select(*document, F.col("parent").alias("seq"), F.col("text").alias("ref")))
    held = objects.join(named.select(*document, F.col("parent").alias("no")), [*document, "no"], "left_anti").select(
        *document, "no", F.lit("held").alias("what"))
    found = cut_lineage(
        listed.withColumn("node", F.lit("")).unionByName(held.withColumn("node", F.lit("")))
        .unionByName(entries.select(*document, "no", F.lit("node").alias("what"), F.col("key").alias("node"))))

    own = inside(found.select(*document, "no").distinct()).withColumn("owner", F.col("parent"))
    deeper = inside(own.filter("kind = 'object'").withColumn("outer_key", F.col("key")), "owner", "outer_key")
    field = lambda path: F.struct("no", path.alias("path"), F.col("text").alias("value"))
    texts = own.filter("kind = 'text'").select(*document, "owner", field(F.array(T.canonical_key("key"))).alias("leaf")).unionByName(
        deeper.filter("kind = 'text'").select(
            *document, "owner", field(F.array(T.canonical_key("outer_key"), T.canonical_key("key"))).alias("leaf")))
    leaves = texts.groupBy(*document, "owner").agg(F.transform(F.sort_array(F.collect_list("leaf")), lambda l: F.struct(
        l["path"].alias("path"), l["value"].alias("value"))).alias("leaves"))
    scalar = lambda key: F.coalesce(F.max(F.when((F.col("key") == key) & F.col("kind").isin("text", "other"), F.col("text"))), F.lit(""))
    facts = own.groupBy(*document, "owner").agg(scalar("__typename").alias("typename"), scalar("id").alias("id"), scalar("_id").alias("_id"))
    filled = found.withColumnRenamed("no", "owner").join(facts, [*document, "owner"], "left").join(leaves, [*document, "owner"], "left")
    none = F.expr("cast(array() AS array<struct<path:array<string>,value:string>>)")
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = filled.select(
        *document, F.col("owner").alias("seq"), F.col("what").alias("kind"), "node", F.lit("").alias("ref"), blank("typename").alias("typename"),
        F.coalesce(F.nullif("id", F.lit("")), F.col("_id"), F.lit("")).alias("item_id"), F.coalesce("leaves", none).alias("leaves"),
    ).unionByName(refs.select(
        *document, "seq", F.lit("ref").alias("kind"), F.lit("").alias("node"), "ref", F.lit("").alias("typename"), F.lit("").alias("item_id"),
        none.alias("leaves")))
    return rows.join(_state_titles(outer, inside), document, "left").select(
        *rows.columns, blank("event_slug").alias("event_slug"), F.coalesce("titles", F.expr("cast(array() AS array<string>)")).alias("titles"))


def _state_titles(outer: DataFrame, inside) -> DataFrame:
    """(url, source, event_slug, titles) from the outer objects of a state, nearest first, then in the order of the keys."""
    props = inside(outer.filter("key = 'props' AND kind = 'object'"))
    places = [outer, props, inside(props.filter("key = 'pageProps' AND kind = 'object'")), inside(outer.filter("key = 'query' AND kind = 'object'"))]
    rows = reduce(DataFrame.unionByName, [p.withColumn("place", F.lit(k)) for k, p in enumerate(places)])
    rows = rows.filter(F.col("kind").isin("text", "other")).withColumn("value", T.normalize_text("text")).filter("value <> ''")
    rank = lambda keys: F.array_position(F.lit(keys), F.col("key"))
    slug, title = rank(rules.EVENT_SLUG_KEYS), rank(rules.TITLE_KEYS)
    ordered = F.sort_array(F.collect_list(F.when((title > 0) & (F.col("place") < 3), F.struct("place", title.alias("rank"), "value"))))
    return rows.groupBy("url", "source").agg(
        F.min_by(F.when(slug > 0, F.col("value")), F.when(slug > 0, F.struct("place", slug.alias("rank")))).alias("event_slug"),
        F.transform(ordered, lambda t: t["value"]).alias("titles"))


def gallery_items(pages: DataFrame) -> DataFrame:
    """Items of the media galleries that a page was delivered with."""
    found = pages.filter(F.col("html").contains("wix-warmup-data")).select(
        "url", F.regexp_extract("html", WARMUP_DATA, 1).alias("data")
    )

    def rows_of(record: dict) -> Iterator[dict]:
        for row in json_walk.leaves(json_walk.parse(record["data"])):
            yield {**row, "url": record["url"]}

    rows = _map(found, LEAVES, rows_of)
    step = lambda k: F.get("path", F.lit(k))
    rows = rows.filter((step(0) == "appsWarmupData") & step(2).endswith("_galleryData") & (step(3) == "items"))
    rows = rows.select("url", "no", "members", "text", step(1).alias("app"), step(2).alias("gallery"), step(4).cast("int").alias("item_no"),
                       F.array_join(F.slice("path", 6, 8), ".").alias("field"), F.size("path").alias("depth"))
    # galleries of one page, which a document bounds
    lists = rows.filter("depth = 4 AND members IS NOT NULL").select(
        "url", "app", "gallery", F.col("members").alias("item_count"),
        (F.row_number().over(Window.partitionBy("url").orderBy("no")) - 1).alias("gallery_no"))
    field = lambda name: F.coalesce(F.max(F.when(F.col("field") == f"metaData.{name}", F.col("text"))), F.lit(""))
    items = rows.filter("depth > 5").groupBy("url", "app", "gallery", "item_no").agg(
        field("title").alias("title"), field("alt").alias("alt"), field("fileName").alias("file_name"), field("name").alias("name"),
        F.array(*(field(f"link.{k}") for k in ("data.url", "data.href", "data.link", "text"))).alias("targets"))
    return items.join(lists, ["url", "app", "gallery"]).drop("app", "gallery")


def search_payload_entries(payloads: DataFrame) -> DataFrame:
    """Hits of gallery search answers (seed_url, directory_page, body)."""
    parsed = payloads.select("seed_url", "directory_page", F.from_json("body", SEARCH_PAYLOAD).alias("j"))
    hits = parsed.select("seed_url", "directory_page", F.posexplode("j.DATA.results.exhibitor.hit").alias("ord", "hit"))
    rows = hits.select(
        "seed_url", "directory_page", "ord",
        F.trim(F.coalesce("hit.fields.exhid_l", F.lit(""))).alias("exhibitor_id"),
        T.normalize_text(F.coalesce("hit.fields.exhname_t", F.lit(""))).alias("company_name"),
    ).filter("exhibitor_id <> '' AND company_name <> ''")
    return rows.withColumn("profile_url", U.gallery_profile_url("seed_url", "exhibitor_id")).withColumn(
        "website_url_hint", F.lit("")
    ).drop("exhibitor_id")


def search_page_counts(payloads: DataFrame, size: int = rules.GALLERY_PAGE_SIZE) -> DataFrame:
    """Pages per seed by the number of hits that the answers state."""
    found = F.coalesce(F.from_json("body", SEARCH_PAYLOAD)["DATA"]["results"]["exhibitor"]["found"], F.lit(0))
    return payloads.groupBy("seed_url").agg(
        F.greatest(F.lit(1), F.ceil(F.max(found) / size)).cast("int").alias("page_count")
    )


def floorplan_data_urls(pages: DataFrame) -> DataFrame:
    """Where a floor plan page keeps its data file."""
    raw = F.regexp_extract("html", r"""(?i)\bdata-data-url=["']([^"']+)["']""", 1)
    return pages.select("url", U.resolve_url(U.resolve_url("url", raw), F.lit("data.js")).alias("data_url")).filter(
        (raw != "") & F.col("data_url").isNotNull()
    )


def floorplan_payload_entries(payloads: DataFrame) -> DataFrame:
    """Exhibitors of floor plan data files (seed_url, body), with the plan's title."""
    start = "^﻿?\\s*(?:var\\s+|window\\.)?__data\\s*=\\s*"
    body = F.regexp_replace(F.regexp_replace("body", start, ""), r";\s*$", "")
    parsed = payloads.filter(F.col("body").rlike(start)).select(
        "seed_url", F.from_json(body, FLOORPLAN_PAYLOAD).alias("j")
    )
    rows = parsed.select(
        "seed_url", T.normalize_text(F.coalesce("j.title", F.lit(""))).alias("plan_title"),
        F.posexplode("j.exhibitors").alias("ord", "e"),
    ).select(
        "seed_url", "plan_title", "ord",
        T.normalize_text(F.coalesce("e.name", F.lit(""))).alias("company_name"),
        T.normalize_text(F.coalesce(F.nullif("e.externalId", F.lit("")), "e.id", F.lit(""))).alias("exhibitor_id"),
    ).filter("company_name <> '' AND exhibitor_id <> ''")
    return rows.select(
        "seed_url", F.lit(1).alias("directory_page"), "ord", "company_name",
        U.floorplan_profile_url("seed_url", "exhibitor_id").alias("profile_url"), F.lit("").alias("website_url_hint"),
        "plan_title",
    )


def json_leaves(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(path, value) of the scalars in a JSON column down to depth two, without leaving the JVM.

    Each level is a lateral join with the object's own members, not a join of tables.
    """
    spark = df.sparkSession
    parsed = df.select(*keep, F.try_parse_json(column).alias("v0"))

    def members(rows: DataFrame, variant: str, level: int) -> DataFrame:
        inner = spark.tvf.variant_explode(F.col(variant).outer())
        return rows.lateralJoin(inner).filter("key IS NOT NULL").select(
            *rows.columns, T.canonical_key("key").alias(f"key{level}"), F.col("value").alias(f"v{level}")
        )

    def scalars(rows: DataFrame, path, level: int) -> DataFrame:
        nested = F.schema_of_variant(f"v{level}").rlike("^(?:OBJECT|ARRAY)")
        return rows.filter(~nested).select(*keep, path.alias("path"), F.col(f"v{level}").cast("string").alias("value"))

    one = members(parsed, "v0", 1)
    two = members(one, "v1", 2)
    return scalars(one, F.col("key1"), 1).unionByName(scalars(two, F.concat_ws(".", "key1", "key2"), 2))
