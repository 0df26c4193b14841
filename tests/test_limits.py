"""Nothing is cut off by size, repeated addresses count once, and all entities are known."""

import html
import json

import pytest
from pyspark.sql import functions as F

from stallworks import session
from stallworks.functions import text as T
from stallworks.operators import crawl, websites
from stallworks.sinks import payloads as L
from stallworks.sources import pages as P, signals as G


def test_stated_totals_have_no_limit(one):
    rows = one([("totalPages: 6000",), ("no total",)], "html string", P.total_pages("html"))
    assert rows == [(6000,), (None,)]


def test_seeds_follow_long_chains(spark):
    url = "https://a{}.example.com/".format
    hops = [(url(i), False, None, url(i + 1) if i < 7 else None) for i in range(8)]
    hops += [("https://loop.example.com/", False, "https://back.example.com/", None), ("https://back.example.com/", False, None, "https://loop.example.com/")]
    table = spark.createDataFrame(hops, "url string, is_platform boolean, frame_url string, link_url string")
    seeds = spark.createDataFrame([(url(0),), ("https://loop.example.com/",), ("https://unknown.example.com/",)], "seed_url string")
    found = dict(crawl.resolve_seeds(seeds, table).collect())
    assert found == {url(0): url(7), "https://loop.example.com/": "https://back.example.com/",
                     "https://unknown.example.com/": "https://unknown.example.com/"}


def test_numbered_pages_have_no_limit(spark):
    pages = [("https://a.example.com/list" + (f"?page={i}" if i > 1 else ""),) for i in range(1, 401)]
    known = spark.createDataFrame(pages, "url string")
    seeds = spark.createDataFrame([("https://a.example.com/list", None, None)], "seed_url string, start_page int, end_page int")
    params = spark.createDataFrame([("https://a.example.com/list", "page")], "seed_url string, param string")
    assert crawl.query_probe_pages(seeds, params, known).count() == 400
    assert crawl.query_probe_pages(seeds, params, known, max_pages=10).count() == 10


def test_repeated_addresses_count_once(spark, tmp_path):
    rows = [(1, "https://a.example.com/co/1", "short"), (2, "https://a.example.com/co/1#top", "longer text"), (3, "https://a.example.com/co/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/p")
    held = {r.url: r.html for r in P.read_pages(spark, f"{tmp_path}/p").collect()}
    assert held == {"https://a.example.com/co/1": "longer text", "https://a.example.com/co/2": None}
    plan = P.read_pages(spark, f"{tmp_path}/p")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or all("html" not in line for line in plan.splitlines() if "Exchange" in line)
    entries = spark.createDataFrame(
        [("s", "Acme", "https://a.example.com/co/1", "")], "seed_url string, company_name string, profile_url string, website_url_hint string")
    sites = spark.createDataFrame([("https://a.example.com/co/1", "https://acme.com/")] * 2, "profile_url string, website_url string")
    records = websites.resolve_profiles(entries, sites)
    assert records.count() == 1 and records.first().website_url == "https://acme.com/"
    blank = records.withColumn("website_url", F.lit(""))
    rendered = sites.union(spark.createDataFrame([("https://a.example.com/co/1", "")], sites.schema))
    assert [r.website_url for r in websites.resolve_blank_from_rendered(blank, rendered).collect()] == ["https://acme.com/"]


@pytest.mark.parametrize("text", [
    "M&uuml;ller &#8211; Sohn &#x2019;x", "a &amp;lt; b", "R&D &copy 2020 &unknown; &#150; &#0; &#xD800; &#99999999999; &NotEqualTilde; &", "plain", "",
])
def test_entities(one, text):
    assert one([(text,)], "t string", T.unescape("t")) == [(html.unescape(text),)]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_state_objects_at_any_depth(spark):
    import json

    from stallworks.sources import embedded

    people = [{"name": f"Maker {i}", "id": i, "about": {"website": f"https://m{i}.com"}, "tags": ["x"]} for i in range(3)]
    deep: object = {"exhibitors": people}
    for level in range(9):
        deep = {f"k{level}": [deep]} if level % 2 else {f"k{level}": deep}
    cache = {
        "Root": {"exhibitors": {"nodes": ["E:1", {"__ref": "E:2"}, {"name": "Inline", "_id": "i"}]},
                 "sponsors": {"edges": [{"node": {"__ref": "E:1"}}, {"cursor": 1}]}, "other": ["E:1"]},
        "E:1": {"__typename": "Exhibitor", "id": "e1", "name": "One"}, "E:2": {"__typename": "Exhibitor", "id": 0, "name": "Two"},
    }
    state = {"apolloState": cache, "deep": deep, "props": {"pageProps": {"slug": " my-show ", "title": "Show"}}, "name": "Outer"}
    pages = [("https://a.example.com/", f"<script>x = 1; window.__INITIAL_STATE__ = {json.dumps(state)};</script>"), ("https://b.example.com/", "none"),
             ("https://c.example.com/", "<script>__data = {broken; var __data = [1]</script>")]
    rows = embedded.embedded_state(spark.createDataFrame(pages, "url string, html string")).collect()
    kinds = {k: sorted((r for r in rows if r.kind == k), key=lambda r: r.seq) for k in ("listed", "ref", "held", "node")}
    assert [r.item_id for r in kinds["listed"]] == ["", "1", "2"]
    assert [(l.path, l.value) for l in kinds["listed"][1].leaves] == [(["name"], "Maker 1"), (["about", "website"], "https://m1.com")]
    assert [r.ref for r in kinds["ref"]] == ["E:1", "E:2", "E:1"] and [r.item_id for r in kinds["held"]] == ["i"]
    assert [(r.node, r.item_id, r.typename) for r in kinds["node"]] == [("Root", "", ""), ("E:1", "e1", "Exhibitor"), ("E:2", "", "Exhibitor")]
    assert {r.event_slug for r in rows} == {"my-show"} and {tuple(r.titles) for r in rows} == {("Outer", "Show")}


def test_deep_and_broken_linked_data_does_not_end_a_job(spark):
    deep = "[" * 200_000 + "]" * 200_000
    block = '{"@type": ["Organization", "Thing"], "name": "Acme", "sameAs": ["https://acme.com/", ["https://second.com/"]], "founder": {"type": "Person", "name": "Jo"}}'
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in (deep, "{broken", "null", "[]", block))
    state = f"<script>window.__INITIAL_STATE__ = {deep};</script>"
    rows = G.page_signals(spark.createDataFrame([("https://x.org/", html), ("https://y.org/", state)], "url string, html string")).collect()
    texts = {r.url: [(t.key, t.label, t.text) for t in r.linked] for r in rows}
    assert texts["https://y.org/"] == []
    assert texts["https://x.org/"] == [
        (None, "@type", "Organization"), (None, "@type", "Thing"), ("name", "name", "Acme"), (None, "sameAs", "https://acme.com/"),
        (None, "sameAs", "https://second.com/"), ("type", "type", "Person"), ("name", "name", "Jo")]
    owners = [t.owner for r in rows if r.url == "https://x.org/" for t in r.linked]
    assert owners[0] == owners[1] == owners[2] == owners[3] and owners[5] == owners[6] != owners[0]


def test_a_show_has_one_body_whatever_its_size(spark):
    rows = [(1, i * 7 % 2503, f"Co {i}") for i in range(2503)] + [(2, 5, "same"), (2, 5, "other"), (2, 10**9, "far")]
    export = spark.createDataFrame(rows, "show_id long, sort_index long, company_name string")
    shows = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string").select("id", "name", F.lit("2026-01-01").cast("date").alias("event_date"), F.lit("P").alias("place"), F.lit("u").alias("source_url"))
    parts = L.delivery_body(export, shows, "now").collect()
    assert sorted((r.show_id, r.part_no) for r in parts) == [("1", 0), ("1", 1), ("1", 2), ("2", 0)]
    for show, n in (("1", 2503), ("2", 3)):
        body = json.loads("".join(r.text for r in sorted(parts, key=lambda r: r.part_no) if r.show_id == show))
        assert len(body["records"]) == n and len({r["id"] for r in body["records"]}) == n
    names = [r["cells"]["company_name"] for r in json.loads("".join(r.text for r in sorted(parts, key=lambda r: r.part_no) if r.show_id == "1"))["records"]]
    assert names == [c for _, _, c in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])]
