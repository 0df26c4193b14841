"""Hand-made pages: signals, listings, landing pages, embedded data."""

import json

from pyspark.sql import functions as F

from stallworks.operators import crawl, embedded, lines, listing, websites
from stallworks.sources import embedded as E, pages as P, signals as G
from stallworks import rules
from stallworks.sources.html_scan import scan

ATTRS = ["data-href"]


def page_frame(spark, *pages):
    return spark.createDataFrame(list(pages), "url string, html string")


def test_void_elements_and_unclosed_tags():
    page = scan('<main><p>one<p>two<a href=x><img src=i.png>T</a><br>three</main><a href="y">out</a>', ATTRS, rules.SHORT_TEXT)
    assert [(a["text"], a["href"], a["in_main"]) for a in page["anchors"]] == [("T", "x", True), ("out", "y", False)]
    assert page["images"][0]["src"] == "i.png"


def test_regions_scripts_entities_and_headings():
    page = scan(
        "<title>A &amp; B</title><script>var t='</p><a href=bad>no</a>';</script><style>p{}</style><h1>One <b>two</b></h1>"
        "<header><a href=/h>H</a></header><nav><a href=/n>N</a></nav><footer><a href=/f>F</a></footer><!-- <a href=/c>C</a> -->", ATTRS, rules.SHORT_TEXT)
    assert page["title"] == "A & B" and page["h1_texts"] == ["One two"]
    flags = {a["href"]: (a["in_header"], a["in_nav"], a["in_footer"]) for a in page["anchors"]}
    assert flags == {"/h": (True, False, False), "/n": (False, True, False), "/f": (False, False, True)}


def test_container_ranges_hold_only_their_own_actions():
    page = scan('<div><div id=A class="x y z"><h3>T</h3><a href=1>a</a></div><div><button data-href=2>b</button></div></div>', ATTRS, rules.SHORT_TEXT)
    inner, second, outer = page["containers"]
    assert inner["signature"][-1] == "div#a.x.y" and (inner["first_action"], inner["action_count"], inner["heading_count"]) == (0, 1, 1)
    assert (second["first_action"], second["action_count"], second["heading_count"]) == (1, 1, 0)
    assert outer["action_count"] == 2 and outer["text"] == "T a b" and outer["text_length"] == 5


def test_broken_markup_ends():
    for html in ("", "<", "<a href='x", "<div <div>", "</p></p>", "<script>never closed", "<a href=\"x>y</a>" * 50, "<!-- open"):
        scan(html, ATTRS, rules.SHORT_TEXT)


LIST = """<html><body><nav><a href="/company/n1">Nav One</a><a href="/company/n2">Nav Two</a><a href="/company/n3">Nav Three</a></nav><main>
<a class="c" href="/company/1">Delta Works</a><a class="c" href="/company/2">Amber Foods</a><a class="c" href="/company/3">Cedar Glass</a>
<a class="c" href="/company/2">Amber Foods International</a><a class="c" href="/company/4">www.ember.com</a><a class="c" href="/company/4">A longer text for ember</a>
<a class="c" href="/company/5">Boreal Optics</a><a href="/x.pdf">Brochure Download</a></main></body></html>"""


def test_anchor_listing(spark):
    seed = "https://dir.org/list"
    signals = G.page_signals(page_frame(spark, (seed, LIST))).withColumn("seed_url", F.lit(seed))
    candidates = listing.listing_candidates(signals)
    best = listing.listing_strategies(candidates).orderBy("rank").first()
    assert (best.source_kind, best.url_group, best.unique_urls) == ("anchor", "/company/*", 5)
    # 5 urls * 12 + full diversity * 30 + 20 keyword + 10 length - 15 www
    assert best.base_score == 60 + 30 + 15
    chosen = listing.listing_strategies(candidates).filter("rank = 1")
    found = listing.matching_entries(candidates.withColumn("directory_page", F.lit(1)), chosen).orderBy(F.lower("name")).collect()
    assert [r.name for r in found] == ["Amber Foods International", "Boreal Optics", "Cedar Glass", "Delta Works", "www.ember.com"]


def test_listing_does_not_depend_on_partitioning(spark):
    pages = [(f"https://d{i}.org/list", LIST.replace("Works", f"Works{i}")) for i in range(20)]
    signals = G.page_signals(page_frame(spark, *pages)).withColumn("seed_url", F.col("url"))
    result = []
    for parts in (1, 7):
        candidates = listing.listing_candidates(signals.repartition(parts))
        result.append(sorted(map(str, listing.listing_strategies(candidates).collect())))
    assert result[0] == result[1]


def test_relaxed_matching(spark):
    columns = "seed_url string, page_url string, directory_page int, source_kind string, signature array<string>, url_group string, name string, url string, ord int"
    rows = [("s", "p1", 1, "anchor", ["a"], "/x/*", "One", "u1", 0), ("s", "p1", 1, "anchor", ["b"], "/x/*", "Two", "u2", 1),
            ("s", "p2", 2, "anchor", ["a"], "/y/*", "Three", "u3", 0), ("s", "p2", 2, "anchor", ["a"], "/z/*", "Four", "u4", 1), ("s", "p2", 2, "anchor", ["b"], "/x/*", "Five", "u5", 2)]
    candidates = spark.createDataFrame(rows, columns)
    strategy = spark.createDataFrame([("s", "anchor", ["a"], "/x/*", 1)], "seed_url string, source_kind string, signature array<string>, url_group string, rank int")
    found = {(r.page_url, r.name) for r in listing.matching_entries(candidates, strategy).collect()}
    # page 1: one exact and one of the signature, so by URL shape; page 2: no exact, two of the signature
    assert found == {("p1", "One"), ("p1", "Two"), ("p2", "Three"), ("p2", "Four")}


def test_website_negative_footer_link(spark):
    """One privacy link for all companies must not become anybody's website."""
    entries = spark.createDataFrame([(f"Company {c}", f"https://d.org/{c}", "", i) for i, c in enumerate("ABCDE")], "company_name string, profile_url string, website_url_hint string, sort_index int")
    sites = spark.createDataFrame([(f"https://d.org/{c}", "https://privacy.bigcorp.org/") for c in "ABCD"], "profile_url string, website_url string")
    rows = websites.resolve_profiles(entries, sites).collect()
    assert all(r.website_url == "" for r in rows) and sum(r.failed for r in rows) == 1


def test_state_objects(spark):
    tree = {"props": {"pageProps": {"slug": "ev", "eventName": "Boat Expo", "exhibitorList": [
        {"name": f"Company {c}", "href": f"/co/{c}", "contact": {"website": f"https://{c}.example.net"}} for c in "abc"]}}}
    cache = {"apolloState": {"Q": {"vendors": {"nodes": [{"__ref": "V:1"}, "V:2", {"name": "Held Co", "url": "/co/held"}]}},
                             "V:1": {"name": "First Co", "url": "/co/1"}, "V:2": {"name": "Second Co", "url": "/co/2"}, "V:3": {"__typename": "Vendor", "name": "Unlisted", "url": "/co/3"}}}
    pages = page_frame(
        spark, ("https://a.org/x", f'<script id="__NEXT_DATA__">{json.dumps(tree)}</script>'),
        ("https://b.org/x", f"<script>var x=1; window.__APOLLO_STATE__ = {json.dumps(cache)}; more()</script>"),
        ("https://c.org/x", "<script>window.__INITIAL_STATE__ = {broken</script>"))
    found = embedded.embedded_entries(E.embedded_state(pages)).orderBy("url", "ord").collect()
    assert [(r.company_name, r.profile_url, r.website_url_hint) for r in found if r.url == "https://a.org/x"] == [
        (f"Company {c}", f"https://a.org/co/{c}", f"https://{c}.example.net") for c in "abc"]
    assert {r.data_title for r in found if r.url == "https://a.org/x"} == {"Boat Expo"}
    assert [r.company_name for r in found if r.url == "https://b.org/x"] == ["First Co", "Second Co", "Held Co"]


def test_tables_and_richtext(spark):
    table = "<table><tr><th>only</th></tr><tr><td>A1</td><td>Amber Works</td><td><a href='/p/1'>x</a></td></tr><tr><td>B2</td><td>Boreal Foods</td></tr><tr><td>A9</td><td>Again</td><td><a href='/p/1'>x</a></td></tr></table>"
    rows = lines.table_entries(page_frame(spark, ("https://t.org/list?page=2&x=1", table))).orderBy("ord").collect()
    assert [(r.company_name, r.profile_url) for r in rows] == [("Amber Works", "https://t.org/p/1"), ("Boreal Foods", "https://t.org/list?x=1#b2-boreal_foods")]
    text = "".join(f"<p>Company Name {chr(65 + i)}</p>" for i in range(10))
    page = page_frame(spark, ("https://r.org/", f'<div data-testid="richTextElement">{text}<p>Company Name A</p></div>'), ("https://s.org/", '<div data-testid="richTextElement"><p>Only One</p></div>'))
    found = lines.richtext_entries(page).orderBy("ord").collect()
    assert [r.company_name for r in found] == [f"Company Name {chr(65 + i)}" for i in range(10)] and [r.ord for r in found] == list(range(10))


def test_seed_hops_never_return(spark):
    ring = [(f"https://h{i}.org/", f'<a href="https://h{(i + 1) % 3}.org/">Exhibitors</a>') for i in range(3)]
    pages = page_frame(spark, *ring)
    hops = crawl.seed_hops(pages, G.page_signals(pages))
    got = crawl.resolve_seeds(pages.select(F.col("url").alias("seed_url")), hops).collect()
    assert {(r.seed_url, r.resolved_url) for r in got} == {(f"https://h{i}.org/", f"https://h{(i + 2) % 3}.org/") for i in range(3)}
