"""Whole directories: platform payloads, landing pages, tables, state objects, crawls and records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.operators import crawl, embedded, lines, websites
from stallworks.plans import company, directory
from stallworks.session import cut_lineage, shared_folder
from stallworks.sources import embedded as E, pages as P, signals as G
from stallworks.streaming import jobs
from workloads import duck as Q, shared, sites


def grouped(spark, sf_dir, item):
    """One row per site and page of at most 500 keys, with its items in key order."""
    rows = sites.companies(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("key", item.alias("item")))), lambda s: s["item"])
    return rows.groupBy("site", "c_nationkey", "page_no").agg(ordered.alias("items"))


# --- platform payloads ------------------------------------------------------------


def search_payloads(spark, sf_dir):
    item = F.struct(F.struct(F.col("key").cast("string").alias("exhid_l"), F.when(F.col("key") % 10 == 0, " ").otherwise(F.col("name")).alias("exhname_t")).alias("fields"))
    rows = grouped(spark, sf_dir, item)
    body = F.to_json(F.struct(F.struct(F.struct(F.struct((F.col("c_nationkey") * 10).alias("found"), F.col("items").alias("hit")).alias("exhibitor")).alias("results")).alias("DATA")))
    return rows.select(
        F.concat(F.lit("https://s"), "site", F.lit(".mapyourshow.com/8_0/explore?alpha=A")).alias("seed_url"),
        F.col("page_no").alias("directory_page"), body.alias("body"),
    )


def search_entries(spark, sf_dir):
    return E.search_payload_entries(search_payloads(spark, sf_dir)).select("seed_url", "directory_page", "ord", "company_name", "profile_url")


def search_page_counts(spark, sf_dir):
    return E.search_page_counts(search_payloads(spark, sf_dir))


def floorplan_entries(spark, sf_dir):
    k = F.col("key")
    item = F.struct(F.col("name"), F.when(k % 3 > 0, F.concat(F.lit("x "), k.cast("string"))).alias("externalId"), k.alias("id"))
    rows = grouped(spark, sf_dir, item)
    payload = F.to_json(F.struct(F.concat(F.lit(" Fair  "), "site").alias("title"), F.col("items").alias("exhibitors")))
    bodies = rows.select(
        F.concat(F.lit("https://p"), "site", F.lit("-"), F.col("page_no").cast("string"), F.lit(".expofp.com/")).alias("seed_url"),
        F.concat(F.when(F.col("page_no") % 2 == 0, "var ").otherwise(""), F.lit("__data = "), payload, F.lit(";\n")).alias("body"),
    )
    return E.floorplan_payload_entries(bodies).select("seed_url", "ord", "company_name", "profile_url", "plan_title")


# --- landing pages ------------------------------------------------------------------


def gallery_directory(spark, sf_dir):
    k = F.col("key")
    link = F.when(k % 5 > 0, F.struct(F.struct(F.regexp_replace("website", "^$", "https://own.example.net/").alias("url")).alias("data")))
    item = F.struct(F.struct(F.when(k % 2 == 0, F.col("name")).alias("title"), F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("_logo.png")).alias("fileName"), link.alias("link")).alias("metaData"))
    rows = grouped(spark, sf_dir, item)
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("items").alias("items")).alias("comp_galleryData")).alias("app")).alias("appsWarmupData")))
    pages = rows.select(
        F.concat(F.lit("https://g"), "site", F.lit("-"), F.col("page_no").cast("string"), F.lit(".example.com/")).alias("url"),
        F.concat(F.lit('<html><script type="application/json" id="wix-warmup-data">'), data, F.lit("</script></html>")).alias("html"),
    )
    return embedded.gallery_entries(E.gallery_items(pages)).select("url", "company_name", "website_url_hint", "ord")


def richtext_directory(spark, sf_dir):
    rows = grouped(spark, sf_dir, F.concat(F.lit("<p class='x'>"), "name", F.lit("</p>")))
    pages = rows.select(
        F.concat(F.lit("https://r"), "site", F.lit("-"), F.col("page_no").cast("string"), F.lit(".example.com/")).alias("url"),
        F.concat(F.lit('<div data-testid="richTextElement"><p>Secure your space</p>'), F.array_join("items", ""), F.lit("</div><div data-testid='richTextElement'><p>Short list</p></div>")).alias("html"),
    )
    return lines.richtext_entries(pages).select("url", "company_name", "ord")


def table_pages(spark, sf_dir):
    k = F.col("key").cast("string")
    link = F.when(F.col("key") % 2 == 0, F.concat(F.lit('<a href="/co/'), k, F.lit('">more</a><a href="https://other.example.net/">x</a>'))).otherwise("")
    row = F.concat(F.lit("<tr><td>A"), k, F.lit("</td><td><b>"), "name", F.lit("</b></td><td>"), link, F.lit("</td></tr>"))
    rows = grouped(spark, sf_dir, row)
    totals = rows.groupBy("site").agg(F.max("page_no").alias("total"))
    pager = F.array_join(F.transform(F.sequence(F.lit(1), F.col("total")), lambda p: F.concat(F.lit('<a href="/list?page='), p.cast("string"), F.lit('">'), p.cast("string"), F.lit("</a>"))), "")
    base = F.concat(F.lit("https://t"), "site", F.lit(".example.com/list"))
    return rows.join(totals, "site").select(
        F.when(F.col("page_no") == 1, base).otherwise(F.concat(base, F.lit("?page="), F.col("page_no").cast("string"))).alias("url"),
        F.concat(F.lit("<html><body><table><tr><th>Booth</th></tr>"), F.array_join("items", ""), F.lit("</table>"), pager, F.lit("</body></html>")).alias("html"),
    )


def table_rows(spark, sf_dir):
    return P.table_rows(table_pages(spark, sf_dir), "url").select("url", "row_no", F.array_join("cells", "|").alias("cells"), F.array_join("hrefs", "|").alias("hrefs"))


def table_directory(spark, sf_dir):
    pages = shared.written(spark, sf_dir, "table_pages", lambda: table_pages(spark, sf_dir))
    signals = shared.written(spark, sf_dir, "table_signals", lambda: G.page_signals(shared.spread(spark, pages)))
    none = F.lit(None).cast("int")
    seeds = pages.filter("NOT contains(url, '?')").select(F.col("url").alias("seed_url"), none.alias("start_page"), none.alias("end_page"))
    found = directory.table_mode(seeds, pages, signals)
    candidates = directory._one_page(found, "table")
    return directory.directory_entries(candidates).select("seed_url", "sort_index", "directory_page", "company_name", "profile_url")


def image_line_pairs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(
        F.lit("https://ocr.example.com/").alias("seed_url"), F.concat(F.lit("img-"), F.col("conv_id").cast("string")).alias("image_url"), F.col("conv_id").alias("image_rank"),
        F.col("turn").alias("line_no"),
        F.expr("CASE role WHEN 'user' THEN concat('Company ', conv_id % 60, ' ', substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(turn AS INT) % 26 + 1, 1)) WHEN 'assistant' THEN concat('see www.c', conv_id, '-', turn, '.com') ELSE 'secure your space' END").alias("line"),
    )
    return lines.name_url_pairs(rows).select("image_url", "line_no", "company_name", "website_url_hint")


# --- state objects -------------------------------------------------------------------


def state_pages(spark, sf_dir):
    k = F.col("key")
    listed = F.to_json(F.struct(F.struct(F.col("name").alias("displayName")).alias("company"), F.when(k % 2 == 0, F.concat(F.lit("/co/"), k.cast("string"))).alias("profileUrl"), F.when(k % 3 > 0, F.col("website")).alias("webSite")))
    node = F.format_string('"Exhibitor:%d":{"__typename":"Core_Exhibitor","id":"%d","name":"%s"}', "key", "key", "name")
    ref = F.format_string('{"node":{"__ref":"Exhibitor:%d"}}', "key")
    rows = grouped(spark, sf_dir, F.struct(listed.alias("listed"), node.alias("node"), ref.alias("ref")))
    part = lambda name: F.array_join(F.transform("items", lambda i: i[name]), ",")
    cache = F.concat(F.lit('{"query":{"eventSlug":"my-show"},"apolloState":{"ROOT":{"exhibitors(first)":{"edges":['), part("ref"), F.lit("]}},"), part("node"), F.lit("}}"))
    tree = F.concat(F.lit('{"props":{"pageProps":{"eventName":"Harbor Expo '), F.col("c_nationkey").cast("string"), F.lit('","data":{"exhibitors":['), part("listed"), F.lit("]}}}}"))
    is_cache = F.col("c_nationkey") % 2 == 0
    host = F.when(is_cache, F.lit(".swapcard.com/event/x")).otherwise(F.lit(".example.com/list"))
    return rows.select(
        F.concat(F.lit("https://e"), "site", F.lit("-"), F.col("page_no").cast("string"), host).alias("url"),
        F.when(is_cache, F.concat(F.lit("<html><script>window.__INITIAL_STATE__ = "), cache, F.lit(";</script></html>"))).otherwise(
            F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), tree, F.lit("</script></html>"))).alias("html"),
    )


def state_directory(spark, sf_dir):
    found = embedded.embedded_entries(E.embedded_state(state_pages(spark, sf_dir)))
    return found.select("url", "ord", "company_name", "profile_url", "website_url_hint", "data_title")


def state_refs(spark, sf_dir):
    held = embedded.resolve_state_refs(E.embedded_state(state_pages(spark, sf_dir)))
    return held.select("url", "item_id", "typename", "event_slug")


# --- scripted paginators ---------------------------------------------------------------


PAGER_URL = "concat('https://pager-', c_custkey, '.example.com/list')"
PAGER_HTML = """concat('<html><script>var tk = ''old''; var cfg = {''module'': ''dir'', "method": ''search'', ''limit'': ', 10 + c_custkey % 3 * 10, ', ''offset'': ', c_custkey % 2 * 10, ', ''tk'': ''z''};',
    ' $("#a").jsPaginator(cfg, {''pageID'': ''p', c_custkey % 4, '''}, ', c_custkey % 90, '); $("#b").jsPaginator({''limit'': 5}, {}, 9); var tk = ''t', c_custkey, '''; var tm = ''', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '77' END, ''';</script>',
    '<script>var totalPages = ', c_custkey % 40, '; x = {"totalPages": 3}</script></html>')"""


def paginator_calls(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "pagers", PAGER_URL, PAGER_HTML)
    calls = P.paginator_calls(pages)
    return calls.select(
        "url", "endpoint_url", "limit", "total_results", "next_offset", "page_id",
        F.array_join(F.array_sort(F.map_keys("params")), ",").alias("params"), U.ajax_total_pages(F.col("limit"), F.col("total_results")).alias("pages"),
    )


def form_tokens(spark, sf_dir):
    return P.form_tokens(shared.derived_pages(spark, sf_dir, "pagers", PAGER_URL, PAGER_HTML), "url")


def total_pages(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "pagers", PAGER_URL, PAGER_HTML)
    return pages.select("url", P.total_pages("html").alias("total"))


# --- crawls -------------------------------------------------------------------------------


def site_links(spark, sf_dir):
    return shared.written(spark, sf_dir, "site_links", lambda: G.anchors(shared.site_signals(spark, sf_dir)))


def crawl_pages(spark, sf_dir):
    """Pages reached from each site's seed along links between pages."""
    seeds = sites.seeds(spark, sf_dir)
    known = shared.site_signals(spark, sf_dir).select("url")
    return crawl.crawl_reachable(seeds, crawl.pagination_edges(site_links(spark, sf_dir)), known).select("seed_url", "directory_page", "page_url", "place")


def page_params(spark, sf_dir):
    return crawl.query_param_votes(sites.seeds(spark, sf_dir), site_links(spark, sf_dir))


def pagination_links(spark, sf_dir):
    return crawl.pagination_links(sites.seeds(spark, sf_dir), crawl.pagination_edges(site_links(spark, sf_dir)))


def linked_pages(spark, sf_dir):
    return crawl.max_linked_page(site_links(spark, sf_dir)).filter("max_page > 1")


# --- the whole way ---------------------------------------------------------------------------


def entries_table(spark, sf_dir):
    def build():
        pages, signals = shared.site_pages(spark, sf_dir), shared.site_signals(spark, sf_dir)
        return directory.directory_entries(directory.directory_candidates(sites.seeds(spark, sf_dir), pages, signals))

    return shared.written(spark, sf_dir, "entries", build)


def records_table(spark, sf_dir):
    return shared.written(
        spark, sf_dir, "records",
        lambda: company.company_records(entries_table(spark, sf_dir), shared.site_pages(spark, sf_dir), shared.site_signals(spark, sf_dir)),
    )


def directory_entries(spark, sf_dir):
    return entries_table(spark, sf_dir).select("seed_url", "sort_index", "directory_page", "company_name", "profile_url")


def company_records(spark, sf_dir):
    return records_table(spark, sf_dir).select("seed_url", "sort_index", "company_name", "profile_url", "website_url")


def run_metrics(spark, sf_dir):
    return websites.run_metrics(records_table(spark, sf_dir), sites.seeds(spark, sf_dir))


def conference_facts(spark, sf_dir):
    seeds = shared.written(spark, sf_dir, "seeds", lambda: sites.seeds(spark, sf_dir))
    return company.conference_facts(seeds, shared.site_pages(spark, sf_dir), shared.site_signals(spark, sf_dir))


def company_export(spark, sf_dir):
    rows = company.export_rows(websites.require_website(records_table(spark, sf_dir)), conference_facts(spark, sf_dir))
    return rows.select("company_name", "website_url", "Location", "Conference", "sort_index", "seed_url")


# --- stream ------------------------------------------------------------------------------------


def status_stream(spark, sf_dir):
    """Newest status per show from a stream over the event files."""
    events = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    rows = events.select(F.col("user_id").alias("show_id"), F.col("event_type").alias("status"), "ts", "event_id")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = jobs.stream_status(rows, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return jobs.newest_status(spark, f"{base}/out").select("show_id", "status", "events")


QUERIES = {f.__name__: f for f in (
    search_entries, search_page_counts, floorplan_entries, gallery_directory, richtext_directory, table_rows, table_directory, image_line_pairs,
    state_directory, state_refs, paginator_calls, form_tokens, total_pages, crawl_pages, page_params, pagination_links, linked_pages,
    directory_entries, company_records, run_metrics, conference_facts, company_export, status_stream,
)}

_WORDS = f"""concat({sites.FIRST}[k % 16 + 1], ' ', {sites.SECOND}[k // 16 % 16 + 1], ' ', c_mktsegment[1], lower(c_mktsegment[2:]))"""
_BASE = f"""
    n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'hot' ELSE CAST(c_custkey // {sites.BLOCK} AS VARCHAR) END AS part,
        CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % {sites.BLOCK} END AS inside FROM customer),
    a AS (SELECT k, c_nationkey, c_mktsegment, concat(c_nationkey, '-', part) AS site, c_nationkey % 3 AS mode, inside // {sites.PAGE_KEYS} + 1 AS page FROM n),
    b AS (SELECT *, {_WORDS} AS name, concat('https://expo-', site, '.example.com/exhibitors') AS base,
        CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN 'https://www.qzvx-hub.net/' ELSE concat('https://www.', lower({sites.FIRST}[k % 16 + 1]), lower({sites.SECOND}[k // 16 % 16 + 1]), '.com/') END AS website FROM a),
    c AS (SELECT *, CASE WHEN mode = 2 THEN concat(base, '/page/1') ELSE base END AS seed_url, concat(base, '/company/', k) AS profile_url,
        count(*) FILTER (page = 1) OVER (PARTITION BY site) AS first_page, max(page) OVER (PARTITION BY site) AS total,
        row_number() OVER (PARTITION BY site, page ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY site, page) AS n FROM b)"""
_ENTRIES = f"{_BASE}, e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page, lower(name), k) - 1 AS sort_index FROM c WHERE first_page >= 3)"
_CITY = "['Las Vegas, NV', 'Austin, TX', 'Orlando, FL', 'Chicago, IL', 'Atlanta, GA', 'Denver, CO', 'Toronto, ON'][c_nationkey % 7 + 1]"
_REC = "CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN '' ELSE website END"
_PAGES = "p AS (SELECT DISTINCT site, base, seed_url, mode, page, total, CASE WHEN mode = 2 THEN concat(base, '/page/', page) WHEN page = 1 THEN base ELSE concat(base, '?page=', page) END AS url FROM c)"

ORACLES = {
    "search_entries": f"""WITH {_BASE} SELECT concat('https://s', site, '.mapyourshow.com/8_0/explore?alpha=A') AS seed_url, page AS directory_page, pos AS ord, name AS company_name,
        concat('https://s', site, '.mapyourshow.com/8_0/exhibitor/exhibitor-details.cfm?exhid=', k) AS profile_url FROM c WHERE k % 10 <> 0""",
    "search_page_counts": f"""WITH {_BASE} SELECT DISTINCT concat('https://s', site, '.mapyourshow.com/8_0/explore?alpha=A') AS seed_url, greatest(1, CAST(ceil(c_nationkey * 10 / 50) AS INT)) AS page_count FROM c""",
    "floorplan_entries": f"""WITH {_BASE} SELECT concat('https://p', site, '-', page, '.expofp.com/') AS seed_url, pos AS ord, name AS company_name,
        concat('https://p', site, '-', page, '.expofp.com/#exhibitor=', CASE WHEN k % 3 > 0 THEN concat('x%20', k) ELSE CAST(k AS VARCHAR) END) AS profile_url, concat('Fair ', site) AS plan_title FROM c""",
    "gallery_directory": f"""
        WITH {_BASE}, l AS (SELECT *, row_number() OVER (PARTITION BY site, page, website ORDER BY k) AS r FROM c WHERE k % 5 > 0),
        s AS (SELECT site, page FROM l GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT website) >= 3)
        SELECT concat('https://g', site, '-', page, '.example.com/') AS url, name AS company_name, website AS website_url_hint, pos AS ord FROM l JOIN s USING (site, page) WHERE r = 1""",
    "richtext_directory": f"""
        WITH {_BASE}, f AS (SELECT *, row_number() OVER (PARTITION BY site, page, name ORDER BY k) AS r FROM c WHERE n >= 10), g AS (SELECT *, count(*) OVER (PARTITION BY site, page) AS d FROM f WHERE r = 1)
        SELECT concat('https://r', site, '-', page, '.example.com/') AS url, name AS company_name, row_number() OVER (PARTITION BY site, page ORDER BY k) - 1 AS ord FROM g WHERE d >= 10""",
    "table_rows": f"""
        WITH {_BASE} SELECT concat('https://t', site, '.example.com/list', CASE WHEN page > 1 THEN concat('?page=', page) ELSE '' END) AS url, pos + 1 AS row_no,
            concat('A', k, '|', name, '|', CASE WHEN k % 2 = 0 THEN 'more x' ELSE '' END) AS cells, CASE WHEN k % 2 = 0 THEN concat('/co/', k, '|https://other.example.net/') ELSE '' END AS hrefs FROM c""",
    "table_directory": f"""
        WITH {_BASE} SELECT concat('https://t', site, '.example.com/list') AS seed_url, row_number() OVER (PARTITION BY site ORDER BY page, k) - 1 AS sort_index, page AS directory_page, name AS company_name,
            concat('https://t', site, '.example.com/', CASE WHEN k % 2 = 0 THEN concat('co/', k) ELSE concat('list#a', k, '-', replace(lower(name), ' ', '_')) END) AS profile_url FROM c WHERE first_page >= 3""",
    "image_line_pairs": """
        WITH l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN concat('Company ', conv_id % 60, ' ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[turn % 26 + 1]) END AS name, CASE role WHEN 'assistant' THEN concat('https://www.c', conv_id, '-', turn, '.com') END AS url FROM conversations),
        g AS (SELECT *, count(name) OVER (PARTITION BY conv_id ORDER BY turn) AS w FROM l),
        k AS (SELECT conv_id, w, min(turn) FILTER (name IS NOT NULL) AS turn, any_value(name) AS name, arg_min(url, turn) FILTER (url IS NOT NULL) AS url FROM g WHERE w > 0 GROUP BY conv_id, w),
        f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id, turn) AS r FROM k)
        SELECT concat('img-', conv_id) AS image_url, turn AS line_no, name AS company_name, coalesce(url, '') AS website_url_hint FROM f WHERE r = 1""",
    "state_directory": f"""
        WITH {_BASE},
        u AS (SELECT *, c_nationkey % 2 = 0 AS cache, CASE WHEN c_nationkey % 2 = 0 THEN concat('https://e', site, '-', page, '.swapcard.com/event/my-show/exhibitor/', k) WHEN k % 2 = 0 THEN concat('https://e', site, '-', page, '.example.com/co/', k) ELSE '' END AS prof,
                CASE WHEN c_nationkey % 2 = 1 AND k % 3 > 0 THEN website ELSE '' END AS web FROM c WHERE n >= 3 OR c_nationkey % 2 = 0),
        v AS (SELECT *, row_number() OVER (PARTITION BY site, page, CASE WHEN prof <> '' THEN prof ELSE web END ORDER BY k) AS r FROM u WHERE prof <> '' OR web <> ''),
        w AS (SELECT *, count(*) OVER (PARTITION BY site, page) AS m, row_number() OVER (PARTITION BY site, page ORDER BY k) - 1 AS ord FROM v WHERE r = 1)
        SELECT concat('https://e', site, '-', page, CASE WHEN cache THEN '.swapcard.com/event/x' ELSE '.example.com/list' END) AS url, ord, name AS company_name, prof AS profile_url, web AS website_url_hint,
            CASE WHEN cache THEN '' ELSE concat('Harbor Expo ', c_nationkey) END AS data_title FROM w WHERE m >= 3""",
    "state_refs": f"""WITH {_BASE} SELECT concat('https://e', site, '-', page, '.swapcard.com/event/x') AS url, CAST(k AS VARCHAR) AS item_id, 'Core_Exhibitor' AS typename, 'my-show' AS event_slug FROM c WHERE c_nationkey % 2 = 0""",
    "paginator_calls": """
        WITH r AS (SELECT c_custkey AS k, 10 + c_custkey % 3 * 10 AS l, c_custkey % 90 AS t FROM customer)
        SELECT concat('https://pager-', k, '.example.com/list') AS url, concat('https://pager-', k, '.example.com/index.php') AS endpoint_url, l AS "limit", t AS total_results, k % 2 * 10 AS next_offset,
            concat('p', k % 4) AS page_id, 'limit,method,module,offset' AS params, CASE WHEN t = 0 THEN 1 ELSE CAST(ceil(t / l) AS INT) END AS pages FROM r""",
    "form_tokens": "SELECT concat('https://pager-', c_custkey, '.example.com/list') AS url, concat('t', c_custkey) AS tk, '77' AS tm FROM customer WHERE c_custkey % 5 <> 0",
    "total_pages": "SELECT concat('https://pager-', c_custkey, '.example.com/list') AS url, greatest(3, c_custkey % 40) AS total FROM customer",
    "crawl_pages": f"""WITH {_BASE}, {_PAGES} SELECT seed_url, page AS directory_page, url AS page_url, row_number() OVER (PARTITION BY site ORDER BY page) AS place FROM p WHERE mode > 0 OR page = 1""",
    "page_params": f"""WITH {_BASE}, {_PAGES} SELECT DISTINCT seed_url, 'page' AS param FROM p WHERE mode = 1 AND total > 1""",
    "pagination_links": f"""WITH {_BASE}, {_PAGES} SELECT seed_url, concat(base, CASE WHEN mode = 1 THEN '?page=' ELSE '/page/' END, g.i) AS dst_url, g.i AS page_no
        FROM (SELECT DISTINCT seed_url, base, mode, total FROM p) q, range(2, 1000) g(i) WHERE mode > 0 AND g.i <= total""",
    "linked_pages": f"""WITH {_BASE}, {_PAGES} SELECT url, CASE WHEN page = total THEN total - 1 ELSE total END AS max_page FROM p WHERE mode > 0 AND CASE WHEN page = total THEN total - 1 ELSE total END > 1""",
    "directory_entries": f"WITH {_ENTRIES} SELECT seed_url, sort_index, page AS directory_page, name AS company_name, profile_url FROM e",
    "company_records": f"WITH {_ENTRIES} SELECT seed_url, sort_index, name AS company_name, profile_url, {_REC} AS website_url FROM e",
    "run_metrics": f"""WITH {_ENTRIES}, m AS (SELECT seed_url, count(*) AS a, count(*) FILTER ({_REC} <> '') AS b FROM e GROUP BY seed_url)
        SELECT seed_url, coalesce(a, 0) AS record_count, coalesce(b, 0) AS company_count, coalesce(a - b, 0) AS dropped_count, 0 AS failures FROM (SELECT DISTINCT seed_url FROM c) LEFT JOIN m USING (seed_url)""",
    "conference_facts": f"""WITH {_BASE} SELECT DISTINCT seed_url, concat('Harbor Expo ', c_nationkey) AS conference_name, {_CITY} AS conference_location FROM c""",
    "company_export": f"""WITH {_ENTRIES} SELECT name AS company_name, website AS website_url, {_CITY} AS Location, concat('Harbor Expo ', c_nationkey) AS Conference, sort_index, seed_url FROM e WHERE {_REC} <> ''""",
    "status_stream": "SELECT user_id AS show_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, count(*) AS events FROM events GROUP BY user_id",
}
