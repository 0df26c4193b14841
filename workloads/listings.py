"""Page signals, listing strategies, directory discovery, websites and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.operators import crawl, lines, listing, names, places, websites
from stallworks.sources import pages as P, signals as G
from workloads import duck as Q, shared, sites

# --- the given page table ------------------------------------------------------


def page_links(spark, sf_dir):
    rows = G.anchors(shared.page_signals(spark, sf_dir))
    return rows.select("url", "ord", "absolute_url", F.col("display_text").alias("text"), F.col("in_nav").cast("int").alias("in_nav"))


def page_signal_counts(spark, sf_dir):
    return shared.page_signals(spark, sf_dir).select(
        "url", "title", F.get("h1_texts", F.lit(0)).alias("h1"), F.size("anchors").alias("anchors"),
        F.size(F.filter("containers", lambda c: c["tag"] == "li")).alias("items"),
    )


def site_candidates(spark, sf_dir):
    """Navigation links of the page table as candidates, one site per host."""
    rows = G.anchors(shared.page_signals(spark, sf_dir)).filter(
        ~U.looks_like_asset("absolute_url") & T.is_companyish("display_text")
    )
    return rows.select(
        U.host_key("url").alias("seed_url"), F.col("url").alias("page_url"), "source_kind", "signature",
        U.url_group("absolute_url").alias("url_group"), F.col("display_text").alias("name"),
        F.col("absolute_url").alias("url"), "ord",
    )


def link_strategies_by_site(spark, sf_dir):
    candidates = shared.written(spark, sf_dir, "site_candidates", lambda: site_candidates(spark, sf_dir))
    ranked = listing.listing_strategies(candidates)
    return ranked.select(
        F.col("seed_url").alias("host"), "url_group", "unique_urls", F.round("base_score", 6).alias("base_score"),
        "rank", F.array_join("sample_names", "|").alias("sample_names"),
    )


def best_links_per_url(spark, sf_dir):
    candidates = shared.written(spark, sf_dir, "site_candidates", lambda: site_candidates(spark, sf_dir))
    return listing.best_link_per_url(candidates, ["seed_url", "source_kind"]).select(
        F.col("seed_url").alias("host"), "url", "name", "first_ord"
    )


def page_param_links(spark, sf_dir):
    """Pages of the table per page number and platform (by address and text)."""
    pages = shared.page_table(spark, sf_dir)
    return pages.groupBy(F.coalesce(U.page_number("url"), F.lit(1)).alias("page_number"), P.platform("url", "html").alias("platform")).agg(
        F.count("*").alias("n")
    )


# --- landing pages: frames, directory links, images -------------------------------

LAND_URL = "concat('https://land-', c_custkey, '.example.com/')"
LAND_HTML = """concat('<html><head><title>Show ', c_custkey, '</title></head><body><main>',
    CASE c_custkey % 5 WHEN 0 THEN concat('<iframe class="f" src="https://show', c_custkey, '.expofp.com/"></iframe>')
        WHEN 1 THEN '<iframe src="https://x.doubleclick.net/activityi;exhibitor"></iframe><iframe src="/vendor-frame"></iframe>'
        WHEN 2 THEN '<iframe src="https://video.example.org/embed"></iframe>' ELSE '' END,
    CASE c_custkey % 4 WHEN 0 THEN concat('<a href="https://land-', c_custkey + 1, '.example.com/#x">Exhibitors</a>')
        WHEN 1 THEN '<a href="/plan">Floor plan</a><a href="/register">Register as vendor</a>'
        WHEN 2 THEN '<a href="/brands" title="Participating Brands"><img src="/logo.png" alt=""></a><a href="/f.pdf">Exhibitor Directory</a>'
        ELSE '<a href="/faq">FAQ</a>' END,
    '<img src="/img/exhibitor-list-', c_custkey, '.jpg" width="', 300 + c_custkey % 5 * 100, '" height="500px" alt="All of our vendors shown here today">',
    '<img src="/img/hero.png" width="900" height="900"><img src="https://cdn.example.net/list.png" width="900" height="900">',
    '</main><footer><img src="/img/sponsor-list.png" width="900" height="900"></footer></body></html>')"""


def landing(spark, sf_dir):
    return shared.derived_pages(spark, sf_dir, "landing", LAND_URL, LAND_HTML)


def landing_signals(spark, sf_dir):
    return shared.derived_signals(spark, sf_dir, "landing", landing(spark, sf_dir))


def best_frames(spark, sf_dir):
    return crawl.best_iframe(landing(spark, sf_dir))


def best_directory_links(spark, sf_dir):
    return crawl.best_directory_link(G.anchors(landing_signals(spark, sf_dir)))


def resolved_seeds(spark, sf_dir):
    pages, signals = landing(spark, sf_dir), landing_signals(spark, sf_dir)
    hops = shared.written(spark, sf_dir, "landing_hops", lambda: crawl.seed_hops(pages, signals))
    return crawl.resolve_seeds(pages.select(F.col("url").alias("seed_url")), hops)


def image_ranking(spark, sf_dir):
    images = G.images(landing_signals(spark, sf_dir))
    worthy = lines.ocr_worthy_images(images).select("url", "absolute_url", F.lit(1).alias("worthy"))
    top = lines.top_images(images)
    return top.join(worthy, ["url", "absolute_url"], "left").select(
        "url", "absolute_url", "image_rank", "score", F.coalesce("worthy", F.lit(0)).alias("worthy")
    )


# --- profile pages and company sites -------------------------------------------

PROFILE_URL = "concat('https://dir.example.com/co/', c_custkey)"
PROFILE_HTML = """concat('<html><head><title>Amber Works ', c_custkey, ' | Fair</title></head><body><main><h1>Amber Works</h1>',
    CASE c_custkey % 9
        WHEN 0 THEN concat('<script>var d = {websiteValue: "https:\\\\/\\\\/amber', c_custkey, '.com\\\\/"};</script><a href="https://other.example.org/">Visit website</a>')
        WHEN 1 THEN concat('<script type="application/ld+json">{"@type":"Organization","name":"Amber","sameAs":["https://x.com/a","https://amberworks', c_custkey, '.com/"]}</script>')
        WHEN 2 THEN concat('<a href="https://www.amberworks', c_custkey, '.com/?a=1">Visit website</a><a href="https://plain.example.org/">Other</a>')
        WHEN 3 THEN '<a href="https://www.facebook.com/amber">Facebook</a>'
        WHEN 4 THEN '<a href="https://plan.example.org/eventmap?boothid=4">Find us</a>'
        WHEN 5 THEN '<a href="https://files.example.org/brochure.pdf">Website</a>'
        WHEN 6 THEN '<button data-href="amberworks.example.net">amberworks.example.net</button>'
        WHEN 7 THEN '<a href="https://help.vendor.io/">www.vendor.io</a><a href="https://amber.vendor.io/">Amber</a>'
        ELSE '<a href="https://agency.example.org/">built by us</a>' END,
    '</main><footer><a href="https://platform.example.org/">Powered by platform</a></footer></body></html>')"""
SITE_URL = "concat('https://www.cedarglass', c_custkey, '.com/')"
SITE_HTML = """concat('<html><head>',
    CASE c_custkey % 6 WHEN 0 THEN '<meta property="og:site_name" content="Cedar Glass &amp; Co">'
        WHEN 1 THEN '<meta name="application-name" content="Portal"><meta property="og:title" content="Cedar Glass">'
        WHEN 2 THEN '<script type="application/ld+json">[{"@type":["Store","Thing"],"name":"Cedar Glass Studio"}]</script>' ELSE '' END,
    '<title>', CASE c_custkey % 6 WHEN 3 THEN 'Home | Fine rugs from Cedar Glass' WHEN 4 THEN 'Welcome' WHEN 5 THEN '' ELSE 'Cedar Glass - Shop' END,
    '</title></head><body><h1>', CASE c_custkey % 6 WHEN 4 THEN 'Handmade bowls' ELSE 'Welcome' END, '</h1></body></html>')"""


def profile_websites(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "profiles", PROFILE_URL, PROFILE_HTML)
    signals = shared.derived_signals(spark, sf_dir, "profiles", pages)
    return websites.profile_websites(signals, websites.scripted_websites(pages))


def company_site_names(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "company_sites", SITE_URL, SITE_HTML)
    signals = shared.derived_signals(spark, sf_dir, "company_sites", pages)
    return names.site_names(signals, names.weighted_meta(pages))


def meta_tags(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "company_sites", SITE_URL, SITE_HTML)
    return P.meta_tags(pages, "url").select("url", "pos", F.concat("property", "name").alias("key"), "content")


def enriched_names(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "company_sites", SITE_URL, SITE_HTML)
    signals = shared.derived_signals(spark, sf_dir, "company_sites", pages)
    records = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Cg-1")).otherwise(F.lit("proper name here")).alias("company_name"),
        F.expr(f"concat({SITE_URL}, 'about?x=1')").alias("website_url"),
        (F.col("c_custkey") % 7 == 0).alias("looked_up"),
    )
    out = names.enriched_names(records, signals, names.weighted_meta(pages))
    return out.select("key", "company_name", F.col("looked_up").cast("int").alias("looked_up"))


# --- cards: containers, actions, text -------------------------------------------

CARD_URL = "concat('https://cards-', c_custkey, '.example.com/exhibitors?page=1')"
CARD_HTML = """concat('<html><body><header><div><h3>Head</h3><a href="/x/y">View</a></div></header><main>',
    CASE c_custkey % 3
      WHEN 0 THEN concat('<div class="card"><h3>Amber Works</h3><p>Booth ', c_custkey, '</p><button onclick="location.href=''/exhibitor/1''">View profile</button></div>',
            '<div class="card"><h3>Boreal Foods</h3><button onclick="window.open(''/exhibitor/2'')">View profile</button></div>',
            '<div class="card"><h3>Cedar Glass</h3><h4>x</h4><button data-href="/exhibitor/3">View profile</button></div>')
      WHEN 1 THEN concat('<div class="t">A12 Amber Works<a href="https://other.example.org/map">map</a></div><div class="t">B7 Boreal Foods<a href="https://other.example.org/map"></a></div>',
            '<div class="t">C', c_custkey % 90, ' Cedar Glass<a href="https://other.example.org/map"></a></div>')
      ELSE concat('<ul><li class="i"><a href="/vendor/amber">Amber Works</a></li><li class="i"><a href="/vendor/boreal">Boreal Foods</a><a href="/vendor/boreal">Boreal Foods of ', c_mktsegment, '</a></li>',
            '<li class="i"><a href="/vendor/cedar">www.cedar.com</a></li></ul>') END,
    '</main><footer><div><h3>Foot</h3><a href="/exhibitor/9">View</a></div></footer></body></html>')"""


def card_rows(spark, sf_dir):
    pages = shared.derived_pages(spark, sf_dir, "cards", CARD_URL, CARD_HTML)
    signals = shared.derived_signals(spark, sf_dir, "cards", pages)
    return shared.written(
        spark, sf_dir, "card_candidates", lambda: listing.listing_candidates(signals.withColumn("seed_url", F.col("url")))
    )


def card_candidates(spark, sf_dir):
    return card_rows(spark, sf_dir).select(
        F.col("seed_url").alias("page"), "source_kind", F.array_join("signature", ">").alias("signature"), "url_group", "name", "url"
    )


def card_strategies(spark, sf_dir):
    ranked = listing.listing_strategies(card_rows(spark, sf_dir))
    return ranked.select(
        F.col("seed_url").alias("page"), "source_kind", "url_group", "unique_urls", F.round("base_score", 6).alias("base_score"),
        "rank", F.array_join("sample_names", "|").alias("sample_names"),
    )


# --- places ---------------------------------------------------------------------


def event_places(spark, sf_dir):
    pages, signals = shared.site_pages(spark, sf_dir), shared.site_signals(spark, sf_dir)
    rows = signals.join(pages, "url").select("url", "html", "title", "h1_texts")
    scores = places.location_scores(places.location_mentions(rows), "url")
    return scores.select("url", "location", "score", "mentions")


def event_names(spark, sf_dir):
    return shared.site_signals(spark, sf_dir).select(
        "url", T.conference_label(names.conference_name("url", "title", "h1_texts")).alias("conference")
    )


QUERIES = {
    "page_links": page_links, "page_signal_counts": page_signal_counts, "link_strategies_by_site": link_strategies_by_site,
    "best_links_per_url": best_links_per_url, "page_param_links": page_param_links, "best_frames": best_frames,
    "best_directory_links": best_directory_links, "resolved_seeds": resolved_seeds, "image_ranking": image_ranking,
    "profile_websites": profile_websites, "company_site_names": company_site_names, "meta_tags": meta_tags,
    "enriched_names": enriched_names, "card_candidates": card_candidates, "card_strategies": card_strategies,
    "event_places": event_places, "event_names": event_names,
}

_PAGE_URL = Q.normalized("url")
_ROOT = "concat(regexp_extract(url, '^[a-z]+://'), regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
# one row per address, as the page reader keeps them
_UNIQUE = f"""pages AS (
        SELECT * FROM main.pages QUALIFY row_number() OVER (PARTITION BY coalesce({_PAGE_URL}, url) ORDER BY length(html) DESC, page_id DESC) = 1)"""
_LINKS = f"""{_UNIQUE},
    x AS (SELECT {_PAGE_URL} AS url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs,
                 regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM pages),
    l AS (SELECT url, unnest(range(len(hs))) AS ord, concat({_ROOT}, unnest(hs)) AS absolute_url, unnest(ts) AS raw FROM x)"""
_SITE = f"""{_LINKS},
    c AS (SELECT {Q.host('url')} AS host, absolute_url AS u, ord, {Q.norm("replace(raw, '&amp;', '&')")} AS name FROM l),
    k AS (SELECT host, u, ord, name, {Q.url_group('u')} AS url_group,
                 CAST(regexp_matches(name, '{rules.DOMAIN_TEXT}') AS INT) AS dom FROM c
          WHERE {Q.companyish('name')} AND NOT regexp_matches(lower({Q.path('u')}), '\\.(?:{"|".join(rules.ASSET_EXTENSIONS)})$'))"""
_BONUS = f"""CASE WHEN regexp_matches(url_group, '{"|".join(rules.LISTING_GROUP_WORDS)}') THEN 20 ELSE 0 END
    + CASE WHEN avg(length(name)) BETWEEN 4 AND 80 THEN 10 ELSE 0 END
    - CASE WHEN bool_or(starts_with(lower(name), 'www.')) THEN 15 ELSE 0 END
    - CASE WHEN url_group IN ('/{{slug}}', '/{{num}}') THEN 8 ELSE 0 END"""
_CITY = "['Las Vegas, NV', 'Austin, TX', 'Orlando, FL', 'Chicago, IL', 'Atlanta, GA', 'Denver, CO', 'Toronto, ON'][c_nationkey % 7 + 1]"
_SITE_PAGES = f"""
    a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'hot' ELSE CAST(c_custkey // {sites.BLOCK} AS VARCHAR) END AS part,
                 CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % {sites.BLOCK} END AS inside FROM customer),
    b AS (SELECT k, c_nationkey, c_nationkey % 3 AS mode, concat('https://expo-', c_nationkey, '-', part, '.example.com/exhibitors') AS base, inside // {sites.PAGE_KEYS} + 1 AS page FROM a),
    d AS (SELECT DISTINCT c_nationkey, CASE WHEN mode = 2 THEN concat(base, '/page/', page) WHEN page = 1 THEN base ELSE concat(base, '?page=', page) END AS url FROM b)"""

ORACLES = {
    "page_links": f"""WITH {_LINKS} SELECT url, ord, absolute_url, {Q.norm("replace(raw, '&amp;', '&')")} AS text, 1 AS in_nav FROM l""",
    "page_signal_counts": f"""WITH {_UNIQUE}
        SELECT {_PAGE_URL} AS url, {Q.norm("replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&amp;', '&')")} AS title,
            {Q.norm("replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&amp;', '&')")} AS h1,
            len(regexp_extract_all(html, '<a href=')) AS anchors, len(regexp_extract_all(html, '<li><a href=')) AS items FROM pages""",
    "link_strategies_by_site": f"""
        WITH {_SITE},
        p AS (SELECT host, url_group, u, arg_max(name, struct_pack(d := dom, l := length(name), o := -ord)) AS name, min(ord) AS o FROM k GROUP BY ALL),
        g AS (SELECT host, url_group, count(*) AS n, count(*) * 12 + count(DISTINCT lower(name)) / count(*) * 30 + {_BONUS} AS s, min(o) AS o, 0 AS fb,
                array_to_string(list_transform(list_sort(list(struct_pack(o := o, u := u, n := name)))[1:3], lambda x: x.n), '|') AS names FROM p GROUP BY host, url_group HAVING count(*) >= 3),
        f AS (SELECT host, '*' AS url_group, count(DISTINCT u) AS n, count(DISTINCT u) * 12 + count(DISTINCT lower(name)) / count(DISTINCT u) * 20 + 5 AS s, 0 AS o, 1 AS fb,
                array_to_string(list_transform(list_sort(list(struct_pack(o := ord, u := u, n := name)))[1:3], lambda x: x.n), '|') AS names FROM k GROUP BY host HAVING count(DISTINCT u) >= 3),
        a AS (SELECT * FROM g UNION ALL SELECT * FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY s DESC, n DESC, fb, o, url_group) AS rank FROM a)
        SELECT host, url_group, n AS unique_urls, round(s, 6) AS base_score, rank, names AS sample_names FROM r""",
    "best_links_per_url": f"""
        WITH {_SITE} SELECT host, u AS url, arg_max(name, struct_pack(d := dom, l := length(name), o := -ord)) AS name, min(ord) AS first_ord FROM k GROUP BY host, u""",
    "page_param_links": f"""WITH {_UNIQUE} SELECT coalesce({Q.page_number('url')}, 1) AS page_number, 'generic' AS platform, count(*) AS n FROM pages GROUP BY ALL""",
    "best_frames": """
        SELECT concat('https://land-', c_custkey, '.example.com/') AS url, CASE c_custkey % 5 WHEN 0 THEN concat('https://show', c_custkey, '.expofp.com/')
            ELSE concat('https://land-', c_custkey, '.example.com/vendor-frame') END AS frame_url FROM customer WHERE c_custkey % 5 IN (0, 1)""",
    "best_directory_links": """
        SELECT concat('https://land-', c_custkey, '.example.com/') AS url, CASE c_custkey % 4 WHEN 0 THEN concat('https://land-', c_custkey + 1, '.example.com/')
            ELSE concat('https://land-', c_custkey, '.example.com/brands') END AS link_url FROM customer WHERE c_custkey % 4 IN (0, 2)""",
    "resolved_seeds": """
        SELECT concat('https://land-', c.c_custkey, '.example.com/') AS seed_url,
            concat('https://land-', CASE WHEN c.c_custkey % 4 = 0 AND c.c_custkey % 5 NOT IN (0, 1) AND d.c_custkey IS NOT NULL THEN c.c_custkey + 1 ELSE c.c_custkey END, '.example.com/') AS resolved_url
        FROM customer c LEFT JOIN customer d ON d.c_custkey = c.c_custkey + 1""",
    "image_ranking": """
        SELECT concat('https://land-', c_custkey, '.example.com/') AS url, concat('https://land-', c_custkey, '.example.com/img/exhibitor-list-', c_custkey, '.jpg') AS absolute_url,
            CAST(1 AS INT) AS image_rank, CAST(20 + 18 + 35 + 12 + CASE WHEN (300 + c_custkey % 5 * 100) * 500 >= 250000 THEN 18 ELSE 0 END AS DOUBLE) AS score, 1 AS worthy FROM customer
        UNION ALL SELECT concat('https://land-', c_custkey, '.example.com/'), concat('https://land-', c_custkey, '.example.com/img/hero.png'), 2, CAST(56 AS DOUBLE), 0 FROM customer""",
    "profile_websites": """
        SELECT concat('https://dir.example.com/co/', c_custkey) AS profile_url, CASE c_custkey % 9 WHEN 0 THEN concat('https://amber', c_custkey, '.com/')
            WHEN 1 THEN concat('https://amberworks', c_custkey, '.com/') WHEN 2 THEN concat('https://www.amberworks', c_custkey, '.com/?a=1')
            WHEN 6 THEN 'https://amberworks.example.net' WHEN 7 THEN 'https://amber.vendor.io/' WHEN 8 THEN 'https://agency.example.org/' ELSE '' END AS website_url FROM customer""",
    "company_site_names": """
        SELECT concat('https://www.cedarglass', c_custkey, '.com/') AS lookup_url, CASE c_custkey % 6 WHEN 0 THEN 'Cedar Glass & Co' WHEN 1 THEN 'Cedar Glass'
            WHEN 2 THEN 'Cedar Glass Studio' WHEN 3 THEN 'Cedar Glass' ELSE '' END AS site_name
        FROM customer WHERE c_custkey % 6 < 5""",
    "meta_tags": """
        SELECT concat('https://www.cedarglass', c_custkey, '.com/') AS url, 0 AS pos, CASE c_custkey % 6 WHEN 0 THEN 'og:site_name' ELSE 'application-name' END AS key,
            CASE c_custkey % 6 WHEN 0 THEN 'Cedar Glass & Co' ELSE 'Portal' END AS content FROM customer WHERE c_custkey % 6 < 2
        UNION ALL SELECT concat('https://www.cedarglass', c_custkey, '.com/'), 1, 'og:title', 'Cedar Glass' FROM customer WHERE c_custkey % 6 = 1""",
    "card_candidates": """
        WITH p AS (SELECT concat('https://cards-', c_custkey, '.example.com') AS h, c_custkey % 3 AS m, c_custkey AS k, c_mktsegment AS s FROM customer),
        v(m, kind, sig, g, name, path) AS (VALUES
            (0, 'container', 'main>div.card', '/exhibitor/*', 'Amber Works', '/exhibitor/1'), (0, 'container', 'main>div.card', '/exhibitor/*', 'Boreal Foods', '/exhibitor/2'),
            (0, 'container', 'main>div.card', '/exhibitor/*', 'Cedar Glass', '/exhibitor/3'),
            (1, 'text_container', 'main>div.t', '#text', 'Amber Works map', '/exhibitors#a12-amber_works_map'), (1, 'text_container', 'main>div.t', '#text', 'Boreal Foods', '/exhibitors#b7-boreal_foods'),
            (1, 'text_container', 'main>div.t', '#text', 'Cedar Glass', '/exhibitors#c{K}-cedar_glass'),
            (2, 'anchor', 'main>ul>li.i>a', '/vendor/*', 'Amber Works', '/vendor/amber'), (2, 'anchor', 'main>ul>li.i>a', '/vendor/*', 'Boreal Foods', '/vendor/boreal'),
            (2, 'anchor', 'main>ul>li.i>a', '/vendor/*', 'Boreal Foods of {S}', '/vendor/boreal'), (2, 'anchor', 'main>ul>li.i>a', '/vendor/*', 'www.cedar.com', '/vendor/cedar'),
            (2, 'container', 'main>ul>li.i', '/vendor/*', 'Amber Works', '/vendor/amber'), (2, 'container', 'main>ul>li.i', '/vendor/*', 'Boreal Foods Boreal Foods of {S}', '/vendor/boreal'),
            (2, 'container', 'main>ul>li.i', '/vendor/*', 'Www.cedar.com', '/vendor/cedar'))
        SELECT concat(h, '/exhibitors?page=1') AS page, kind AS source_kind, sig AS signature, g AS url_group, replace(name, '{S}', s) AS name,
               concat(h, replace(path, '{K}', CAST(k % 90 AS VARCHAR))) AS url FROM p JOIN v USING (m)""",
    "enriched_names": """
        SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 7 = 0 THEN 'proper name here' ELSE 'Proper Name Here' END
            WHEN c_custkey % 7 = 0 THEN 'Cg-1' WHEN c_custkey % 6 = 0 THEN 'Cedar Glass & Co' WHEN c_custkey % 6 = 2 THEN 'Cedar Glass Studio' ELSE 'Cg-1' END AS company_name,
            CAST(c_custkey % 7 = 0 AS INT) AS looked_up FROM customer""",
    "card_strategies": """
        WITH v(m, kind, g, n, s, rank, names) AS (VALUES
            (0, 'container', '/exhibitor/*', 3, 107.0, 1, 'Amber Works|Boreal Foods|Cedar Glass'), (0, 'container', '*', 3, 82.0, 2, 'Amber Works|Boreal Foods|Cedar Glass'),
            (1, 'text_container', '#text', 3, 56.0, 1, 'Amber Works map|Boreal Foods|Cedar Glass'),
            (2, 'container', '/vendor/*', 3, 92.0, 1, 'Amber Works|Boreal Foods Boreal Foods of {S}|Www.cedar.com'), (2, 'container', '*', 3, 82.0, 2, 'Amber Works|Boreal Foods Boreal Foods of {S}|Www.cedar.com'),
            (2, 'anchor', '/vendor/*', 3, 81.0, 3, 'Amber Works|Boreal Foods of {S}|www.cedar.com'), (2, 'anchor', '*', 3, 67.666667, 4, 'Amber Works|Boreal Foods|Boreal Foods of {S}'))
        SELECT concat('https://cards-', c_custkey, '.example.com/exhibitors?page=1') AS page, kind AS source_kind, g AS url_group, n AS unique_urls,
            CAST(s AS DOUBLE) AS base_score, rank, replace(names, '{S}', c_mktsegment) AS sample_names FROM customer JOIN v ON c_custkey % 3 = m""",
    "event_places": f"""WITH {_SITE_PAGES}
        SELECT url, {_CITY} AS location, CAST(85 + 20 + 40 + 20 AS DOUBLE) AS score, 2 AS mentions FROM d""",
    "event_names": f"""WITH {_SITE_PAGES},
        n AS (SELECT c_custkey AS k, array_to_string([['Amber', 'Boreal', 'Cedar', 'Delta', 'Ember', 'Falcon', 'Granite', 'Harbor', 'Indigo', 'Juniper', 'Keystone', 'Lumen', 'Marble', 'Nimbus', 'Orchid', 'Prairie'][c_custkey % 16 + 1],
                ['Works', 'Foods', 'Textiles', 'Robotics', 'Lighting', 'Optics', 'Paper', 'Glass', 'Motors', 'Ceramics', 'Tools', 'Plastics', 'Fabrics', 'Organics', 'Metals', 'Audio'][c_custkey // 16 % 16 + 1],
                concat(c_mktsegment[1], lower(c_mktsegment[2:]))], ' ') AS name FROM customer),
        q AS (SELECT concat(base, '/company/', b.k) AS url, name, concat('Harbor Expo ', c_nationkey) AS ev FROM b JOIN n USING (k)),
        w AS (SELECT url, name, ev, unnest([name, ev, concat(name, ' | ', ev)]) AS c, unnest([0, 1, 2]) AS pos FROM q),
        z AS (SELECT url, arg_max(c, struct_pack(s := {Q.conference_score('c')}, p := -pos)) AS best FROM w WHERE {Q.conference_score('c')} IS NOT NULL GROUP BY url),
        y AS (SELECT url, unnest(list_concat([best], {"list_filter(string_split(best, ' | '), lambda p: p <> '')"})) AS c FROM z),
        l AS (SELECT url, arg_max(c, {Q.conference_score('c')}) AS conference FROM y GROUP BY url)
        SELECT url, conference FROM l UNION ALL SELECT url, concat('Harbor Expo ', c_nationkey) FROM d""",
}
