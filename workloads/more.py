"""Further forms: scripted paginators end to end, rendered profiles, platforms, file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallworks.functions import text as T, url as U
from stallworks.operators import crawl, lines, listing, websites
from stallworks.plans import directory
from stallworks.sources import embedded as E, pages as P, signals as G
from workloads import duck as Q, shared, sites
from workloads.directories import _BASE


def ajax_pages(spark, sf_dir):
    """Seed pages with a scripted paginator, and the answers for their later pages."""
    rows = sites.companies(spark, sf_dir)
    card = F.format_string('<li class="c"><a href="/company/%d">%s</a></li>', "key", "name")
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", card.alias("card")))), lambda s: s["card"]), "")
    pages = rows.groupBy("site", "page_no").agg(cards.alias("cards"))
    totals = rows.groupBy("site").agg(F.max("page_no").alias("total"))
    seed = F.concat(F.lit("https://a"), "site", F.lit(".example.com/list"))
    listed = pages.join(totals, "site").withColumn("seed_url", seed)
    script = F.concat(
        F.lit("<script>$('#l').jsPaginator({'module': 'dir', 'method': 'list', 'limit': 500, 'offset': 500}, {'pageID': 'pp'}, "),
        (F.col("total") * 500).cast("string"), F.lit("); var tk = 'a'; var tm = 'b';</script>"),
    )
    seeds = listed.filter("page_no = 1").select(
        F.col("seed_url").alias("url"),
        F.concat(F.lit("<html><body><main><ul>"), "cards", F.lit("</ul></main>"), script, F.lit("</body></html>")).alias("html"),
    )
    answers = listed.filter("page_no > 1").select(
        "seed_url", F.lit("pp").alias("page_id"), ((F.col("page_no") - 1) * 500).cast("int").alias("page_offset"),
        F.replace(F.url_encode(F.concat(F.lit("<main><ul>"), "cards", F.lit("</ul></main>"))), F.lit("+"), F.lit("%20")).alias("data"),
    )
    return seeds, answers


def paginator_entries(spark, sf_dir):
    """Entries of directories whose later pages come from a scripted paginator."""
    pages = shared.written(spark, sf_dir, "ajax_pages", lambda: ajax_pages(spark, sf_dir)[0])
    answers = shared.written(spark, sf_dir, "ajax_answers", lambda: ajax_pages(spark, sf_dir)[1])
    signals = shared.written(spark, sf_dir, "ajax_signals", lambda: G.page_signals(shared.spread(spark, pages)))
    none = F.lit(None).cast("int")
    seeds = pages.select(F.col("url").alias("seed_url"), none.alias("start_page"), none.alias("end_page"))
    found = directory.directory_candidates(seeds, pages, signals, fragments=answers)
    return directory.directory_entries(found).select("seed_url", "sort_index", "directory_page", "company_name", "profile_url")


def rendered_profiles(spark, sf_dir):
    """Second look for records without website in a table of rendered profiles."""
    k = F.col("key")
    rows = sites.companies(spark, sf_dir)
    records = rows.select("key", F.col("name").alias("company_name"), "profile_url", F.when(k % 2 == 0, F.col("website")).otherwise("").alias("website_url"))
    rendered = rows.filter(k % 3 > 0).select("profile_url", "website")
    rendered = rendered.withColumnRenamed("website", "website_url")
    return websites.resolve_blank_from_rendered(records, rendered).select("key", "website_url")


def platform_tags(spark, sf_dir):
    url = F.expr("""CASE c_custkey % 5 WHEN 0 THEN concat('https://s', c_custkey, '.mapyourshow.com/8_0/') WHEN 1 THEN concat('https://f', c_custkey, '.expofp.com/')
        WHEN 2 THEN 'https://app.swapcard.com/event/x' WHEN 3 THEN concat('https://s', c_custkey, '.mapyourshow.com/x') ELSE concat('https://h', c_custkey, '.example.com/') END""")
    html = F.expr("""CASE c_custkey % 5 WHEN 0 THEN 'remote-proxy.cfm?action=search getExhibitorURL searchtype:"exhibitorgallery"'
        WHEN 1 THEN '<div class="expofp-floorplan" data-data-url="data/"></div><script src="data/version.js">' ELSE '<html></html>' END""")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    # written, as filters would move in front of the exchange
    rows = shared.written(spark, sf_dir, "platform_pages", lambda: shared.spread(spark, keys).select(F.col("c_custkey").alias("key"), url.alias("url"), html.alias("html")))
    data = E.floorplan_data_urls(rows)
    tagged = rows.select("key", "url", P.platform("url", "html").alias("platform"))  # before the join, which may end in few tasks
    return tagged.join(data, "url", "left").select("key", "platform", "data_url")


def media_names(spark, sf_dir):
    stem = F.expr("""CASE c_custkey % 5 WHEN 0 THEN concat('acme_workslogo', c_custkey, '.png') WHEN 1 THEN 'BlueSkyCo-final_new.jpeg' WHEN 2 THEN 'media/north%20star-logo.svg'
        WHEN 3 THEN concat('IMG ', 1000 + c_custkey) ELSE '' END""")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("key"), T.clean_media_stem(stem).alias("name"),
        T.slug(F.concat(F.lit("--"), "c_name", F.lit(" Ünï! "))).alias("slug"), T.slug(F.col("c_name"), "-", None).alias("short"),
        T.positive_int(F.concat("c_name", F.lit("px"))).alias("number"),
        T.display_text(F.lit("  "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.col("c_name")).alias("shown"),
        F.array_join(T.distinct_texts(F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.lit(" "), F.col("c_name"))), "|").alias("texts"),
    )


def brandish_names(spark, sf_dir):
    text = F.expr("concat('Fine ', lower(c_mktsegment), CASE c_custkey % 3 WHEN 0 THEN concat(' by Amber ', c_mktsegment) WHEN 1 THEN ' from Boreal by Cedar' ELSE '' END)")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), T.brandish_candidates(text).alias("names"))
    return rows.select("key", F.posexplode("names").alias("pos", "name"))


QUERIES = {f.__name__: f for f in (paginator_entries, rendered_profiles, platform_tags, media_names, brandish_names)}

ORACLES = {
    "paginator_entries": f"""
        WITH {_BASE} SELECT concat('https://a', site, '.example.com/list') AS seed_url, row_number() OVER (PARTITION BY site ORDER BY page, lower(name), k) - 1 AS sort_index,
            page AS directory_page, name AS company_name, concat('https://a', site, '.example.com/company/', k) AS profile_url FROM c WHERE first_page >= 3""",
    "rendered_profiles": f"""WITH {_BASE} SELECT k AS key, CASE WHEN k % 2 = 0 AND website <> '' THEN website WHEN k % 3 > 0 AND k % 5 > 0 AND k % 7 > 0 THEN website ELSE '' END AS website_url FROM c""",
    "platform_tags": """
        SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN 'mapyourshow' WHEN 1 THEN 'expofp' WHEN 2 THEN 'swapcard' ELSE 'generic' END AS platform,
            CASE WHEN c_custkey % 5 = 1 THEN concat('https://f', c_custkey, '.expofp.com/data/data.js') END AS data_url FROM customer""",
    "media_names": """
        SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey < 10 THEN concat('acme workslogo ', c_custkey) ELSE 'acme workslogo' END WHEN 1 THEN 'Blue Sky Co' WHEN 2 THEN 'north star'
            WHEN 3 THEN 'IMG' ELSE '' END AS name, concat(replace(lower(c_name), '#', '_'), '_n') AS slug, replace(lower(c_name), '#', '-') AS short, c_custkey AS number,
            CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS shown, concat(c_mktsegment, '|', c_name) AS texts FROM customer""",
    "brandish_names": """
        WITH r AS (SELECT c_custkey AS k, c_mktsegment AS m, concat('Fine ', lower(c_mktsegment)) AS f FROM customer),
        l AS (SELECT k, CASE k % 3 WHEN 0 THEN [concat(f, ' by Amber ', m), concat('Amber ', m)] WHEN 1 THEN [concat(f, ' from Boreal by Cedar'), 'Cedar', 'Boreal by Cedar'] ELSE [f] END AS x FROM r)
        SELECT k AS key, unnest(range(len(x))) AS pos, unnest(x) AS name FROM l""",
}
