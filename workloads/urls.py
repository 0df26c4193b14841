"""URL expressions over page addresses and over address forms derived from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.functions import text as T, url as U
from workloads import duck as Q

# Address forms, as SQL that both engines read.
FORMS = """CASE c_custkey % 10
    WHEN 0 THEN concat('HTTPS://WWW.Site', c_custkey, '.COM/Path/', c_custkey, '?page=2&ID=7#frag')
    WHEN 1 THEN concat('http://shop.brand-', c_custkey % 50, '.org/a/b/index.html?utm=1')
    WHEN 2 THEN concat('https://m.facebook.com/p', c_custkey)
    WHEN 3 THEN 'ftp://files.example.com/x'
    WHEN 4 THEN concat(' https://cdn.example.net/img/', c_custkey, '.PNG ')
    WHEN 5 THEN concat('https://netflix.com/title/', c_custkey)
    WHEN 6 THEN 'mailto:a@example.com'
    WHEN 7 THEN concat('https://get-amber.co.uk:8443/list/page/', c_custkey % 9, '/?q=a&paged=4')
    WHEN 8 THEN concat('https://example.org/', c_custkey)
    ELSE concat('https://www.getcedarglass', c_custkey % 30, '.com') END"""
REFERENCES = """CASE c_custkey % 8
    WHEN 0 THEN concat('/co/', c_custkey) WHEN 1 THEN concat('../up/', c_custkey, '?x=1#y') WHEN 2 THEN concat('item', c_custkey)
    WHEN 3 THEN '?page=3' WHEN 4 THEN '//cdn.example.org/z' WHEN 5 THEN '#top' WHEN 6 THEN 'javascript:void(0)'
    ELSE concat('https://other.example.com/', c_custkey) END"""


def customers(spark, sf_dir, **columns):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select("*", *[F.expr(sql).alias(name) for name, sql in columns.items()])


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def url_normalize(spark, sf_dir):
    both = pages(spark, sf_dir).select(F.col("page_id").alias("key"), F.lit("page").alias("src"), "url").unionByName(
        customers(spark, sf_dir, url=FORMS).select(F.col("c_custkey").alias("key"), F.lit("form").alias("src"), "url")
    )
    return both.select("key", "src", U.normalize_http_url("url").alias("normalized"))


def url_host(spark, sf_dir):
    return customers(spark, sf_dir, url=FORMS).select(F.col("c_custkey").alias("key"), U.host_key("url").alias("host"))


def url_shapes(spark, sf_dir):
    both = pages(spark, sf_dir).select(F.col("page_id").alias("key"), F.lit("page").alias("src"), "url").unionByName(
        customers(spark, sf_dir, url=FORMS).select(F.col("c_custkey").alias("key"), F.lit("form").alias("src"), F.trim("url").alias("url"))
    )
    return both.select(
        "key", "src", U.url_group("url").alias("url_group"), F.coalesce(U.page_number("url"), F.lit(-1)).alias("page_number")
    )


def url_flags(spark, sf_dir):
    rows = customers(spark, sf_dir, url=FORMS).withColumn("url", F.trim("url"))
    return rows.select(
        F.col("c_custkey").alias("key"),
        U.looks_like_asset("url").cast("int").alias("is_asset"),
        U.is_social_url("url").cast("int").alias("is_social"),
        U.same_site("url", F.lit("https://example.org/")).cast("int").alias("same_site"),
        F.coalesce(U.lookup_url("url"), F.lit("")).alias("lookup_url"),
    )


def page_series_counts(spark, sf_dir):
    series = pages(spark, sf_dir).select(U.page_series("url").alias("s"))
    params = F.array_join(F.transform("s.params", lambda p: F.concat_ws("=", p["key"], p["value"])), "&")
    return series.groupBy(F.col("s.host").alias("host"), F.col("s.path").alias("path"), params.alias("params")).agg(
        F.count("*").alias("n")
    )


def page_url_builder(spark, sf_dir):
    number = (F.col("page_id") % 7 + 2).cast("bigint")
    return pages(spark, sf_dir).select(
        "page_id",
        U.query_page_url("url", "page", number).alias("by_query"),
        U.path_page_url(U.normalize_http_url("url"), number).alias("by_path"),
    )


def url_resolve(spark, sf_dir):
    rows = customers(spark, sf_dir, ref=REFERENCES).withColumn(
        "base", F.concat(F.lit("https://dir.example.com/a/b/list"), F.col("c_custkey").cast("string"), F.lit("?s=1"))
    )
    return rows.select(
        F.col("c_custkey").alias("key"), U.resolve_url("base", "ref").alias("resolved"),
        U.resolve_target("base", "ref").alias("target"),
    )


def url_names(spark, sf_dir):
    return customers(spark, sf_dir, url=FORMS).select(
        F.col("c_custkey").alias("key"), U.infer_name_from_url("url").alias("name")
    )


def profile_urls(spark, sf_dir):
    rows = customers(spark, sf_dir).select(
        F.col("c_custkey").alias("key"),
        F.concat(F.lit("https://show.example.com/"), F.when(F.col("c_custkey") % 2 == 0, F.lit("8_0/")).otherwise(""),
                 F.lit("exhibitors?alpha=A&x=1")).alias("seed"),
        F.concat(F.lit("ID "), F.col("c_custkey").cast("string")).alias("id"), "c_name",
    )
    return rows.select(
        "key",
        U.gallery_profile_url("seed", "id").alias("gallery"),
        U.floorplan_profile_url("seed", "id").alias("floorplan"),
        U.app_profile_url("seed", F.lit("my show"), F.col("id")).alias("app"),
        U.search_url("seed", F.col("key") % 10 * 50, F.lit(50)).alias("search"),
        U.text_fragment_url("seed", F.col("c_name"), F.concat(F.lit("B"), (F.col("key") % 90).cast("string"))).alias("fragment"),
    )


def line_urls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", U.line_url("line").alias("url")).filter("url <> ''")


def paginator_offsets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 40).cast("int").alias("size"),
        (F.col("o_custkey") % 500).cast("int").alias("total"), (F.col("o_orderkey") % 3 * 10).cast("int").alias("next_offset"),
        (F.col("o_orderkey") % 6).cast("int").alias("page"),
    )
    return rows.select(
        "key", U.ajax_total_pages(F.col("size"), F.col("total")).alias("pages"),
        U.ajax_offset(F.col("size"), F.col("next_offset"), F.col("page")).alias("page_offset"),
    )


QUERIES = {
    "url_normalize": url_normalize, "url_host": url_host, "url_shapes": url_shapes, "url_flags": url_flags,
    "page_series_counts": page_series_counts, "page_url_builder": page_url_builder, "url_resolve": url_resolve,
    "url_names": url_names, "profile_urls": profile_urls, "line_urls": line_urls, "paginator_offsets": paginator_offsets,
}

_FORMS = f"(SELECT c_custkey AS key, {FORMS} AS url FROM customer)"
_ASSETS = "|".join(rules.ASSET_EXTENSIONS)
_HOST_ONLY = "concat(lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)), '://', regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PREFIX = "^(?:" + "|".join(rules.HOST_LABEL_PREFIXES) + ")(.{3,})$"
_LINE = rules.LINE_URL.replace("'", "''")

ORACLES = {
    "url_normalize": f"""
        SELECT page_id AS key, 'page' AS src, {Q.normalized('url')} AS normalized FROM pages
        UNION ALL SELECT key, 'form', {Q.normalized('url')} FROM {_FORMS}""",
    "url_host": f"SELECT key, {Q.host('url')} AS host FROM {_FORMS}",
    "url_shapes": f"""
        WITH r AS (SELECT page_id AS key, 'page' AS src, url FROM pages UNION ALL SELECT key, 'form', trim(url) FROM {_FORMS})
        SELECT key, src, CASE WHEN url = 'mailto:a@example.com' THEN '/{{slug}}' ELSE {Q.url_group('url')} END AS url_group,
               coalesce({Q.page_number('url')}, -1) AS page_number FROM r""",
    "url_flags": f"""
        WITH r AS (SELECT key, trim(url) AS url, {Q.host('url')} AS h, {Q.normalized('url')} AS u FROM {_FORMS})
        SELECT key, CAST(regexp_matches(lower({Q.path('url')}), '\\.(?:{_ASSETS})$') AS INT) AS is_asset,
               CAST(regexp_matches(h, '{Q.alternatives(rules.SOCIAL_HOSTS)}') AS INT) AS is_social,
               CAST(h = 'example.org' OR ends_with(h, '.example.org') AS INT) AS same_site,
               CASE WHEN u IS NULL THEN url WHEN {Q.path('u')} NOT IN ('', '/') OR {Q.query('u')} <> '' THEN concat({_HOST_ONLY}, '/')
                    ELSE u END AS lookup_url FROM r""",
    "page_series_counts": f"""
        WITH r AS (SELECT {Q.host('url')} AS host,
            regexp_replace(lower({Q.path('url')}), '/page/[0-9]+/?$', '/page/{{page}}') AS path,
            array_to_string(list_sort(list_transform(list_filter({Q.pairs('url')}, lambda p: NOT {Q.page_param('split_part(p, chr(61), 1)')}),
                lambda p: concat(lower(split_part(p, chr(61), 1)), '=', split_part(p, chr(61), 2)))), '&') AS params FROM pages)
        SELECT host, path, params, count(*) AS n FROM r GROUP BY ALL""",
    "page_url_builder": f"""
        WITH r AS (SELECT page_id, url AS u, page_id % 7 + 2 AS n, {Q.path('url')} AS p, {Q.query('url')} AS q FROM pages)
        SELECT page_id,
            concat({_HOST_ONLY}, p, '?', array_to_string(list_append(list_filter(string_split(q, '&'),
                lambda x: x <> '' AND lower(split_part(x, '=', 1)) <> 'page'), concat('page=', n)), '&')) AS by_query,
            concat({_HOST_ONLY}, regexp_replace(p, '/+$', ''), '/page/', n, CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) AS by_path
        FROM r""",
    "url_resolve": """
        WITH r AS (SELECT c_custkey AS key, c_custkey % 8 AS m, concat('https://dir.example.com/a/b/list', c_custkey) AS page FROM customer)
        SELECT key, CASE m WHEN 0 THEN concat('https://dir.example.com/co/', key) WHEN 1 THEN concat('https://dir.example.com/a/up/', key, '?x=1')
            WHEN 2 THEN concat('https://dir.example.com/a/b/item', key) WHEN 3 THEN concat(page, '?page=3') WHEN 4 THEN 'https://cdn.example.org/z'
            WHEN 5 THEN concat(page, '?s=1') WHEN 6 THEN NULL ELSE concat('https://other.example.com/', key) END AS resolved,
          CASE m WHEN 0 THEN concat('https://dir.example.com/co/', key) WHEN 1 THEN concat('https://../up/', key, '?x=1')
            WHEN 2 THEN concat('https://dir.example.com/a/b/item', key) WHEN 3 THEN concat(page, '?page=3') WHEN 4 THEN 'https://cdn.example.org/z'
            WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE concat('https://other.example.com/', key) END AS target FROM r""",
    "url_names": f"""
        WITH a AS (SELECT key, split_part({Q.host('url')}, '.', 1) AS l FROM {_FORMS}),
        b AS (SELECT key, CASE WHEN regexp_matches(l, '{_PREFIX}') THEN regexp_extract(l, '{_PREFIX}', 1) ELSE l END AS l FROM a),
        c AS (SELECT key, {Q.norm("regexp_replace(regexp_replace(regexp_replace(l, '[-_]', ' ', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')")} AS n FROM b)
        SELECT key, {Q.fix_lower('n')} AS name FROM c""",
    "profile_urls": """
        WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN '/8_0' ELSE '' END AS v, lower(replace(c_name, '#', '_')) AS slug FROM customer)
        SELECT key, concat('https://show.example.com', v, '/exhibitor/exhibitor-details.cfm?exhid=ID+', key) AS gallery,
            concat('https://show.example.com', v, '/exhibitors?alpha=A&x=1#exhibitor=ID%20', key) AS floorplan,
            concat('https://show.example.com/event/my%20show/exhibitor/ID%20', key) AS app,
            concat('https://show.example.com', v, '/ajax/remote-proxy.cfm?action=search&searchtype=exhibitorgallery&searchsize=50&start=', key % 10 * 50, '&alpha=A') AS search,
            concat('https://show.example.com', v, '/exhibitors?alpha=A&x=1#b', key % 90, '-', slug) AS fragment FROM r""",
    "line_urls": f"""
        WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
        t AS (SELECT doc_id, line_no, regexp_extract(line, '{_LINE}') AS token FROM l)
        SELECT doc_id, line_no, CASE WHEN regexp_matches(token, '^https?://') THEN {Q.normalized('token')}
            ELSE {Q.normalized("concat('https://', token)")} END AS url FROM t WHERE token <> ''""",
    "paginator_offsets": """
        WITH r AS (SELECT o_orderkey AS key, o_custkey % 40 AS size, o_custkey % 500 AS total, o_orderkey % 3 * 10 AS nxt, o_orderkey % 6 AS page FROM orders)
        SELECT key, CASE WHEN size <= 0 OR total <= 0 THEN 1 ELSE greatest(1, CAST(ceil(total / size) AS INT)) END AS pages,
            CASE WHEN page <= 1 THEN 0 ELSE CASE WHEN nxt > 0 THEN nxt ELSE size END + (page - 2) * size END AS page_offset FROM r""",
}
