"""Text and date expressions over names derived from customers, document lines and order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.functions import dates as D, scores as S, text as T, url as U
from stallworks.operators import names
from workloads import duck as Q

NAMES = """CASE c_custkey % 16
    WHEN 0 THEN concat('acme furniture ', c_custkey) WHEN 1 THEN concat('Blue ', c_mktsegment, ' Logo')
    WHEN 2 THEN 'gm' WHEN 3 THEN concat('Tom &amp; Sons (', c_custkey % 9, ')') WHEN 4 THEN 'North Star USA (US)'
    WHEN 5 THEN 'Open Menu Search Cart' WHEN 6 THEN concat('IMAGE ', c_custkey % 5) WHEN 7 THEN 'view all'
    WHEN 8 THEN concat(c_name, ' International') WHEN 9 THEN '3M' WHEN 10 THEN concat('page ', c_custkey)
    WHEN 11 THEN 'Silver monogram  Works' WHEN 12 THEN concat('Exhibitor list ', c_mktsegment)
    WHEN 13 THEN 'The Home Store Company Inc' WHEN 14 THEN concat('a1b2c3d', c_custkey)
    ELSE concat('Delta ', lower(c_mktsegment), ' Group') END"""
CARDS = """CASE c_custkey % 6
    WHEN 0 THEN concat('A', c_custkey % 900, ' Amber ', lower(c_mktsegment), ' New Exhibitor image')
    WHEN 1 THEN concat('Cedar Works ', lower(c_mktsegment)) WHEN 2 THEN 'Clear filters'
    WHEN 3 THEN 'Exhibitor Directory' WHEN 4 THEN concat('BX', c_custkey % 99, 'C-12 Ember Glass -')
    ELSE concat('One two three four five six seven eight nine ten eleven ', c_mktsegment) END"""
TITLES = """CASE c_custkey % 6
    WHEN 0 THEN concat('Harbor Expo ', c_custkey, ' | Exhibitor Directory') WHEN 1 THEN 'Vendor Directory'
    WHEN 2 THEN concat('Exhibitors - ', c_mktsegment, ' Trade Show') WHEN 3 THEN concat('Search for all vendors: Boat Fair ', c_custkey)
    WHEN 4 THEN 'Home' ELSE concat(lower(c_mktsegment), ' summit') END"""
PLACES = """CASE c_custkey % 6
    WHEN 0 THEN 'Held in LAS VEGAS, NV and Austin, Texas' WHEN 1 THEN 'Toronto, Ontario; Toronto, ON'
    WHEN 2 THEN 'Paris, France' WHEN 3 THEN concat('Booth ', c_custkey, ' New Orleans, LA 70130')
    WHEN 4 THEN 'no place here' ELSE 'From Boston, Massachusetts to Portland, OR' END"""
ERRORS = """CASE event_type WHEN 'error' THEN concat('curl: Could not resolve host: h', user_id)
    WHEN 'click' THEN concat('HTTP 429 for user ', user_id) WHEN 'view' THEN 'Could not infer company/profile links from page'
    WHEN 'signup' THEN concat('long  text ', repeat(concat('x', user_id % 10, ' '), 80)) ELSE 'browser fallback is unavailable' END"""


def customers(spark, sf_dir, sql):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("key"), F.expr(sql).alias("t")
    )


def company_name_clean(spark, sf_dir):
    return customers(spark, sf_dir, NAMES).select("key", T.clean_company_name("t").alias("name"))


def name_flags(spark, sf_dir):
    flags = {
        "companyish": T.is_companyish("t"), "machine": T.is_machine_name("t"),
        "low_confidence": T.is_low_confidence_name("t"), "generic_label": T.is_generic_directory_label("t"),
        "richtext_line": T.is_richtext_company_line("t"),
    }
    return customers(spark, sf_dir, NAMES).select("key", *[c.cast("int").alias(n) for n, c in flags.items()])


def document_line_flags(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(T.is_companyish("line")).alias("companyish"),
        F.count_if(T.is_machine_name("line")).alias("machine"),
    )


def brand_tokens(spark, sf_dir):
    return customers(spark, sf_dir, NAMES).select(
        "key", F.array_join(T.brand_tokens("t"), " ").alias("tokens"), T.brand_acronym("t").alias("acronym"),
        T.brand_key("t").alias("brand_key"),
    )


def booth_cards(spark, sf_dir):
    return customers(spark, sf_dir, CARDS).select("key", T.booth_and_name("t").alias("p")).select("key", "p.name", "p.booth")


def conference_labels(spark, sf_dir):
    return customers(spark, sf_dir, TITLES).select("key", T.conference_label("t").alias("label"))


def place_pairs(spark, sf_dir):
    rows = customers(spark, sf_dir, PLACES).select("key", F.posexplode(T.city_region_pairs("t")).alias("pos", "p"))
    return rows.select("key", "pos", "p.city", "p.region")


def error_summaries(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", T.error_summary(F.expr(ERRORS)).alias("summary"))


def name_domain_match(spark, sf_dir):
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nat = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(F.col("s_suppkey").alias("key"), F.expr(
        "concat(element_at(array('Amber', 'Boreal', 'Cedar'), CAST(s_suppkey % 3 + 1 AS INT)), ' Works ', n_nationkey)"
    ).alias("name"), F.expr(
        "element_at(array('https://www.amberworks.com/', 'https://shop.boreal.net', 'https://bw.org/', 'https://ambition.com'), CAST(s_suppkey % 4 + 1 AS INT))"
    ).alias("url"))
    return rows.select(
        "key", S.name_matches_domain("name", "url").cast("int").alias("matches"),
        S.brand_match("name", "url").cast("int").alias("brand"), S.validated_website("name", "url").alias("website"),
    )


def show_dates(spark, sf_dir):
    forms = ["yyyy-MM-dd", "M/d/yyyy", "MM/dd/yy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d", "MMMM d,"]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("d"))
    text = F.lit("TBD")
    for position, form in enumerate(forms):
        text = F.when(F.col("key") % 10 == position, F.date_format("d", form)).otherwise(text)
    parsed = rows.withColumn("event_date", D.parse_show_date(text, F.to_date(F.lit("2026-12-01"))))
    return parsed.select(
        "key", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        F.date_format(D.run_at("event_date", F.lit(14)), "yyyy-MM-dd HH:mm").alias("run_at"),
        D.pretty_day("event_date").alias("pretty"),
    )


def page_titles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = T.normalize_text(T.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return pages.select("page_id", F.posexplode(T.split_title(title)).alias("pos", "part"))


def conference_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", T.normalize_text(T.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title"),
        F.array(T.normalize_text(T.unescape(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)))).alias("h1_texts"),
    )
    return pages.select("page_id", names.conference_name("url", "title", "h1_texts").alias("conference"))


QUERIES = {
    "company_name_clean": company_name_clean, "name_flags": name_flags, "document_line_flags": document_line_flags,
    "brand_tokens": brand_tokens, "booth_cards": booth_cards, "conference_labels": conference_labels,
    "place_pairs": place_pairs, "error_summaries": error_summaries, "name_domain_match": name_domain_match,
    "show_dates": show_dates, "page_titles": page_titles, "conference_names": conference_names,
}

_CLEAN = f"""
    a AS (SELECT c_custkey AS key, {NAMES} AS t FROM customer),
    b AS (SELECT key, t, {Q.scrubbed('t')} AS s FROM a),
    n AS (SELECT key, t, {Q.fix_lower('s')} AS name FROM b)"""
_TITLE = Q.norm("replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&amp;', '&')")
_H1 = Q.norm("replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&amp;', '&')")
_PARTS = "list_filter(list_transform(regexp_split_to_array({0}, '\\s*[|\\-:–—]\\s*'), lambda p: {1}), lambda p: p <> '')"
_DIR = rules.CONFERENCE_DIRECTORY
_NOISE = rules.CONFERENCE_NOISE
_CITY = rules.CITY_REGION.replace("'", "''")
_REGION_ROWS = ", ".join(f"('{name}', '{abbr}')" for name, abbr in rules.REGIONS.items())
_STEMS = "len(list_filter(toks, lambda t: length(t) >= 4 AND (contains(hk, t[1:4]) OR len(list_filter(htoks, lambda h: length(h) >= 4 AND (contains(h, t[1:4]) OR contains(t, h)))) > 0))) > 0"


def _cleaned_label(value: str) -> str:
    out = f"regexp_replace(regexp_replace({value}, '{_DIR}', '', 'g'), '{_NOISE}', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '[\\s\\x{{00a0}}]+', ' ', 'g'), '^[ \\-|:,]+|[ \\-|:,]+$', '', 'g')"


ORACLES = {
    "company_name_clean": f"WITH {_CLEAN} SELECT key, name FROM n",
    "name_flags": f"""
        WITH {_CLEAN}, f AS (SELECT key, {Q.norm('t')} AS t, name, {Q.label('name')} AS lbl, {Q.label('t')} AS raw,
            list_filter(string_split(name, ' '), lambda w: w <> '') AS w FROM n)
        SELECT key, CAST({Q.companyish('t')} AS INT) AS companyish, CAST({Q.machine_name('raw')} AS INT) AS machine,
          CAST({Q.machine_name('lbl')} OR len(w) = 0 OR len(list_filter(w, lambda x: length(x) > 2)) = 0
            OR regexp_matches(lbl, 'logo|monogram|stacked|square') OR regexp_matches(name, '\\([0-9]+\\)$')
            OR coalesce(len(w) = 2 AND regexp_matches(w[2], '^[0-9]+$'), false)
            OR coalesce(len(w) = 1 AND length(w[1]) >= 4 AND NOT (w[1] = upper(w[1]) AND w[1] <> lower(w[1])), false) AS INT) AS low_confidence,
          CAST({Q.generic_label('raw')} AS INT) AS generic_label,
          CAST(name <> '' AND {Q.companyish('name')} AND NOT regexp_matches(lbl, '{Q.alternatives(rules.CALL_TO_ACTION_MARKERS)}') AS INT) AS richtext_line
        FROM f""",
    "document_line_flags": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
        n AS (SELECT doc_id, {Q.norm('raw')} AS t, {Q.label('raw')} AS lbl FROM l)
        SELECT doc_id, count(*) AS lines, count(*) FILTER ({Q.companyish('t')}) AS companyish,
               count(*) FILTER ({Q.machine_name('lbl')}) AS machine FROM n GROUP BY doc_id""",
    "brand_tokens": f"""
        WITH {_CLEAN}, l AS (SELECT key, {Q.label('name')} AS lbl FROM n), k AS (SELECT key, lbl, {Q.brand_tokens('lbl')} AS toks FROM l)
        SELECT key, array_to_string(toks, ' ') AS tokens,
            CASE WHEN len(toks) >= 2 THEN array_to_string(list_transform(toks, lambda t: t[1]), '') ELSE '' END AS acronym,
            {Q.brand_key('lbl')} AS brand_key FROM k""",
    "booth_cards": """
        SELECT c_custkey AS key, CASE c_custkey % 6 WHEN 0 THEN concat('Amber ', lower(c_mktsegment)) WHEN 1 THEN concat('Cedar Works ', lower(c_mktsegment))
            WHEN 4 THEN 'Ember Glass' ELSE '' END AS name,
          CASE c_custkey % 6 WHEN 0 THEN concat('A', c_custkey % 900) WHEN 4 THEN concat('BX', c_custkey % 99, 'C-12') ELSE '' END AS booth
        FROM customer""",
    "conference_labels": f"""
        WITH a AS (SELECT c_custkey AS key, {TITLES} AS t FROM customer),
        b AS (SELECT key, t, 0 AS pos, t AS c FROM a UNION ALL
              SELECT key, t, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT key, t, {_PARTS.format('t', Q.norm('p'))} AS p FROM a)),
        c AS (SELECT key, t, pos, {_cleaned_label('c')} AS c FROM b),
        d AS (SELECT key, c, {Q.conference_score('c')} AS s, pos FROM c WHERE c <> ''),
        e AS (SELECT key, arg_max(c, struct_pack(s := s, p := -pos)) AS best FROM d WHERE s IS NOT NULL GROUP BY key)
        SELECT a.key, coalesce(best, {_cleaned_label('t')}) AS label FROM a LEFT JOIN e ON a.key = e.key""",
    "place_pairs": f"""
        WITH r(name, abbr) AS (VALUES {_REGION_ROWS}),
        a AS (SELECT c_custkey AS key, {PLACES} AS t FROM customer),
        m AS (SELECT key, unnest(regexp_extract_all(t, '{_CITY}', 1)) AS city, unnest(regexp_extract_all(t, '{_CITY}', 2)) AS reg,
                     unnest(range(len(regexp_extract_all(t, '{_CITY}')))) AS i FROM a),
        p AS (SELECT m.key, i, CASE WHEN city = upper(city) THEN {Q.initcap('city')} ELSE city END AS city,
                     coalesce(x.abbr, y.abbr) AS region FROM m LEFT JOIN (SELECT DISTINCT abbr FROM r) x ON upper(reg) = x.abbr
                     LEFT JOIN r y ON lower(reg) = y.name),
        f AS (SELECT key, city, region, min(i) AS i FROM p WHERE region IS NOT NULL GROUP BY key, city, region)
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS pos, city, region FROM f""",
    "error_summaries": f"""
        WITH e AS (SELECT event_id, event_type AS k, {ERRORS} AS t FROM events), n AS (SELECT event_id, k, {Q.norm('t')} AS t FROM e)
        SELECT event_id, CASE k WHEN 'error' THEN 'An earlier worker run could not reach the site over the network. Retry the show now.'
            WHEN 'click' THEN 'Clay throttled the upload after the scrape finished. Retry later to resend the export.'
            WHEN 'view' THEN 'We reached the site, but the exhibitor layout still needs a source-specific extractor.'
            WHEN 'signup' THEN CASE WHEN length(t) > 170 THEN concat(t[1:167], '...') ELSE t END
            ELSE 'This event site may require browser rendering. Retry now that browser support is installed.' END AS summary FROM n""",
    "name_domain_match": f"""
        WITH a AS (SELECT s_suppkey AS key, concat(['Amber', 'Boreal', 'Cedar'][s_suppkey % 3 + 1], ' Works ', n_nationkey) AS raw,
                ['https://www.amberworks.com/', 'https://shop.boreal.net', 'https://bw.org/', 'https://ambition.com'][s_suppkey % 4 + 1] AS url,
                ['amberworks', 'shop', 'bw', 'ambition'][s_suppkey % 4 + 1] AS hk
              FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        b AS (SELECT key, url, hk, lower(regexp_replace(raw, ' [0-9]{{2,}}$', '')) AS lbl FROM a),
        c AS (SELECT key, url, hk, lbl, {Q.brand_tokens('lbl')} AS toks, CASE WHEN length(hk) >= 3 THEN [hk] ELSE [] END AS htoks,
                     replace(lbl, ' ', '') AS nk FROM b),
        d AS (SELECT *, len(list_filter(toks, lambda t: contains(hk, t))) > 0 OR {_STEMS}
                OR (len(toks) >= 2 AND contains(hk, array_to_string(list_transform(toks, lambda t: t[1]), '')))
                OR (length(hk) >= 5 AND nk[1:5] = hk[1:5]) AS ok FROM c)
        SELECT key, CAST(ok AS INT) AS matches, CAST(contains(nk, hk) OR contains(hk, nk) AS INT) AS brand,
               CASE WHEN ok THEN url ELSE '' END AS website FROM d""",
    "show_dates": """
        WITH a AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, o_orderkey % 10 AS m FROM orders),
        b AS (SELECT key, CASE WHEN m = 9 THEN NULL WHEN m < 7 THEN d
            ELSE TRY_CAST(concat(CASE WHEN strftime(d, '%m-%d') < '11-01' THEN '2027' ELSE '2026' END, strftime(d, '-%m-%d')) AS DATE) END AS e FROM a)
        SELECT key, strftime(e, '%Y-%m-%d') AS event_date, strftime(e - INTERVAL 14 DAY, '%Y-%m-%d 09:00') AS run_at,
          concat(strftime(e, '%B '), day(e), CASE WHEN day(e) BETWEEN 10 AND 20 THEN 'th' WHEN day(e) % 10 = 1 THEN 'st' WHEN day(e) % 10 = 2 THEN 'nd'
            WHEN day(e) % 10 = 3 THEN 'rd' WHEN e IS NULL THEN NULL ELSE 'th' END) AS pretty FROM b WHERE e IS NOT NULL
        UNION ALL SELECT key, NULL, NULL, NULL FROM b WHERE e IS NULL""",
    "page_titles": f"""
        WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages), p AS (SELECT page_id, {_PARTS.format('title', Q.norm('p'))} AS parts FROM t)
        SELECT page_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM p""",
    "conference_names": f"""
        WITH t AS (SELECT page_id, url, {_TITLE} AS title, {_H1} AS h1 FROM pages),
        c AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS c FROM (
            SELECT page_id, list_append(list_append({_PARTS.format('title', Q.norm('p'))}, title), h1) AS x FROM t)),
        s AS (SELECT page_id, pos, c, {Q.conference_score('c')} AS s FROM c WHERE c <> ''),
        b AS (SELECT page_id, arg_max(c, struct_pack(s := s, p := -pos)) AS best FROM s WHERE s IS NOT NULL GROUP BY page_id),
        h AS (SELECT page_id, {Q.initcap("array_to_string(list_filter(string_split(" + Q.host('url') + ", '.'), lambda p: p NOT IN ('www', 'com', 'org', 'net', 'io', 'co', 'us')), ' ')")} AS words FROM t)
        SELECT t.page_id, coalesce(best, words) AS conference FROM t JOIN h USING (page_id) LEFT JOIN b USING (page_id)""",
}
