"""Page tables and what plain patterns read from them, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.functions.binding import let
from stallworks.session import cut_lineage

META = r"(?i)<meta\b([^>]+)>"
ATTRIBUTE = r"""(?is)([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page snapshot with one row per address without fragment.

    Of repeated addresses the longest text counts, of equally long ones the row whose other columns are the greatest.
    Texts take no part in that: addresses alone tell which repeat, their rows are compared
    by place in the files and length, and the rows that lose are left out of one plain scan.
    """
    pages = spark.read.parquet(path)
    address = F.coalesce(U.normalize_http_url("url"), F.col("url"))
    read = pages.withColumn("url", address)
    repeated = cut_lineage(pages.select(address.alias("url")).groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url"))
    if repeated.isEmpty():
        return read
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    others = [c for c in pages.columns if c not in ("url", "html")]
    rows = pages.select(address.alias("url"), F.length("html").alias("size"), *others, place).join(repeated, "url", "left_semi")
    rows = cut_lineage(rows)
    best = rows.groupBy("url").agg(F.max_by("place", F.struct("size", *others, "place")).alias("best"))
    lost = cut_lineage(rows.join(best, F.equal_null(rows["url"], best["url"])).filter("place <> best").select("place.file", "place.row"))
    marked = pages.select(address.alias("url"), *(c for c in pages.columns if c != "url"),
                          F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return marked.join(lost, ["file", "row"], "left_anti").select(*pages.columns)


def all_matches(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(U._col(text), F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute of a tag, NULL without it; the last of repeats wins."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*')"""
    quoted = F.try_element_at(all_matches(tag, pattern, 1), F.lit(-1))
    return T.unescape(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def meta_tags(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per meta tag with content: position, property, name, content."""
    tags = pages.select(*keep, F.posexplode(all_matches("html", META, 1)).alias("pos", "tag"))
    return tags.select(
        *keep, "pos",
        F.coalesce(attribute(F.col("tag"), "property"), F.lit("")).alias("property"),
        F.coalesce(attribute(F.col("tag"), "name"), F.lit("")).alias("name"),
        F.coalesce(attribute(F.col("tag"), "content"), F.lit("")).alias("content"),
    ).filter(T.normalize_text("content") != "")


def iframes(pages: DataFrame, *keep: str) -> DataFrame:
    """Absolute targets of frames."""
    sources = all_matches("html", r"""(?i)<iframe[^>]+\bsrc=["']([^"']+)["']""", 1)
    return (
        pages.select(*dict.fromkeys(("url", *keep)), F.posexplode(sources).alias("pos", "raw"))
        .withColumn("src", U.resolve_url("url", "raw"))
        .filter(F.col("src").isNotNull())
        .drop("raw")
    )


def table_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """Rows of at least two cells: their texts and links."""
    rows = pages.select(*keep, F.posexplode(all_matches("html", r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)).alias("row_no", "row"))
    cells = F.transform(all_matches("row", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1), T.strip_tags)
    hrefs = F.transform(
        all_matches("row", r"""(?is)href=("[^"]*"|'[^']*')""", 1), lambda h: F.substr(h, F.lit(2), F.length(h) - 2)
    )
    return rows.select(*keep, "row_no", cells.alias("cells"), hrefs.alias("hrefs")).filter(F.size("cells") >= 2)


def richtext_lines(pages: DataFrame, *keep: str) -> DataFrame:
    """Non-empty lines of rich-text blocks."""
    blocks = all_matches("html", r"""(?is)<div[^>]+\bdata-testid=["']richTextElement["'][^>]*>(.*?)</div>""", 1)
    lines = all_matches("block", r"(?is)<(?:p|li)[^>]*>(.*?)</(?:p|li)>", 1)
    return (
        pages.select(*keep, F.posexplode(blocks).alias("block_no", "block"))
        .select(*keep, "block_no", F.posexplode(lines).alias("line_no", "raw"))
        .select(*keep, "block_no", "line_no", T.strip_tags("raw").alias("line"))
        .filter("line <> ''")
    )


def total_pages(html: Column | str) -> Column:
    """Largest page total that the page's scripts state, NULL without one."""
    found = F.concat(*[all_matches(html, pattern, 1) for pattern in rules.TOTAL_PAGE_PATTERNS])
    values = F.transform(found, lambda v: v.try_cast("bigint"))
    return F.array_max(F.filter(values, lambda v: v > 1))


def form_tokens(pages: DataFrame, *keep: str) -> DataFrame:
    """Tokens ``tk`` and ``tm`` of pages that set both; the last assignment wins."""

    def token(name: str) -> Column:
        pattern = rf"""(?i)(?:var|let|const)\s+{name}\s*=\s*("[^"]*"|'[^']*')\s*;"""
        quoted = F.try_element_at(all_matches("html", pattern, 1), F.lit(-1))
        return F.substr(quoted, F.lit(2), F.length(quoted) - 2)

    return pages.select(*keep, token("tk").alias("tk"), token("tm").alias("tm")).filter("tk <> '' AND tm <> ''")


def embedded_url(html: Column | str, fields: list[str] = rules.EMBEDDED_WEBSITE_FIELDS) -> Column:
    """First ``field: "address"`` in a page's scripts, '' without one."""
    found = []
    for field in fields:
        for body in (r'"((?:\\.|[^"])*)"', r"'((?:\\.|[^'])*)'"):
            raw = F.regexp_extract(U._col(html), rf"(?i){field}\s*:\s*{body}", 1)
            found.append(U.normalize_http_url(F.replace(raw, F.lit("\\/"), F.lit("/"))))
    return F.coalesce(*found, F.lit(""))


def platform(url: Column | str, html: Column | str) -> Column:
    """Which directory platform a page belongs to."""
    url, html = U._col(url), U._col(html)
    host = U.host_key(url)
    gallery = (
        host.contains("mapyourshow.com")
        & html.contains("remote-proxy.cfm?action=search")
        & html.contains("getExhibitorURL")
        & html.rlike(r"""searchtype(?:=exhibitorgallery|:"exhibitorgallery"|:'exhibitorgallery')""")
    )
    floorplan = (
        host.contains("expofp.com")
        & html.contains('class="expofp-floorplan"')
        & html.contains("data-data-url=")
        & html.contains("data/version.js")
    )
    return (
        F.when(gallery, "mapyourshow")
        .when(floorplan, "expofp")
        .when(host.contains("swapcard.com"), "swapcard")
        .otherwise("generic")
    )


def script_object(text: Column) -> Column:
    """Flat script object literal as a map of strings; the last of repeated keys wins."""
    pattern = r"""(?s)("[^"]+"|'[^']+')\s*:\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|-?\d+(?:\.\d+)?|true|false|null)"""

    def bare(token: Column) -> Column:
        inner = F.substr(token, F.lit(2), F.length(token) - 2)
        inner = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
        return F.when(token.rlike("^[\"']"), inner).when(token == "null", "").otherwise(token)

    def entries(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: T.normalize_text(bare(F.regexp_extract(p, pattern, 1))))
        values = F.transform(pairs, lambda p: T.unescape(bare(F.regexp_extract(p, pattern, 2))))
        zipped = F.arrays_zip(keys.alias("key"), values.alias("value"))
        last = F.filter(
            zipped, lambda e, i: (e["key"] != "") & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
        )
        return F.map_from_entries(last)

    return let(all_matches(text, pattern, 0), entries)


def paginator_calls(pages: DataFrame, *keep: str) -> DataFrame:
    """Scripted paginators: request parameters, limit, total, next offset, page id."""
    name = r"[A-Za-z_$][\w$]*"
    keys = list(dict.fromkeys(("url", *keep)))
    scripts = (
        pages.filter(F.col("html").contains(".jsPaginator("))
        .select(*keys, F.posexplode(all_matches("html", r"(?is)<script\b(?![^>]+\bsrc=)[^>]*>(.*?)</script>", 1))
                .alias("script_no", "body"))
        .filter(F.col("body").contains(".jsPaginator("))
    )
    call = rf"(?s)\.jsPaginator\(\s*(\{{.*?\}}|{name})\s*,\s*(\{{.*?\}})\s*(?:,\s*(\d+))?"
    calls = scripts.select("*", F.posexplode(all_matches("body", call, 0)).alias("call_no", "call"))
    first = F.regexp_extract("call", call, 1)
    assigned = F.try_element_at(
        F.filter(
            all_matches("body", rf"(?s)(?:var|let|const)\s+{name}\s*=\s*\{{.*?\}}\s*;", 0),
            lambda d: F.regexp_extract(d, rf"^\w+\s+({name})", 1) == first,
        ),
        F.lit(-1),
    )
    params = script_object(F.when(first.startswith("{"), first).otherwise(F.coalesce(assigned, F.lit(""))))
    options = script_object(F.regexp_extract("call", call, 2))
    number = lambda value: F.coalesce(F.nullif(value, F.lit("")).cast("string"), F.lit("0")).try_cast("int")
    out = calls.select(
        *keys, "script_no", "call_no", params.alias("p"), options.alias("o"),
        F.regexp_extract("call", call, 3).alias("total"),
    ).select(
        *keys, "script_no", "call_no",
        U.resolve_url("url", F.lit("/index.php")).alias("endpoint_url"),
        F.map_filter("p", lambda k, v: ~k.isin("ajaxType", "page_id", "tk", "tm")).alias("params"),
        number(F.try_element_at("p", F.lit("limit"))).alias("limit"),
        number(F.col("total")).alias("total_results"),
        number(F.try_element_at("p", F.lit("offset"))).alias("next_offset"),
        F.coalesce(F.nullif(F.try_element_at("o", F.lit("pageID")), F.lit("")), F.lit("openAjax")).alias("page_id"),
        F.coalesce(F.try_element_at("p", F.lit("module")), F.lit("")).alias("module"),
        F.coalesce(F.try_element_at("p", F.lit("method")), F.lit("")).alias("method"),
    )
    valid = out.filter("module <> '' AND method <> '' AND `limit` > 0 AND next_offset IS NOT NULL")
    identity = F.struct(
        "endpoint_url", F.array_sort(F.map_entries("params")).alias("params"), "limit", "total_results", "page_id"
    )
    first_of = valid.withColumn("config", F.to_json(identity)).groupBy(*keys, "config").agg(
        F.min_by(F.struct(*[c for c in valid.columns if c not in keys]), F.struct("script_no", "call_no")).alias("first")
    )
    return first_of.select(*keys, "first.*").drop("module", "method")


def frame_scores(frames: DataFrame) -> DataFrame:
    return frames.withColumn("score", S.iframe_score(F.col("src"), F.col("url"))).filter("score IS NOT NULL")
