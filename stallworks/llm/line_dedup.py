"""Line dedup by site-relative frequency.

A line is boilerplate of a site when it recurs, that is, stands on two of its pages or more, and more than a given share
of the site's pages contain it.  Lines are counted once per page and site, compared trimmed
of spaces, and told apart by their MD5.

Native throughout.  What is kept per site is the list of its boilerplate
lines: at most (average lines per page) / ratio of them, so it stays small
while Spark is free to broadcast it or, beyond its size limit, to join by host.

Defined cases: a null host is a site of its own; a null or empty text has no
lines; blank lines are never boilerplate and stay; a line on exactly the given share of pages stays; a site of one page keeps all lines;
long texts are cut into lines whole; further columns of any name are not read; repeated rows are pages of
their own, or with ``copies_once`` (the query, the pipeline) all rows of a site with one text are one page,
so that copies do not make their own lines boilerplate; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallworks.llm.tables import Scratch


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(sites: DataFrame, ratio: float) -> DataFrame:
    """(host, lines) -> (host, bad): keys of the lines on more than ``ratio`` of the host's pages.

    With a column ``page``, rows of a host with the same value are one page.
    """
    page = ["page"] if "page" in sites.columns else []
    each = sites.select("host", *page, F.explode(F.array_distinct(F.transform(
        F.filter("lines", lambda l: F.trim(l) != ""), line_key))).alias("line"))
    whole = sites.select("host", *page)
    if page:  # hashes only: no text is shuffled
        each, whole = each.distinct(), whole.distinct()
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    pages = whole.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.join(pages, "host").filter(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("bad"))


def drop_boilerplate(
    df: DataFrame, text: Column, host: Column, carry: dict[str, Column], ratio: float = 0.1,
    copies_once: bool = False,
) -> DataFrame:
    """The carried columns, ``host``, ``kept_text``, ``n_lines`` (lines with a word) and ``n_dropped`` of every row."""
    scratch = Scratch(df.sparkSession)
    names = {c: f"carried_{c}" for c in carry}
    lines = F.split(F.coalesce(text, F.lit("")), "\n").alias("lines")
    site = F.coalesce(host, F.lit("")).alias("host")
    page = [F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("page")] if copies_once else []
    bad = scratch.write(boilerplate(df.select(site, lines, *page), ratio))
    rows = df.select(*(c.alias(names[k]) for k, c in carry.items()), site, lines)
    kept = F.filter("lines", lambda l: ~F.coalesce(F.array_contains("bad", line_key(l)), F.lit(False)))
    done = rows.join(bad, "host", "left").withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept))
    return done.select(
        *(F.col(names[k]).alias(k) for k in carry), "host", F.array_join("kept", "\n").alias("kept_text"),
        F.size(F.filter("lines", lambda l: F.trim(l) != "")).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


# What is not text of a page, what ends a line of it, and other tags.
HIDDEN = "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCKS = "(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|section|header|footer|table|tr|td|th|title|head|body|html)\\b[^>]*>"
TAGS = "<[^>]*>"


def page_text(html: Column) -> Column:
    """Text of a page, one line per block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCKS, "\n"), TAGS, "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def line_dedup_pages(pages: DataFrame, ratio: float = 0.1) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_sha256 for (page_id, url, html)."""
    # tags are cut out once; lines are counted and dropped over the written texts
    texts = Scratch(pages.sparkSession).write(pages.select(
        "page_id", url_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text")))
    done = drop_boilerplate(texts, F.col("text"), F.col("host"), {"page_id": F.col("page_id")}, ratio, copies_once=True)
    return done.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
