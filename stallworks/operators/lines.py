"""Entries from text lines: rich-text blocks, tables and lines read from images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallworks import rules
from stallworks.functions import scores as S, text as T, url as U
from stallworks.operators.entries import at_least, first_per_key, number_rows, running_count
from stallworks.session import cut_lineage
from stallworks.sources import pages as P


def read_ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of image texts: a table of (seed_url, image_url, image_rank, text)."""
    texts = spark.read.parquet(path)
    return text_lines(texts, "text", "seed_url", "image_url", "image_rank")


def text_lines(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per non-empty line."""
    lines = texts.select(*keep, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "raw"))
    return lines.select(*keep, "line_no", T.normalize_text("raw").alias("line")).filter("line <> ''")


def richtext_entries(pages: DataFrame) -> DataFrame:
    """Names in rich-text blocks of at least ten valid lines, ten distinct names per page."""
    lines = P.richtext_lines(pages, "url").filter(T.is_richtext_company_line("line"))
    lines = at_least(lines, ["url", "block_no"], rules.MIN_LINES)
    named = lines.withColumn("company_name", T.clean_company_name("line")).withColumn("name_key", F.lower("company_name"))
    first = first_per_key(named, ["url", "name_key"], ["block_no", "line_no"])
    first = at_least(first, ["url"], rules.MIN_LINES)
    return number_rows(first, "url", ["block_no"], ["line_no"], "ord").select("url", "company_name", "ord")


def table_entries(pages: DataFrame) -> DataFrame:
    """Booth and name rows of tables: (url, company_name, profile_url, ord), first per profile."""
    rows = P.table_rows(pages, "url")
    named = rows.withColumn("company_name", T.clean_company_name(F.get("cells", F.lit(1)))).filter(
        (F.col("company_name") != "") & T.is_companyish("company_name")
    )
    targets = F.filter(
        F.transform("hrefs", lambda h: U.resolve_url(F.col("url"), h)), lambda u: U.same_site(u, F.col("url"))
    )
    last = F.try_element_at(F.filter(targets, lambda u: u.isNotNull()), F.lit(-1))
    synthetic = U.text_fragment_url("url", F.col("company_name"), F.get("cells", F.lit(0)))
    named = named.withColumn("profile_url", F.coalesce(last, synthetic))
    return first_per_key(
        named.select("url", "company_name", "profile_url", F.col("row_no").alias("ord")), ["url", "profile_url"], ["ord"]
    )


def top_images(images: DataFrame, seed: str = "url", count: int | None = None) -> DataFrame:
    """Images of a page that may show a list of participants, ranked."""
    scored = images.withColumn("score", S.image_score(S.row, F.col(seed))).filter("score >= 30")
    window = Window.partitionBy(seed).orderBy(F.desc("score"), "ord")
    ranked = scored.withColumn("image_rank", F.row_number().over(window))
    return ranked if count is None else ranked.filter(F.col("image_rank") <= count)


def ocr_worthy_images(images: DataFrame) -> DataFrame:
    return images.filter(S.image_worthy(F.col("absolute_url"), F.col("alt_text")))


def name_url_pairs(lines: DataFrame, is_name: Column | None = None, smallest: int = rules.MIN_LINES) -> DataFrame:
    """A company line takes the next URL line of its image; a name seen before takes none.

    ``lines`` holds (seed_url, image_url, image_rank, line_no, line).  A line that
    holds a URL is never a name.
    """
    stream = ["seed_url", "image_rank", "image_url"]
    rows = lines.withColumn("website", U.line_url("line"))
    rows = rows.withColumn(
        "is_name", (F.col("website") == "") & (T.is_richtext_company_line("line") if is_name is None else is_name)
    ).filter("is_name OR website <> ''")
    rows = cut_lineage(rows)  # read for the counts and for the lines
    rows = running_count(rows, stream, "line_no", F.col("is_name"), "wait_no").filter("wait_no > 0")
    waits = rows.groupBy(*stream, "wait_no").agg(
        F.min_by("line", "line_no").alias("line"),
        F.min("line_no").alias("line_no"),
        F.min_by(F.when(F.col("website") != "", F.col("website")), F.when(F.col("website") != "", F.col("line_no"))).alias(
            "website"
        ),
    )
    named = waits.withColumn("company_name", T.clean_company_name("line")).withColumn("name_key", F.lower("company_name"))
    first = first_per_key(named, ["seed_url", "name_key"], ["image_rank", "line_no"])
    kept = at_least(first, ["seed_url"], smallest) if smallest > 1 else first
    return kept.select(
        "seed_url", "image_url", "image_rank", "line_no", "company_name",
        F.coalesce("website", F.lit("")).alias("website_url_hint"),
    )
