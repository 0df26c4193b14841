"""Page signals: one pass over each page, then child tables by plain projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.sources import html_scan, json_walk

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(html_scan)
cloudpickle.register_pickle_by_value(json_walk)

FLAGS = "in_header boolean, in_footer boolean, in_nav boolean, in_main boolean"
SIGNALS = f"""
    url string, title string, h1_texts array<string>, json_ld_blocks array<string>, headings array<string>,
    linked array<struct<owner int, key string, label string, text string>>,
    anchors array<struct<ord int, text string, href string, signature array<string>, {FLAGS},
        title_attr string, aria_label string>>,
    actions array<struct<ord int, text string, raw_url string, tag string, source_attr string,
        signature array<string>, {FLAGS}, title_attr string, aria_label string>>,
    containers array<struct<ord int, tag string, signature array<string>, {FLAGS}, text_length int, text string,
        first_heading int, heading_count int, first_action int, action_count int>>,
    images array<struct<ord int, src string, alt_text string, signature array<string>, {FLAGS},
        width string, height string>>
"""
ROWS_PER_BATCH = 200


def page_signals(pages: DataFrame) -> DataFrame:
    """One row of signals per page (columns ``url`` and ``html``).

    A narrow, map-only stage: only address and text go to Python, only signals
    come back; pages are independent, so it scales with the number of splits.
    """
    ddl = " ".join(SIGNALS.split())
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    navigable, short_text = list(rules.NAVIGABLE_ATTRS), rules.SHORT_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                rows = []
                for record in batch.slice(start, ROWS_PER_BATCH).to_pylist():
                    page = html_scan.scan(record["html"] or "", navigable, short_text)
                    page["linked"] = json_walk.texts(page["json_ld_blocks"])
                    page["url"] = record["url"]
                    rows.append(page)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select("url", "html").mapInArrow(run, ddl)


Worth = Callable[[Column], Column]


def anchors(signals: DataFrame, *keep: str, worth: Worth | None = None) -> DataFrame:
    """One row per anchor with its absolute address and shown text; of those ``worth`` it, told by the bare element."""
    kept = dict.fromkeys(("url", *keep))
    rows = _resolved(signals, kept, "anchors", lambda a: U.resolve_url("url", a["href"]), worth)
    return _links(rows, kept, F.lit("anchor"), F.lit("a"), F.lit("href"))


def actions(signals: DataFrame, *keep: str, worth: Worth | None = None) -> DataFrame:
    """One row per navigable action, the plain links among them included; of those ``worth`` it, told by the bare element."""
    kept = dict.fromkeys(("url", *keep))
    rows = _resolved(signals, kept, "actions", lambda a: U.resolve_target("url", a["raw_url"]), worth)
    return _links(rows, kept, F.lit("action"), F.col("tag"), F.col("source_attr"))


def non_anchor_actions(links: DataFrame) -> DataFrame:
    return links.filter((F.col("tag") != "a") | (F.col("source_attr") != "href"))


def _resolved(signals, kept, name, address, worth) -> DataFrame:
    """Elements whose address resolves.  It is resolved inside the page's row: as a column, every filter on it would resolve it again."""
    found = F.col(name) if worth is None else F.filter(name, worth)
    found = F.transform(found, lambda a: a.withField("absolute_url", address(a)))
    return signals.select(*kept, F.inline(F.filter(found, lambda a: a["absolute_url"].isNotNull())))


def _links(rows, kept, kind, tag, source_attr) -> DataFrame:
    return rows.select(
        *kept,
        kind.alias("source_kind"),
        "ord",
        "absolute_url",
        T.display_text(F.col("text"), F.col("title_attr"), F.col("aria_label")).alias("display_text"),
        "signature", "in_header", "in_footer", "in_nav", "in_main",
        tag.alias("tag"),
        source_attr.alias("source_attr"),
        T.normalize_text("title_attr").alias("title_attr"),
        T.normalize_text("aria_label").alias("aria_label"),
    )


def images(signals: DataFrame, *keep: str) -> DataFrame:
    kept = dict.fromkeys(("url", *keep))
    return signals.select(*kept, F.inline("images")).select(
        *kept, "ord", U.resolve_url("url", "src").alias("absolute_url"), "alt_text", "signature",
        "in_header", "in_footer", "in_nav", "in_main",
        T.positive_int("width").alias("width"), T.positive_int("height").alias("height"),
    ).filter(F.col("absolute_url").isNotNull())
