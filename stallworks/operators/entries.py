"""Entries of directories: dedupe, numbering, gates and precedence of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ENTRY_KEY = ["seed_url", "entry_key"]


def entry_key() -> Column:
    """Profile address, else website hint, else lower-case name."""
    empty_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(empty_as_null("profile_url"), empty_as_null("website_url_hint"), F.lower("company_name"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as an aggregate with partial results (no window over a hot key)."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first")).select(*keys, "first.*")


def number_rows(rows: DataFrame, group: str, chunk: list[str], order: list[str], out: str, last: str | None = None, tasks: int | None = None) -> DataFrame:
    """Dense 0-based numbers per group in (chunk, order), without one task per group.

    Rows are numbered inside their chunk (one page of a directory: bounded by a
    document); only one count per chunk is put in order over the whole group.
    ``last`` names a column for the greatest number of the group; ``tasks`` deals rows
    and counts to that many tasks, however many partitions the session sets.
    """
    if tasks is not None:
        rows = rows.repartition(tasks, group, *chunk)
    sizes = rows.groupBy(group, *chunk).agg(F.count("*").alias("chunk_size"))
    if tasks is not None:
        sizes = sizes.repartition(tasks, group)
    whole = Window.partitionBy(group)
    before = whole.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, *chunk, F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("offset"),
        *([] if last is None else [(F.sum("chunk_size").over(whole) - 1).alias(last)]),
    )
    inside = Window.partitionBy(group, *chunk).orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(offsets, [group, *chunk]).withColumn(out, F.col("offset") + F.col("place") - 1).drop(
        "offset", "place"
    )


def dedupe_entries(candidates: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """First entry per key and seed in page order, numbered from 0."""
    keyed = candidates.withColumn("entry_key", entry_key())
    first = first_per_key(keyed, ENTRY_KEY, [*chunk, *order])
    return number_rows(first, "seed_url", chunk, [*order, "entry_key"], "sort_index").drop("entry_key")


def best_source(rows: DataFrame, key: str = "seed_url", priority: str = "priority") -> DataFrame:
    """Keep the rows of the most preferred source that has any, per key."""
    best = rows.groupBy(key).agg(F.min(priority).alias("best_priority"))
    return rows.join(best, key).filter(F.col(priority) == F.col("best_priority")).drop("best_priority")


def at_least(rows: DataFrame, keys: list[str], smallest: int) -> DataFrame:
    """Keep groups of a minimum size."""
    big = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= smallest).select(*keys)
    return rows.join(big, keys, "left_semi")


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen, keys, "left_anti")


def page_range(entries: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries inside the asked page range of their seed, and the seeds whose range is empty.

    ``limits`` holds (seed_url, start_page, end_page, max_pages), NULL where not asked.
    """
    start = F.greatest(F.coalesce("start_page", F.lit(1)), F.lit(1))
    end = F.coalesce(F.col("end_page"), start + F.coalesce("max_pages", F.lit(2**31 - 1)).cast("bigint") - 1)
    ranges = limits.select(
        "seed_url", start.alias("from_page"),
        F.least(end, start + F.coalesce("max_pages", F.lit(2**31 - 1)).cast("bigint") - 1).alias("to_page"),
    )
    errors = ranges.filter("from_page > to_page").select(
        "seed_url", F.lit("start page is greater than end page").alias("error")
    )
    kept = entries.join(ranges, "seed_url", "left").filter(
        F.col("from_page").isNull() | F.col("directory_page").between(F.col("from_page"), F.col("to_page"))
    )
    return kept.drop("from_page", "to_page"), errors


def stall_cut(entries: DataFrame, page: str = "directory_page", key: str = "profile_url", stalls: int = 2) -> DataFrame:
    """Drop what stands behind the first two consecutive pages without anything new.

    ``entries`` must hold one row per page at least (key NULL for an empty page).
    First appearances and page counts are aggregates; the window sees one row
    per page.
    """
    firsts = entries.filter(F.col(key).isNotNull()).groupBy("seed_url", key).agg(F.min(page).alias(page))
    fresh = firsts.groupBy("seed_url", page).agg(F.count("*").alias("fresh"))
    pages = entries.select("seed_url", page).distinct().join(fresh, ["seed_url", page], "left")
    order = Window.partitionBy("seed_url").orderBy(page)
    pages = pages.withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    run = F.lit(True)
    for back in range(stalls):
        run = run & (F.coalesce(F.lag("fresh", back).over(order), F.lit(1)) == 0)
    pages = pages.withColumn("stalled", run.cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.withColumn("cut", F.coalesce(F.max("stalled").over(before), F.lit(0))).filter("cut = 0")
    return entries.join(kept.select("seed_url", page), ["seed_url", page], "left_semi")


def same_url_set(a: DataFrame, b: DataFrame, key: str = "seed_url", value: str = "profile_url") -> DataFrame:
    """Per key: do both tables list the same set of values?

    Counting instead of collecting, so a set of any size passes through one row per value.
    """
    tagged = a.select(key, value, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(key, value, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_value = tagged.groupBy(key, value).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return per_value.groupBy(key).agg(
        (F.count_if(F.col("in_a") != F.col("in_b")) == 0).alias("same_set"),
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
    )


def running_count(rows: DataFrame, keys: list[str], order: str, flag: Column, out: str, chunk: int = 4096) -> DataFrame:
    """Running count of a flag along an integer order, in chunks, so that one long
    stream is spread over many tasks: local counts plus the totals of earlier chunks."""
    marked = rows.withColumn("_flag", flag.cast("int")).withColumn("_chunk", F.floor(F.col(order) / chunk))
    totals = marked.groupBy(*keys, "_chunk").agg(F.sum("_flag").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_local", F.sum("_flag").over(inside)).join(offsets, [*keys, "_chunk"])
    return counted.withColumn(out, F.col("_local") + F.col("_offset")).drop("_flag", "_chunk", "_local", "_offset")
