"""Payloads handed to delivery and mail tools (sending them is not part of the engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks.functions import dates as D
from stallworks.operators.entries import number_rows

PAYLOAD_FIELDS = ["show_id", "show_name", "show_date", "show_day", "show_year", "show_date_pretty", "show_place",
                  "scraped_at", "source_url"]

#: rows of export and shows in a task: more rows make more tasks, not larger ones
TASK_ROWS = 250_000


def row_tasks(*tables: DataFrame) -> int:
    """Tasks that share the rows of the tables; not fewer than the session's partitions, to which Spark would raise a join and deal all out again."""
    spark = tables[0].sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-sum(t.count() for t in tables) // TASK_ROWS))


def crowded_shows(export: DataFrame) -> list[str]:
    """Shows with more rows than one task takes, hence few.  Counted by hash first, so that shows which share a slot with none are not told apart."""
    keys = export.select(F.col("show_id").cast("string").alias("show_id")).filter("show_id IS NOT NULL")
    slot = F.pmod(F.xxhash64("show_id"), F.lit(64 * row_tasks(export))).alias("slot")
    full = [r.slot for r in keys.groupBy(slot).count().filter(F.col("count") > TASK_ROWS).collect()]
    if not full:
        return []
    return [r.show_id for r in keys.filter(slot.isin(full)).groupBy("show_id").count().filter(F.col("count") > TASK_ROWS).collect()]


def show_fields(shows: DataFrame, scraped_at: str) -> DataFrame:
    """The nine fields that each delivered row carries about its show, all text."""
    day = D.pretty_day("event_date")
    year = F.year("event_date").cast("string")
    return shows.select(
        F.col("id").cast("string").alias("show_id"),
        F.col("name").alias("show_name"),
        F.date_format("event_date", "yyyy-MM-dd").alias("show_date"),
        day.alias("show_day"),
        year.alias("show_year"),
        F.concat_ws(", ", day, year).alias("show_date_pretty"),
        F.col("place").alias("show_place"),
        F.lit(scraped_at).alias("scraped_at"),
        "source_url",
    )


def delivery_rows(export: DataFrame, shows: DataFrame, scraped_at: str, tasks: int | None = None) -> DataFrame:
    """Export rows with the fields of their show; on a name clash the show's field stays.

    ``tasks`` sets how many tasks a join by shuffle takes.  Then only shows that one task could hold may be broadcast: Spark
    judges by the size of compressed files.
    """
    own = [c for c in export.columns if c == "show_id" or c not in PAYLOAD_FIELDS]
    fields = show_fields(shows, scraped_at)
    if tasks is not None:
        fields = fields.repartition(tasks, "show_id")
        if shows.count() > TASK_ROWS:
            fields = fields.hint("merge")
    return export.select(*own).withColumn("show_id", F.col("show_id").cast("string")).join(fields, "show_id")


def delivery_payload(export: DataFrame, shows: DataFrame, scraped_at: str) -> DataFrame:
    """One JSON text per export row."""
    rows = delivery_rows(export, shows, scraped_at)
    return rows.select("show_id", F.to_json(F.struct(*[c for c in rows.columns])).alias("payload"))


def delivery_body(export: DataFrame, shows: DataFrame, scraped_at: str, key: str = "sort_index", part_rows: int = 1000) -> DataFrame:
    """The request body of every show, in parts: (show_id, part_no, text).

    The texts of a show's parts, one after another, are its one body; no part holds more than ``part_rows``
    records, so a show of any size is never gathered.  Records are in the order of ``key``, then of their ids, which come from the row,
    hence reruns give the same ones.  The tasks of every step grow with the rows.

    Rows of a show that one task can hold are dealt out once, before they get the show's fields, and all steps follow there: texts are
    many times as large as the rows they are made of.  Only shows of more rows are numbered and put together in chunks.
    """
    tasks, crowded = row_tasks(export, shows), crowded_shows(export)
    if not crowded:
        return _bodies_in_place(export, shows, scraped_at, key, part_rows, tasks)
    held = F.col("show_id").cast("string").isin(crowded)
    return _bodies_in_place(export.filter(~held), shows, scraped_at, key, part_rows, tasks).unionByName(
        _bodies_in_chunks(export.filter(held), shows, scraped_at, key, part_rows, tasks))


def _digest(rows: DataFrame, key: str) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct("show_id", key, *[c for c in rows.columns if c not in ("show_id", key)])), 256), 1, 12)


def _record(rows: DataFrame, key: str, digest: Column) -> Column:
    identity = F.concat(F.lit("show-"), F.col("show_id"), F.lit("-"), digest)
    return F.to_json(F.struct(identity.alias("id"), F.struct(*[c for c in rows.columns if c != key]).alias("cells")))


def _bodies_in_place(export: DataFrame, shows: DataFrame, scraped_at: str, key: str, part_rows: int, tasks: int) -> DataFrame:
    """Parts of shows that one task can hold, without another shuffle than that of the join."""
    dealt = export.withColumn("show_id", F.col("show_id").cast("string")).repartition(tasks, "show_id")
    rows = delivery_rows(dealt, shows, scraped_at, tasks)
    whole, chunk = Window.partitionBy("show_id"), F.floor(F.col(key) / part_rows)
    own = [c for c in rows.columns if c in export.columns and c not in ("show_id", key)]
    placed = rows.withColumn("_digest", _digest(rows, key)).withColumns({
        "_n": (F.row_number().over(whole.orderBy(chunk, key, "_digest", *own)) - 1).cast("bigint"), "last": F.count("*").over(whole) - 1})
    # a row without a place counts, but is not delivered
    placed = placed.filter(chunk.isNotNull()).select(
        "show_id", F.floor(F.col("_n") / part_rows).alias("part_no"), "last", F.col("_n").alias("n"), _record(rows, key, F.col("_digest")).alias("record"))
    return _texts(placed, ["show_id", "part_no", "last"], part_rows)


def _bodies_in_chunks(export: DataFrame, shows: DataFrame, scraped_at: str, key: str, part_rows: int, tasks: int) -> DataFrame:
    """Parts of crowded shows: numbered by chunks, put together by blocks of parts."""
    rows = delivery_rows(export, shows, scraped_at, tasks)
    record = _record(rows, key, _digest(rows, key))
    placed = rows.select("show_id", key, record.alias("record"), F.floor(F.col(key) / part_rows).alias("chunk"))
    # records of one show differ first in their ids, so their texts sort as the ids do
    placed = number_rows(placed, "show_id", ["chunk"], [key, "record"], "n", last="last", tasks=tasks)
    placed = placed.select("show_id", F.floor(F.col("n") / part_rows).alias("part_no"), "last", "n", "record")
    # neighbouring parts of a show go together as far as one task may hold them
    block = F.floor(F.col("part_no") / max(1, TASK_ROWS // part_rows)).alias("block")
    return _texts(placed.select("*", block).repartition(tasks, "show_id", "block"), ["show_id", "block", "part_no", "last"], part_rows)


def _texts(placed: DataFrame, keys: list[str], part_rows: int) -> DataFrame:
    parts = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "record"))).alias("records"))
    joined = F.array_join(F.transform("records", lambda r: r["record"]), ",")
    first, final = F.col("part_no") == 0, F.col("part_no") == F.floor(F.col("last") / part_rows)
    text = F.concat(F.when(first, '{"records":[').otherwise(","), joined, F.when(final, "]}").otherwise(""))
    return parts.select("show_id", "part_no", text.alias("text"))


def notification_text(shows: DataFrame, app_name: str = "Shows") -> DataFrame:
    """Subject and text of the mail for each show ready for review."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value.cast("string"))

    path = F.coalesce(F.nullif("latest_export_path", F.lit("")), F.lit("not available"))
    body = F.concat_ws(
        "\n",
        line("Show: ", F.col("name")), line("Date: ", F.date_format("event_date", "yyyy-MM-dd")),
        line("Place: ", F.col("place")), line("Source URL: ", F.col("source_url")),
        line("Rows exported: ", F.col("company_count")), line("Profile failures: ", F.col("failure_count")),
        line("Export path: ", path), F.lit(""),
        F.lit("The show has finished scraping and is ready for review in the dashboard."),
    )
    subject = F.concat(F.lit(f"[{app_name}] "), F.col("name"), F.lit(" is ready for review"))
    return shows.filter("status = 'ready_for_review'").select(F.col("id").alias("show_id"), subject.alias("subject"), body.alias("body"))
