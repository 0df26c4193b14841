"""State of shows and runs: every transition is one set-based step over the whole tables.

Steps take and return (shows, runs).  ``now`` is an ISO timestamp, so a step
that is repeated gives the same tables; ids are hashes of the natural key, so a
repeated step adds no row twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stallworks import rules
from stallworks.sources.schedule import RUNS, SHOWS

PROVIDERS = ["clay_status", "heyreach_status", "smartlead_status"]


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def key_id(*columns: str) -> Column:
    """Stable positive id of a natural key."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1))


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    fields = [part.strip().split(" ") for part in ddl.split(",")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


# --- schedule import ------------------------------------------------------------


def latest_per_key(schedule: DataFrame) -> DataFrame:
    """Last row per (link, event date) of one file."""
    others = [c for c in schedule.columns if c not in ("link", "event_date")]
    return schedule.groupBy("link", "event_date").agg(F.max_by(F.struct(*others), "row_no").alias("r")).select(
        "link", "event_date", "r.*"
    )


def existing_show(schedule: DataFrame, shows: DataFrame) -> DataFrame:
    """Schedule rows with the id of the show they already name, if any."""
    known = shows.select(F.col("source_url").alias("link"), "event_date", F.col("id").alias("existing_id"))
    return schedule.join(known, ["link", "event_date"], "left")


def import_summary(schedule: DataFrame, parsed: DataFrame, shows: DataFrame) -> DataFrame:
    """One row: shows created and updated, rows skipped as incomplete or with an unknown date."""
    valid = latest_per_key(parsed.filter("event_date IS NOT NULL"))
    keyed = existing_show(valid, shows).agg(
        F.count_if(F.col("existing_id").isNull()).alias("created"),
        F.count_if(F.col("existing_id").isNotNull()).alias("updated"),
    )
    read = schedule.agg(F.count_if((F.col("show") == "") | (F.col("date") == "") | (F.col("place") == "") | (F.col("link") == "")).alias("skipped"))
    bad = parsed.agg(F.count_if(F.col("event_date").isNull()).alias("bad_dates"))
    # three one-row tables side by side
    tagged = lambda df: df.withColumn("one", F.lit(1))
    return tagged(keyed).join(F.broadcast(tagged(read)), "one").join(F.broadcast(tagged(bad)), "one").drop("one")


def upsert_shows(shows: DataFrame, parsed: DataFrame, now: str, strict: bool = False) -> DataFrame:
    """Insert new shows as waiting; update name, place and trigger of known ones, status kept.

    Rows with an unknown date stay out, or fail the job when ``strict``.
    """
    if strict:
        parsed = parsed.withColumn(
            "event_date",
            F.coalesce("event_date", F.raise_error(F.concat(F.lit("Unsupported date format: "), F.col("date"))).cast("date")),
        )
    incoming = latest_per_key(parsed.filter("event_date IS NOT NULL")).select(
        F.col("link").alias("source_url"), "event_date", F.col("show").alias("new_name"), F.col("place").alias("new_place"),
        F.col("run_offset_days").alias("new_offset"), F.col("run_at").alias("new_run_at"),
    )
    joined = shows.join(incoming, ["source_url", "event_date"], "full")
    is_new, hit = F.col("id").isNull(), F.col("new_name").isNotNull()
    pending, at = F.lit("pending"), instant(now)
    changed = joined.select(
        F.coalesce("id", key_id("source_url", "event_date")).alias("id"),
        F.coalesce("new_name", "name").alias("name"),
        "event_date",
        F.coalesce("new_place", "place").alias("place"),
        "source_url",
        F.coalesce("new_offset", "run_offset_days").alias("run_offset_days"),
        F.coalesce("new_run_at", "run_at").alias("run_at"),
        F.coalesce("status", F.lit("waiting")).alias("status"),
        F.coalesce("approval_required", F.lit(True)).alias("approval_required"),
        "approved_at",
        F.coalesce("latest_export_path", F.lit("")).alias("latest_export_path"),
        F.coalesce("company_count", F.lit(0)).alias("company_count"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
        *[F.coalesce(c, pending).alias(c) for c in ("notification_status", *PROVIDERS)],
        F.when(is_new, at).otherwise(F.col("created_at")).alias("created_at"),
        F.when(is_new | hit, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return _shaped(changed, SHOWS)


# --- runs -------------------------------------------------------------------------


def due_shows(shows: DataFrame, now: str) -> DataFrame:
    return shows.filter((F.col("status") == "waiting") & (F.col("run_at") <= instant(now)))


def approved_pending(shows: DataFrame) -> DataFrame:
    return shows.filter("status = 'approved' AND (heyreach_status = 'pending' OR smartlead_status = 'pending')")


def new_runs(shows: DataFrame, now: str) -> DataFrame:
    rows = shows.select(F.col("id").alias("show_id")).withColumn("created_at", instant(now))
    filled = rows.select(
        key_id("show_id", "created_at").alias("id"), "show_id", F.lit("queued").alias("status"), F.lit("").alias("output_path"),
        F.lit(0).alias("company_count"), F.lit(0).alias("failure_count"), F.lit("").alias("error_message"), "created_at",
        F.lit(None).alias("started_at"), F.lit(None).alias("finished_at"),
    )
    return _shaped(filled, RUNS)


def _update(shows: DataFrame, condition: Column, values: dict[str, Column], now: str) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    changed = {**values, "updated_at": instant(now)}
    return shows.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in changed.items()})


def queue_due(shows: DataFrame, runs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Waiting shows whose time has come: queued, with a new run each."""
    due = (F.col("status") == "waiting") & (F.col("run_at") <= instant(now))
    return (
        _update(shows, due, {"status": F.lit("queued")}, now),
        runs.unionByName(new_runs(due_shows(shows, now), now)),
    )


def queue_now(shows: DataFrame, runs: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Queue the asked shows at once, unless they are queued or scraping already."""
    marked = shows.join(ids.select("id", F.lit(True).alias("asked")), "id", "left")
    free = F.coalesce("asked", F.lit(False)) & ~F.col("status").isin("queued", "scraping")
    values = {
        "run_at": instant(now), "status": F.lit("queued"), "last_error": F.lit(""), "failure_count": F.lit(0),
        "clay_status": F.lit("pending"), "notification_status": F.lit("pending"),
    }
    changed = _update(marked.withColumn("_free", free), F.col("_free"), values, now)
    added = new_runs(marked.filter(free), now)
    return _shaped(changed, SHOWS), runs.unionByName(added)


def queue_order(runs: DataFrame) -> DataFrame:
    """Queued runs, the oldest first."""
    return runs.filter("status = 'queued'").orderBy("created_at", "id")


def next_run(runs: DataFrame) -> DataFrame:
    return queue_order(runs).limit(1)


def start_runs(shows: DataFrame, runs: DataFrame, now: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queued runs (all, or the given ids) start; their shows are being scraped."""
    queued = runs.filter("status = 'queued'")
    if only is not None:
        queued = queued.join(only.select("id"), "id", "left_semi")
    started = queued.select("id", F.lit(True).alias("starts"))
    running = runs.join(started, "id", "left").withColumns({
        "status": F.when(F.col("starts"), "running").otherwise(F.col("status")),
        "started_at": F.when(F.col("starts"), instant(now)).otherwise(F.col("started_at")),
    })
    marked = shows.join(queued.select(F.col("show_id").alias("id"), F.lit(True).alias("starts")).distinct(), "id", "left")
    changed = _update(marked, F.col("starts"), {"status": F.lit("scraping"), "last_error": F.lit("")}, now)
    return _shaped(changed, SHOWS), _shaped(running, RUNS)


def apply_run_results(shows: DataFrame, runs: DataFrame, results: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Book the outcome of runs.

    ``results``: run_id, error (NULL or '' on success), output_path,
    company_count, failure_count, clay_status, clay_message,
    notification_status.  Of several results for one show the newest run counts.
    """
    outcome = results.select(
        F.col("run_id").alias("id"), F.coalesce("error", F.lit("")).alias("r_error"), F.col("output_path").alias("r_path"),
        F.col("company_count").alias("r_companies"), F.col("failure_count").alias("r_failures"),
        F.col("clay_status").alias("r_clay"), F.col("clay_message").alias("r_clay_message"),
        F.col("notification_status").alias("r_notification"),
    )
    joined = runs.join(outcome, "id", "left")
    booked, good = F.col("r_error").isNotNull(), F.coalesce(F.col("r_error") == "", F.lit(False))
    after_runs = joined.withColumns({
        "status": F.when(good, "success").when(booked, "failed").otherwise(F.col("status")),
        "output_path": F.when(good, F.col("r_path")).otherwise(F.col("output_path")),
        "company_count": F.when(good, F.col("r_companies")).otherwise(F.col("company_count")),
        "failure_count": F.when(good, F.col("r_failures")).otherwise(F.col("failure_count")),
        "error_message": F.when(booked & ~good, F.col("r_error")).otherwise(F.col("error_message")),
        "finished_at": F.when(booked, instant(now)).otherwise(F.col("finished_at")),
    })
    fields = ["r_error", "r_path", "r_companies", "r_failures", "r_clay", "r_clay_message", "r_notification"]
    per_show = joined.filter(booked).groupBy(F.col("show_id").alias("id")).agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "id")).alias("r")
    ).select("id", "r.*")
    marked = shows.join(per_show, "id", "left")
    clay_error = F.when(F.col("r_clay") == "failed", F.coalesce("r_clay_message", F.lit(""))).otherwise("")
    success = {
        "latest_export_path": F.col("r_path"), "company_count": F.col("r_companies"), "failure_count": F.col("r_failures"),
        "last_error": clay_error, "clay_status": F.col("r_clay"), "heyreach_status": F.lit("pending"),
        "smartlead_status": F.lit("pending"), "notification_status": F.col("r_notification"),
        "status": F.lit("ready_for_review"),
    }
    marked = marked.withColumns({"_good": good, "_bad": booked & ~good})
    changed = _update(marked, F.col("_good"), success, now)
    changed = _update(changed, F.col("_bad"), {"status": F.lit("failed"), "last_error": F.col("r_error")}, now)
    return _shaped(changed, SHOWS), _shaped(after_runs, RUNS)


# --- approval and delivery --------------------------------------------------------


def approve(shows: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    marked = shows.join(ids.select("id", F.lit(True).alias("asked")), "id", "left")
    values = {"status": F.lit("approved"), "approved_at": instant(now), **{c: F.lit("pending") for c in PROVIDERS}}
    return _shaped(_update(marked, F.col("asked"), values, now), SHOWS)


def sync_approved(shows: DataFrame, deliveries: DataFrame, now: str) -> DataFrame:
    """Take over the delivery statuses (show_id, clay, heyreach, smartlead); live once all succeed."""
    pending = approved_pending(shows).select("id", F.lit(True).alias("open"))
    results = deliveries.select(F.col("show_id").alias("id"), "clay", "heyreach", "smartlead")
    marked = shows.join(pending.join(results, "id"), "id", "left")
    all_good = (F.col("clay") == "success") & (F.col("heyreach") == "success") & (F.col("smartlead") == "success")
    values = {
        "clay_status": F.col("clay"), "heyreach_status": F.col("heyreach"), "smartlead_status": F.col("smartlead"),
        "status": F.when(all_good, "live").otherwise(F.col("status")),
    }
    return _shaped(_update(marked, F.col("open"), values, now), SHOWS)


def delete_shows(shows: DataFrame, runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete shows together with their runs."""
    return (
        shows.join(ids.select("id"), "id", "left_anti"),
        runs.join(ids.select(F.col("id").alias("show_id")), "show_id", "left_anti"),
    )


def validate_transitions(shows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused) status events (show_id, new_status) given the current statuses."""
    spark = shows.sparkSession
    allowed = spark.createDataFrame(rules.TRANSITIONS, "status string, new_status string").withColumn("ok", F.lit(True))
    rows = events.join(shows.select(F.col("id").alias("show_id"), "status"), "show_id", "left").join(
        F.broadcast(allowed), ["status", "new_status"], "left"
    )
    return rows.filter("ok").drop("ok"), rows.filter("ok IS NULL").drop("ok")


def delivery_status(results: DataFrame, shows: DataFrame) -> DataFrame:
    """Status per show of its delivered rows (show_id, row_no, status_code).

    Success if every answer is 2xx, failed at the first other, skipped where
    nothing was configured (no answers).  ``sent`` counts rows before a failure.
    """
    good = F.col("status_code").between(200, 299)
    first_bad = results.filter(~good).groupBy("show_id").agg(
        F.min("row_no").alias("bad_row"), F.min_by("status_code", "row_no").alias("bad_code")
    )
    sent = (
        results.join(first_bad, "show_id", "left")
        .groupBy("show_id")
        .agg(
            F.count_if(F.col("bad_row").isNull() | (F.col("row_no") < F.col("bad_row"))).alias("sent"),
            F.max("bad_code").alias("bad_code"),
        )
    )
    status = F.when(F.col("sent").isNull(), "skipped").when(F.col("bad_code").isNull(), "success").otherwise("failed")
    message = (
        F.when(F.col("sent").isNull(), "No Clay integration method is configured.")
        .when(
            F.col("bad_code").isNull(),
            F.concat(F.lit("Sent "), F.col("sent").cast("string"), F.lit(" row(s) from the scraper export to Clay via webhook.")),
        )
        .otherwise(
            F.concat(F.lit("Clay webhook returned non-success status "), F.col("bad_code").cast("string"), F.lit("."))
        )
    )
    return (
        shows.select(F.col("id").alias("show_id"))
        .join(sent, "show_id", "left")
        .select("show_id", status.alias("status"), F.coalesce("sent", F.lit(0)).alias("sent"), message.alias("message"))
    )


def dedupe_leads(leads: DataFrame, order: str = "arrived_at", tie: str = "lead_id") -> DataFrame:
    """Latest lead per show and mail address; without an address a row is no lead."""
    clean = leads.withColumn("email_key", F.lower(F.trim("email"))).filter("email_key <> ''")
    others = [c for c in clean.columns if c not in ("show_id", "email_key")]
    return clean.groupBy("show_id", "email_key").agg(
        F.max_by(F.struct(*others), F.struct(order, tie)).alias("lead")
    ).select("show_id", "email_key", "lead.*")


def next_to_activate(shows: DataFrame, active: DataFrame) -> DataFrame:
    """The next ready show, if no show's campaign is active (``active``: show_id)."""
    busy = active.select(F.lit(1).alias("busy")).limit(1)
    ready = shows.filter("status IN ('ready_for_review', 'approved')").withColumn("busy", F.lit(1))
    # at most one row, so the broadcast is bounded
    return ready.join(F.broadcast(busy), "busy", "left_anti").drop("busy").orderBy("event_date", "id").limit(1)


def latest_status(events: DataFrame, key: str = "show_id", status: str = "status", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest status per show and how many events it had."""
    return events.groupBy(key).agg(
        F.max_by(status, F.struct(ts, tie)).alias("status"), F.max(ts).alias("changed_at"), F.count("*").alias("events")
    )
