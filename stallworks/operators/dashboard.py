"""Dashboard tables: cards, sections, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallworks.functions import dates as D, text as T
from stallworks.operators.campaign import instant

# --- fixed values: section, step and next action per state --------------------
FLOW = [
    ("waiting_due", "ready_now", "Inside the run window",
     "The worker should run this soon. Use Run Immediately only if you want to force it now."),
    ("waiting", "scheduled_later", "Waiting for trigger window",
     "No action needed yet. The worker should queue it at the scheduled time."),
    ("queued", "in_progress", "Queued for worker", "The worker should pick this up next."),
    ("scraping", "in_progress", "Scrape is running", "Wait for the export and Clay handoff to finish."),
    ("ready_for_review", "completed", "Ready for review", "Review the export, then approve if it looks good."),
    ("approved", "completed", "Approved", "Waiting on the downstream outbound sync."),
    ("live", "completed", "Completed", "This show has already run through the flow."),
]
OTHER = ("in_progress", "Needs attention", "Retry this scrape after reviewing the latest error.")


def show_section(now: str) -> list[Column]:
    """Section, step and next action of a show."""
    due = (F.col("status") == "waiting") & (F.col("run_at") <= instant(now))
    state = F.when(due, "waiting_due").otherwise(F.col("status"))
    columns = []
    for position, name in enumerate(("section", "step_label", "next_action")):
        value = F.lit(OTHER[position])
        for row in reversed(FLOW):
            value = F.when(state == row[0], row[position + 1]).otherwise(value)
        columns.append(value.alias(name))
    return columns


def show_notice() -> list[Column]:
    """Tone, title and detail of the notice of a show; NULL where there is none."""
    failed = F.col("status") == "failed"
    clay_failed, clay_sent = F.col("clay_status") == "failed", F.col("clay_status") == "success"
    mail_failed = F.col("notification_status") == "failed"
    has_rows = F.col("company_count") > 0
    tone = F.when(failed, "danger").when(has_rows & (clay_failed | mail_failed), "warning").when(has_rows, "success")
    title = (
        F.when(failed, "Scrape needs attention")
        .when(has_rows & clay_failed, "Clay upload needs retry")
        .when(has_rows & mail_failed, "Email notification needs retry")
        .when(has_rows, "Scrape completed")
    )
    details = F.concat_ws(
        " ",
        F.when(clay_failed, "The export finished, but Clay throttled or rejected the row push.").when(
            clay_sent, "Rows were sent to Clay."
        ),
        F.when(mail_failed, "The export is ready, but the Outlook notification email did not send."),
    )
    plain = F.concat(F.col("company_count").cast("string"), F.lit(" companies were exported and are ready for review."))
    summary = F.coalesce(F.nullif(T.error_summary("last_error"), F.lit("")), F.lit("The latest scrape attempt failed."))
    detail = F.when(failed, summary).when(has_rows, F.coalesce(F.nullif(details, F.lit("")), plain))
    return [tone.alias("notice_tone"), title.alias("notice_title"), detail.alias("notice_detail")]


def provider_summary() -> Column:
    return (
        F.when(F.col("clay_status") == "success", "Clay received the export.")
        .when(F.col("clay_status") == "failed", "Clay push needs a retry.")
        .when(F.col("company_count") > 0, "Clay has not received this export yet.")
        .otherwise("Clay has nothing to send yet.")
    )


def show_cards(shows: DataFrame, now: str) -> DataFrame:
    """Everything a card shows, as one projection."""
    return shows.select(
        "id", "name", "event_date", "run_at", "status", "company_count",
        *show_section(now),
        *show_notice(),
        T.error_summary("last_error").alias("error_summary"),
        D.run_timing_label(F.col("run_at"), instant(now)).alias("run_timing"),
        provider_summary().alias("provider_summary"),
        F.replace("status", F.lit("_"), F.lit(" ")).alias("status_label"),
    )


def section_order(cards: DataFrame) -> DataFrame:
    """Cards in the order of their section: by trigger time, finished ones by event date."""
    done = F.col("section") == "completed"
    return cards.orderBy(
        "section",
        F.when(done, F.col("event_date")).asc_nulls_first(), F.col("run_at").asc_nulls_last(), "event_date", "id",
    )


def ids_in_section(shows: DataFrame, section: str, now: str) -> DataFrame:
    """Shows of a section; "active" stands for those ready or in progress."""
    wanted = ["ready_now", "in_progress"] if section == "active" else [section]
    return shows.select("id", show_section(now)[0]).filter(F.col("section").isin(wanted)).select("id")


def dashboard_counts(cards: DataFrame) -> DataFrame:
    """Counts per section and in total (section NULL)."""
    board = F.when(F.col("section").isin("ready_now", "in_progress"), "active").otherwise(F.col("section"))
    return cards.withColumn("board", board).rollup("board").agg(
        F.count("*").alias("shows"),
        F.count_if(F.col("status") == "ready_for_review").alias("ready"),
        F.count_if(F.col("company_count") > 0).alias("completed"),
        F.sum("company_count").alias("leads"),
    )


def shows_with_runs(shows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per show and run; runs of a show stand newest first when sorted by ``run_place``.

    Flat instead of nested, so a show with very many runs stays many rows.
    """
    columns = runs.select(
        F.col("show_id").alias("id"), F.col("id").alias("run_id"), F.col("status").alias("run_status"),
        F.col("created_at").alias("run_created_at"), F.col("company_count").alias("run_company_count"),
    )
    return shows.join(columns, "id", "left")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per show and the number of its runs."""
    return runs.groupBy("show_id").agg(
        F.max_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id")).alias("run"),
        F.count("*").alias("run_count"),
    ).select("show_id", "run_count", F.col("run.id").alias("run_id"), F.col("run.status").alias("run_status"),
             F.col("run.created_at").alias("run_created_at"))


def runs_of_show(shows: DataFrame, runs: DataFrame, show_id: int) -> DataFrame:
    """One show with its runs, newest first."""
    return shows_with_runs(shows.filter(F.col("id") == show_id), runs).orderBy(F.desc("run_created_at"), F.desc("run_id"))
