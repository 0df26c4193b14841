"""Streams over the shared state store.

Every stream is a writer of the store under its own name.  A micro-batch reads the newest
version, works out the rows that its events change (only those of the shows and runs they name),
and commits them; if another stream committed in between, it does so again on the newer version.  A
batch that is repeated after a failure finds its number in the log and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stallworks.operators import campaign as C
from stallworks.session import cut_lineage
from stallworks.sinks import export as X
from stallworks.streaming.store import Change, Layout, StateStore

Step = Callable[[DataFrame, DataFrame, DataFrame, str], dict[str, Change]]


def _run(events: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def apply(store: StateStore, writer: str, number: int, rows: DataFrame, step: Step) -> None:
    """Commits what one batch of events (with a column ``now``) changes."""
    now = rows.agg(F.date_format(F.max("now"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if now is not None:
        held = cut_lineage(rows)  # read again whenever another writer was first
        store.commit(writer, number, lambda state: step(held, state.tables["shows"], state.tables["runs"], now))


def _start(events: DataFrame, step: Step, store: StateStore, writer: str, checkpoint: str, seconds: int | None) -> StreamingQuery:
    return _run(events, lambda rows, number: apply(store, writer, number, rows, step), checkpoint, seconds)


# --- steps: events and state to changed rows -------------------------------------


def due_step(rows: DataFrame, shows: DataFrame, runs: DataFrame, now: str) -> dict[str, Change]:
    queued, added = C.queue_due(C.due_shows(shows, now), runs.filter(F.lit(False)), now)
    return {"shows": Change(queued), "runs": Change(added)}


def results_step(rows: DataFrame, shows: DataFrame, runs: DataFrame, now: str) -> dict[str, Change]:
    """Book run results, the newest of each run; the row's ``now`` is only the time of booking."""
    others = [c for c in rows.columns if c not in ("run_id", "now")]
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*others), "now").alias("r")).select("run_id", "r.*")
    hit = runs.join(newest.select(F.col("run_id").alias("id")), "id", "left_semi")
    of_hit = shows.join(hit.select(F.col("show_id").alias("id")).distinct(), "id", "left_semi")
    changed, booked = C.apply_run_results(*C.start_runs(of_hit, hit, now), newest, now)
    return {"shows": Change(changed), "runs": Change(booked)}


def sync_step(rows: DataFrame, shows: DataFrame, runs: DataFrame, now: str) -> dict[str, Change]:
    newest = rows.groupBy("show_id").agg(F.max_by(F.struct("clay", "heyreach", "smartlead"), "now").alias("d")).select("show_id", "d.*")
    hit = shows.join(newest.select(F.col("show_id").alias("id")), "id", "left_semi")
    return {"shows": Change(C.sync_approved(hit, newest, now))}


def import_shows(store: StateStore, writer: str, number: int, parsed: DataFrame, now: str, strict: bool = False) -> int:
    """Inserts and updates the shows of a schedule file; only the slots of its shows are rewritten."""
    keys = parsed.select(F.col("link").alias("source_url"), "event_date").distinct()

    def step(state):
        known = state.tables["shows"].join(keys, ["source_url", "event_date"], "left_semi")
        return {"shows": Change(C.upsert_shows(known, parsed, now, strict))}

    return store.commit(writer, number, step)


def approve_shows(store: StateStore, writer: str, number: int, ids: DataFrame, now: str) -> int:
    return store.commit(writer, number, lambda state: {
        "shows": Change(C.approve(state.tables["shows"].join(ids.select("id"), "id", "left_semi"), ids, now))})


def delete_shows(store: StateStore, writer: str, number: int, ids: DataFrame) -> int:
    """Deletes shows together with their runs."""
    return store.commit(writer, number, lambda state: {
        "shows": Change(gone=ids.select("id").distinct()),
        "runs": Change(gone=state.tables["runs"].join(ids.select(F.col("id").alias("show_id")).distinct(), "show_id", "left_semi"))})


# --- streams ---------------------------------------------------------------------


def stream_due_runs(ticks: DataFrame, store: StateStore, checkpoint: str, seconds: int | None = 30) -> StreamingQuery:
    """Queue due shows on every tick (column ``now``)."""
    return _start(ticks, due_step, store, "due", checkpoint, seconds)


def stream_process_runs(results: DataFrame, store: StateStore, checkpoint: str, seconds: int | None = 30) -> StreamingQuery:
    """Book the results of runs as they arrive."""
    return _start(results, results_step, store, "results", checkpoint, seconds)


def stream_sync(deliveries: DataFrame, store: StateStore, checkpoint: str, seconds: int | None = 30) -> StreamingQuery:
    """Take over delivery statuses as they arrive."""
    return _start(deliveries, sync_step, store, "sync", checkpoint, seconds)


# --- leads and their export --------------------------------------------------------


def lead_store(spark: SparkSession, path: str, leads: DataFrame, slots: int = 16, buckets: int = 8) -> StateStore:
    """A store for leads with the columns of a table or stream, empty if it is new."""
    given = [f"{f.name} {f.dataType.simpleString()}" for f in leads.schema if f.name not in ("lead_key", "email_key")]
    columns = ", ".join(["lead_key bigint", "email_key string", *given])
    store = StateStore(spark, path, {"leads": Layout(columns, "lead_key", "show_id")}, slots, buckets)
    store.create(leads=spark.createDataFrame([], columns))
    return store


def newest_leads(leads: DataFrame) -> DataFrame:
    """The newest lead per show and address, with its key."""
    return C.dedupe_leads(leads).withColumn("lead_key", C.key_id("show_id", "email_key"))


def apply_leads(store: StateStore, path: str, number: int, rows: DataFrame) -> None:
    """Commits a batch of leads and writes the export of the shows it names anew; exports of other shows stay as they are."""
    fresh = cut_lineage(newest_leads(rows))
    keys = fresh.select("lead_key")

    def step(state):
        both = state.tables["leads"].join(keys, "lead_key", "left_semi").unionByName(fresh)
        others = [c for c in both.columns if c != "lead_key"]
        best = both.groupBy("lead_key").agg(F.max_by(F.struct(*others), F.struct("arrived_at", "lead_id")).alias("r"))
        return {"leads": Change(best.select("lead_key", "r.*"))}

    store.commit("leads", number, step)
    # also where the commit was there already: the failure may have come between the two
    touched = cut_lineage(fresh.select("show_id").distinct())
    leads = store.read().tables["leads"].join(touched, "show_id", "left_semi")
    X.write_lead_export(leads.drop("lead_key", "email_key"), path)


def stream_leads(leads: DataFrame, store: StateStore, path: str, checkpoint: str, delay: str = "1 day", seconds: int | None = None) -> StreamingQuery:
    """Enriched leads (show_id, email, arrived_at, lead_id, ...) into the store and the export of their shows.

    Repeats inside the watermark are dropped in state, and leads that come later than it are left out; what passes
    replaces an older lead of the same show and address.
    """
    keyed = leads.withColumn("email_key", F.lower(F.trim("email"))).filter("email_key <> ''")
    fresh = keyed.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["show_id", "email_key", "lead_id"]).drop("email_key")
    return _run(fresh, lambda rows, number: apply_leads(store, path, number, rows), checkpoint, seconds)


# --- status ------------------------------------------------------------------------


def stream_status(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", tie: str = "event_id") -> StreamingQuery:
    """Newest status per show as a running aggregate.

    Each batch writes only the shows that changed, under its own number; a
    repeated batch replaces its own part.
    """
    folded = C.latest_status(events, ts=ts, tie=tie)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        folded.writeStream.outputMode("update").foreachBatch(batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_status(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of each show."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in ("show_id", "batch")]
    return rows.groupBy("show_id").agg(F.max_by(F.struct(*others), "batch").alias("r")).select("show_id", "r.*")
