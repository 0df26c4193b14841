"""The shared state store, streams on it, the lead export and the guarded status."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from stallworks import rules
from stallworks.operators import campaign as C
from stallworks.sinks import export as X
from stallworks.sources import schedule as S
from stallworks.streaming import jobs, status as G
from stallworks.streaming.store import Change, StateStore

NOW = "2026-06-01 12:00:00"


def shows_of(spark, n):
    rows = [(f"Show {i}", f"2026-{6 + i % 3:02d}-1{i % 5}", "P", f"https://s{i}.org", i) for i in range(n)]
    parsed = S.parsed_schedule(spark.createDataFrame(rows, "show string, date string, place string, link string, row_no long"), "2026-06-01")
    return C.upsert_shows(spark.createDataFrame([], S.SHOWS), parsed, "2026-05-01 00:00:00"), spark.createDataFrame([], S.RUNS)


def new_store(spark, tmp_path, n=40, name="state"):
    shows, runs = shows_of(spark, n)
    store = StateStore(spark, str(tmp_path / name), slots=8, buckets=4)
    store.create(shows=shows, runs=runs)
    return store


def rows_of(df, *columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(*(columns or df.columns)).collect()))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_commit_rewrites_only_touched_slots(spark, tmp_path):
    store = new_store(spark, tmp_path)
    before = store.read()
    some_id = before.tables["shows"].agg(F.min("id")).first()[0]
    one = before.tables["shows"].filter(F.col("id") == some_id).withColumn("name", F.lit("renamed"))
    held = files(store.path.removeprefix("file:"))
    version = store.commit("w", 0, lambda state: {"shows": Change(one)})
    slot = {r.slot for r in one.select(store.slot("id")).collect()}
    old, new = store.entry(before.version)["tables"], store.entry(version)["tables"]
    assert new["runs"] == old["runs"]
    assert {k for k in new["shows"] if new["shows"][k] != old["shows"].get(k)} == {str(s) for s in slot}
    assert held < files(store.path.removeprefix("file:"))  # no file of the old version was changed or replaced
    assert store.read().tables["shows"].filter("name = 'renamed'").count() == 1 and store.read().tables["shows"].count() == 40
    assert rows_of(store.read(0).tables["shows"]) == rows_of(before.tables["shows"])  # old versions stay readable
    assert store.expire(keep=1) == 1 and store.versions() == [version]
    assert store.read().tables["shows"].count() == 40


def test_state_side_of_a_join_has_no_exchange(spark, tmp_path):
    store = new_store(spark, tmp_path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = spark.range(5).withColumn("x", F.lit(1))
        plan = store.read().tables["shows"].join(changes, "id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the changes


def test_repeated_batch_changes_nothing(spark, tmp_path):
    store = new_store(spark, tmp_path)
    ticks = spark.sql(f"SELECT timestamp '{NOW}' AS now")
    jobs.apply(store, "due", 0, ticks, jobs.due_step)
    first = store.read()
    jobs.apply(store, "due", 0, ticks, jobs.due_step)
    assert store.read().version == first.version
    want = C.queue_due(*shows_of(spark, 40), NOW)
    for got, wanted in zip((first.tables["shows"], first.tables["runs"]), want):
        assert rows_of(got, "id", "status") == rows_of(wanted, "id", "status")


def test_writers_that_meet_do_not_lose_changes(spark, tmp_path):
    """Every writer renames its own shows, all at once; whoever is second starts over."""
    store = new_store(spark, tmp_path, 24)
    ids = [r.id for r in store.read().tables["shows"].select("id").orderBy("id").collect()]
    failures, tries = [], []

    def write(k):
        try:
            def step(state):
                tries.append(k)
                mine = state.tables["shows"].filter(F.col("id").isin(ids[k::4]))
                return {"shows": Change(mine.withColumn("name", F.concat("name", F.lit(f" by {k}"))))}
            StateStore(spark, store.path, slots=8, buckets=4).commit(f"w{k}", 0, step)
        except Exception as error:
            failures.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and store.versions() == [0, 1, 2, 3, 4] and len(tries) >= 4
    names = {r.id: r.name for r in store.read().tables["shows"].collect()}
    assert all(names[i].endswith(f" by {ids.index(i) % 4}") and names[i].count(" by ") == 1 for i in ids)


def test_conflict_starts_over_on_the_newer_version(spark, tmp_path):
    store = new_store(spark, tmp_path)
    seen = []

    def step(state):
        seen.append(state.version)
        if len(seen) == 1:  # another writer gets in between reading and committing
            store.commit("other", 0, lambda s: {"shows": Change(gone=s.tables["shows"].limit(3))})
        return {"shows": Change(state.tables["shows"].withColumn("place", F.lit("Q")))}

    store.commit("slow", 0, step)
    assert seen == [0, 1] and store.read().tables["shows"].filter("place = 'Q'").count() == 37


def test_import_approve_delete(spark, tmp_path):
    store = new_store(spark, tmp_path)
    rows = [("New name", "2026-06-10", "Q", "https://s0.org", 1), ("Added", "2026-09-09", "R", "https://new.org", 2)]
    parsed = S.parsed_schedule(spark.createDataFrame(rows, "show string, date string, place string, link string, row_no long"), "2026-06-01")
    jobs.import_shows(store, "import", 0, parsed, NOW)
    shows = store.read().tables["shows"]
    want = C.upsert_shows(shows_of(spark, 40)[0], parsed, NOW)
    assert rows_of(shows) == rows_of(want)
    ids = shows.filter("name = 'Added'").select("id")
    jobs.approve_shows(store, "approve", 0, ids, NOW)
    assert store.read().tables["shows"].filter("status = 'approved'").count() == 1
    jobs.apply(store, "due", 0, spark.sql(f"SELECT timestamp '{NOW}' AS now"), jobs.due_step)
    queued = store.read().tables["shows"].filter("status = 'queued'").select("id")
    n = queued.count()
    assert n and store.read().tables["runs"].count() == n
    jobs.delete_shows(store, "delete", 0, queued)
    assert store.read().tables["shows"].count() == 41 - n and store.read().tables["runs"].count() == 0


def stream_of(spark, tmp_path, name, rows, schema):
    """A folder of one file per batch, and the stream over it."""
    folder = tmp_path / name
    for row in rows:
        spark.createDataFrame(row if isinstance(row, list) else [row], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_share_one_state(spark, tmp_path):
    store = new_store(spark, tmp_path)
    ticks = stream_of(spark, tmp_path, "ticks", [(f"2026-06-0{d} 12:00:00",) for d in (1, 1, 1)], "now string")
    jobs.stream_due_runs(ticks.withColumn("now", F.col("now").cast("timestamp")), store, str(tmp_path / "c1"), seconds=None).awaitTermination()
    want_shows, want_runs = C.queue_due(*shows_of(spark, 40), NOW)
    assert rows_of(store.read().tables["shows"], "id", "status") == rows_of(want_shows, "id", "status")
    run = store.read().tables["runs"].first()
    schema = "run_id bigint, error string, output_path string, company_count int, failure_count int, clay_status string, clay_message string, notification_status string, now timestamp"
    results = stream_of(spark, tmp_path, "results", [[(run.id, None, "/x", 3, 1, "success", "", "success", None)] * 2], schema)
    jobs.stream_process_runs(results.withColumn("now", F.to_timestamp(F.lit(NOW))), store, str(tmp_path / "c2"), seconds=None).awaitTermination()
    show = store.read().tables["shows"].filter(F.col("id") == run.show_id).first()
    assert (show.status, show.company_count) == ("ready_for_review", 3) and store.read().tables["runs"].count() == want_runs.count()
    jobs.approve_shows(store, "approve", 0, spark.createDataFrame([(run.show_id,)], "id long"), NOW)
    deliveries = stream_of(spark, tmp_path, "deliveries", [(run.show_id, "success", "success", "success", None)], "show_id bigint, clay string, heyreach string, smartlead string, now timestamp")
    jobs.stream_sync(deliveries.withColumn("now", F.to_timestamp(F.lit(NOW))), store, str(tmp_path / "c3"), seconds=None).awaitTermination()
    assert store.read().tables["shows"].filter("status = 'live'").count() == 1
    assert set(store.read().applied) == {"due", "results", "sync", "approve"}


LEADS = "show_id int, email string, arrived_at timestamp, lead_id int, title string"


def lead(show, email, day, number, title):
    import datetime
    return (show, email, datetime.datetime(2026, 1, day), number, title)


def test_lead_export_is_kept_up_to_date(spark, tmp_path):
    batches = [[lead(1, "A@x.org", 1, 1, "old"), lead(2, "b@x.org", 1, 2, 'say "hi"')], [lead(1, "a@x.org ", 2, 3, "new"), lead(1, "", 3, 4, "none")],
               [lead(3, "c@x.org", 2, 5, ""), lead(1, "a@x.org", 1, 6, "older, but late")]]
    all_rows = spark.createDataFrame([r for b in batches for r in b], LEADS)
    store, out = jobs.lead_store(spark, str(tmp_path / "leads"), all_rows, 4, 2), str(tmp_path / "export")
    stream = stream_of(spark, tmp_path, "in", batches[:2], LEADS)
    jobs.stream_leads(stream, store, out, str(tmp_path / "c4")).awaitTermination()
    untouched = files(f"{out}/show_id=2")
    for _ in range(2):  # a batch that is repeated after a failure
        jobs.apply_leads(store, out, 99, spark.createDataFrame(batches[2], LEADS))
    want = C.dedupe_leads(all_rows).select("show_id", "email", "lead_id", "title")
    assert rows_of(X.read_export(spark, out), "show_id", "email", "lead_id", "title") == rows_of(want.withColumn("email", F.trim("email")))
    assert untouched and files(f"{out}/show_id=2") == untouched
    rebuilt = str(tmp_path / "rebuilt")
    X.write_lead_export(jobs.newest_leads(all_rows).drop("lead_key", "email_key"), rebuilt)
    assert rows_of(X.read_export(spark, rebuilt)) == rows_of(X.read_export(spark, out).select(*X.read_export(spark, rebuilt).columns))


def plain_moves(initial, events):
    state, refused = {k: [s, 0, 0] for k, s in initial.items()}, []
    for show, event, ts, new in events:
        held = state.setdefault(show, [None, 0, 0])
        held[1] += 1
        if (held[0], new) in {tuple(t) for t in rules.TRANSITIONS}:
            held[0] = new
        else:
            held[2] += 1
            refused.append(event)
    return {k: tuple(v) for k, v in state.items() if v[1]}, sorted(refused)


def test_guarded_status_over_batches(spark, tmp_path):
    import datetime
    import random
    rng = random.Random(2)
    initial = {k: rng.choice(rules.SHOW_STATUSES) for k in range(6)}
    events = [(rng.randrange(8), i, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=i), rng.choice(rules.SHOW_STATUSES)) for i in range(120)]
    schema = "show_id long, event_id long, ts timestamp, new_status string"
    stream = stream_of(spark, tmp_path, "events", [events[:50], events[50:70], events[70:]], schema)
    store = G.status_store(spark, str(tmp_path / "status"), 4, 2)
    first = spark.createDataFrame(list(initial.items()), "show_id long, status string")
    G.stream_guarded_status(stream, first, store, str(tmp_path / "refused"), str(tmp_path / "c5")).awaitTermination()
    got = {r.show_id: (r.status, r.events, r.refused) for r in store.read().tables["status"].collect()}
    want, refused = plain_moves(initial, events)
    assert got == want
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "refused")).collect()) == refused
    assert len(store.versions()) == 4
