"""Streams on shared state, schedule files, image lines and the outcome of every seed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.operators import campaign as C, dashboard as B, lines
from stallworks.plans import directory
from stallworks.session import shared_folder
from stallworks.sinks import export as X
from stallworks.sources import schedule as S, signals as G
from stallworks.streaming import jobs, status as G5
from stallworks.streaming.store import StateStore
from workloads import shared, sites
from workloads.campaigns import _ALLOWED, _RUNS, _SCHEDULE, _SHOWS, NOW, _list, _pick, runs, schedule, shows, stamp
from workloads.directories import _ENTRIES


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, rows, files):
    """A table written as so many files, read one file a batch."""
    path = _folder(spark, "events")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: rows of the larger table in a bucket: a task sorts one bucket at a time, so more rows need more buckets
BUCKET_ROWS = 2_000_000


def _store(spark, sf_dir):
    buckets = max(8, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // BUCKET_ROWS))
    store = StateStore(spark, _folder(spark, "state"), buckets=buckets)
    store.create(shows=shows(spark, sf_dir), runs=runs(spark, sf_dir))
    return store


def state_streams(spark, sf_dir):
    """Due shows are queued, results of runs booked and deliveries taken over by three streams on one state."""
    store, base = _store(spark, sf_dir), _folder(spark, "checkpoints")
    at = F.to_timestamp(F.lit(NOW))
    ticks = spark.read.parquet(f"{sf_dir}/region.parquet").select(at.alias("now"))
    jobs.stream_due_runs(_streamed(spark, ticks, 2), store, f"{base}/due", seconds=None).awaitTermination()
    r = F.col("id")
    booked = runs(spark, sf_dir).filter("status IN ('queued', 'running')").select(
        r.alias("run_id"), F.when(r % 5 == 0, F.concat(F.lit("failed run "), r.cast("string"))).alias("error"),
        F.concat(F.lit("/out/"), r.cast("string")).alias("output_path"), "company_count", F.lit(2).alias("failure_count"),
        F.when(r % 3 == 0, "failed").otherwise("success").alias("clay_status"), F.lit("Clay said no").alias("clay_message"),
        F.lit("skipped").alias("notification_status"), at.alias("now"),
    )
    jobs.stream_process_runs(_streamed(spark, booked, 1), store, f"{base}/results", seconds=None).awaitTermination()
    delivered = shows(spark, sf_dir).select(
        F.col("id").alias("show_id"), F.when(r % 2 == 0, "success").otherwise("failed").alias("clay"), F.lit("success").alias("heyreach"),
        F.when(r % 5 == 0, "skipped").otherwise("success").alias("smartlead"), at.alias("now"))
    jobs.stream_sync(_streamed(spark, delivered, 3), store, f"{base}/sync", seconds=None).awaitTermination()
    state = store.read()
    added = state.tables["runs"].filter(F.col("created_at") == C.instant(NOW)).groupBy(F.col("show_id").alias("id")).agg(F.count("*").alias("new_runs"))
    return state.tables["shows"].join(added, "id", "left").select(
        "id", "status", "clay_status", "heyreach_status", "smartlead_status", "last_error", "company_count", F.coalesce("new_runs", F.lit(0)).alias("new_runs"))


def state_import(spark, sf_dir):
    """A schedule taken over into the shared state; then the shows of one section are deleted with their runs."""
    store = _store(spark, sf_dir)
    parsed = S.parsed_schedule(schedule(spark, sf_dir), "1998-06-01")
    jobs.import_shows(store, "import", 0, parsed, NOW)
    failed = store.read().tables["shows"].filter("status = 'failed'").select("id")
    jobs.delete_shows(store, "delete", 0, failed)
    state = store.read()
    left = state.tables["runs"].groupBy(F.col("show_id").alias("id")).agg(F.count("*").alias("runs"))
    return state.tables["shows"].join(left, "id", "left").select(
        "source_url", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "name", "place", "status", stamp("run_at"), stamp("created_at"),
        F.coalesce("runs", F.lit(0)).alias("runs"))


def lead_export(spark, sf_dir):
    """Leads that arrive in three batches, each rewriting the export of its shows; the export read back."""
    leads = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 40).alias("show_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "A").otherwise("a"), (F.col("user_id") % 30).cast("string"), F.lit("@x.org")).alias("email"),
        F.col("ts").cast("timestamp").alias("arrived_at"), F.col("event_id").alias("lead_id"), F.col("event_type").alias("job_title"),
    )
    store, out = jobs.lead_store(spark, _folder(spark, "leads"), leads), _folder(spark, "lead-export")
    jobs.stream_leads(_streamed(spark, leads, 3), store, out, _folder(spark, "checkpoint"), delay="3650 days").awaitTermination()
    rows = X.read_export(spark, out)
    return rows.select(F.col("show_id").cast("bigint").alias("show_id"), F.lower("email").alias("email_key"), F.col("lead_id").cast("bigint").alias("lead_id"), "job_title")


def guarded_status(spark, sf_dir):
    """Status events move shows along allowed transitions only, over several batches with state in between."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("show_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        _pick([*rules.SHOW_STATUSES, "sold"], F.floor(F.col("event_id") / 3)).alias("new_status"))
    # batches in the order of time, as events arrive
    path = _folder(spark, "status-events")
    events.repartitionByRange(4, "ts", "event_id").write.parquet(path)
    names = sorted(r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect())
    store, base = G5.status_store(spark, _folder(spark, "status")), _folder(spark, "status-run")
    for name in names:  # one file after another into the folder that the stream watches
        spark.read.schema(events.schema).parquet(name).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        G5.stream_guarded_status(stream, shows(spark, sf_dir).select(F.col("id").alias("show_id"), "status"), store, f"{base}/refused", f"{base}/checkpoint").awaitTermination()
    return store.read().tables["status"].select("show_id", "status", "events", "refused")


def schedule_file(spark, sf_dir):
    """A schedule written as CSV files and read by its headers."""
    path = _folder(spark, "schedule")
    schedule(spark, sf_dir).select(F.col("show").alias(" Conference "), F.col("date").alias("Start Date"), F.col("place").alias("location"), F.col("link").alias("URL")).write.option(
        "header", True).option("emptyValue", "").csv(path)
    rows = S.parsed_schedule(S.read_schedule(spark, path), "1998-06-01")
    return rows.select("show", "place", "link", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), stamp("run_at"))


def skipped_schedule_rows(spark, sf_dir):
    """Rows of a schedule file that lack a field."""
    path = _folder(spark, "schedule")
    schedule(spark, sf_dir).select("show", "date", "place", "link").write.option("header", True).option("emptyValue", "").csv(path)
    return S.skipped_rows(S.read_schedule(spark, path)).select("show", "date", "place", "link")


def show_listing(spark, sf_dir):
    """All shows in the order of the list, and the runs of the first of them."""
    listed = S.listed_shows(shows(spark, sf_dir))
    first = listed.orderBy("event_date", F.desc("created_at"), "id").first().id
    own = B.runs_of_show(shows(spark, sf_dir), runs(spark, sf_dir), first).select("id", F.count("run_id").over(C.Window.partitionBy("id")).alias("runs")).distinct()
    return listed.join(own, "id", "left").select("id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.coalesce("runs", F.lit(-1)).alias("runs"))


def image_lines(spark, sf_dir):
    """Lines of texts that were read from images: whole texts of all turns."""
    path = _folder(spark, "image-texts")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit("https://ocr.example.com/").alias("seed_url"), F.concat(F.lit("img-"), F.col("conv_id").cast("string")).alias("image_url"),
        F.col("turn").alias("image_rank"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text")).write.parquet(path)
    return lines.read_ocr_lines(spark, path).select("image_url", "image_rank", "line_no", "line")


# --- landing pages that lead to directories ---------------------------------------------

CHAIN = 40


def gate_pages(spark, sf_dir):
    """A landing page per customer in chains of 40: each links to the next, the last to a directory, or back to the first."""
    rows = sites.companies(spark, sf_dir).select("key", "seed_url")
    k = F.col("key")
    address = lambda n: F.concat(F.lit("https://gate-"), n.cast("string"), F.lit(".example.com/"))
    last = F.when(F.floor(k / CHAIN) % 3 == 0, address(F.floor(k / CHAIN) * CHAIN)).otherwise(F.col("seed_url"))
    target = F.when(k % CHAIN == CHAIN - 1, last).otherwise(address(k + 1))
    html = F.concat(F.lit("<html><head><title>Gate</title></head><body><main><a href=\""), target, F.lit("\">Exhibitors</a></main></body></html>"))
    return rows.select(address(k).alias("url"), html.alias("html"), k.alias("key"))


def seed_outcomes(spark, sf_dir):
    """What becomes of every asked landing page: entries of the directory it leads to, or one reason why there are none."""
    gates = shared.written(spark, sf_dir, "gates", lambda: gate_pages(spark, sf_dir))
    signals = shared.written(spark, sf_dir, "gate_signals", lambda: G.page_signals(shared.spread(spark, gates)))
    pages = shared.site_pages(spark, sf_dir).unionByName(gates.select("url", "html"))
    both = shared.site_signals(spark, sf_dir).unionByName(signals)
    k = F.col("key")
    seeds = gates.select(
        F.when(k % 11 == 0, F.concat(F.lit("https://missing-"), k.cast("string"), F.lit(".example.com/"))).otherwise(F.col("url")).alias("seed_url"),
        F.when(k % 7 == 0, 5).when(k % 5 == 0, 2).cast("int").alias("start_page"), F.when(k % 7 == 0, 2).cast("int").alias("end_page"))
    run = directory.directory_run(seeds, pages, both)
    return run.outcomes.select("seed_url", "entries", F.coalesce("error", F.lit("")).alias("error"))


QUERIES = {f.__name__: f for f in (
    state_streams, state_import, lead_export, guarded_status, schedule_file, skipped_schedule_rows, show_listing, image_lines, seed_outcomes)}

_BOOKED = """
    q AS (SELECT show_id, max(struct_pack(c := created_at, id := id, n := company_count)) AS r FROM ru WHERE status IN ('queued', 'running') GROUP BY show_id),
    j AS (SELECT d.*, r.id AS rid, r.n AS n, r.id % 5 = 0 AS bad, r.id % 3 = 0 AS cl FROM d LEFT JOIN q ON d.id = show_id),
    b AS (SELECT id, is_due, CASE WHEN rid IS NULL THEN status WHEN bad THEN 'failed' ELSE 'ready_for_review' END AS status, CASE WHEN NOT bad THEN n ELSE company_count END AS company_count,
        CASE WHEN rid IS NULL THEN last_error WHEN bad THEN concat('failed run ', rid) WHEN cl THEN 'Clay said no' ELSE '' END AS last_error,
        CASE WHEN NOT bad THEN CASE WHEN cl THEN 'failed' ELSE 'success' END ELSE clay_status END AS clay_status,
        CASE WHEN NOT bad THEN 'pending' ELSE heyreach_status END AS heyreach_status, CASE WHEN NOT bad THEN 'pending' ELSE smartlead_status END AS smartlead_status FROM j)"""

ORACLES = {
    "state_streams": f"""
        WITH {_SHOWS}, {_RUNS}, d AS (SELECT * REPLACE (CASE WHEN status = 'waiting' AND run_at <= TIMESTAMP '{NOW}' THEN 'queued'
                WHEN EXISTS (SELECT 1 FROM ru WHERE show_id = sh.id AND ru.status = 'queued') THEN 'scraping' ELSE status END AS status,
                CASE WHEN EXISTS (SELECT 1 FROM ru WHERE show_id = sh.id AND ru.status = 'queued') THEN '' ELSE last_error END AS last_error),
            status = 'waiting' AND run_at <= TIMESTAMP '{NOW}' AS is_due FROM sh), {_BOOKED},
        o AS (SELECT *, status = 'approved' AND (heyreach_status = 'pending' OR smartlead_status = 'pending') AS op FROM b)
        SELECT id, CASE WHEN op AND id % 2 = 0 AND id % 5 <> 0 THEN 'live' ELSE status END AS status, CASE WHEN op THEN CASE WHEN id % 2 = 0 THEN 'success' ELSE 'failed' END ELSE clay_status END AS clay_status,
            CASE WHEN op THEN 'success' ELSE heyreach_status END AS heyreach_status, CASE WHEN op THEN CASE WHEN id % 5 = 0 THEN 'skipped' ELSE 'success' END ELSE smartlead_status END AS smartlead_status,
            last_error, company_count, CAST(is_due AS INT) AS new_runs FROM o""",
    "state_import": f"""
        WITH {_SHOWS}, {_SCHEDULE}, {_RUNS},
        u AS (SELECT id, coalesce(source_url, link) AS source_url, coalesce(event_date, d) AS day, coalesce(show_, name) AS name, CASE WHEN show_ IS NOT NULL THEN 'Berlin' ELSE place END AS place,
            coalesce(status, 'waiting') AS status, CASE WHEN id IS NULL THEN '{NOW}' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at
            FROM sh FULL JOIN inc ON source_url = link AND event_date = d),
        r AS (SELECT show_id, count(*) AS n FROM ru GROUP BY show_id)
        SELECT source_url, strftime(day, '%Y-%m-%d') AS event_date, name, place, status, strftime(day - INTERVAL 14 DAY, '%Y-%m-%d 09:00:00') AS run_at, created_at, coalesce(n, 0) AS runs
        FROM u LEFT JOIN r ON show_id = id WHERE status <> 'failed'""",
    "lead_export": """
        WITH l AS (SELECT user_id % 40 AS show_id, concat('a', user_id % 30, '@x.org') AS email_key, event_id, event_type,
            row_number() OVER (PARTITION BY user_id % 40, user_id % 30 ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT show_id, email_key, event_id AS lead_id, event_type AS job_title FROM l WHERE n = 1""",
    "guarded_status": f"""
        WITH {_SHOWS}, e AS (SELECT user_id, list({_list([*rules.SHOW_STATUSES, "sold"])}[event_id // 3 % 8 + 1] ORDER BY ts, event_id) AS moves FROM events GROUP BY user_id),
        f AS (SELECT user_id, len(moves) AS events, list_reduce(list_concat([struct_pack(s := coalesce(status, ''), bad := 0)], list_transform(moves, lambda m: struct_pack(s := m, bad := 0))),
            lambda a, m: CASE WHEN list_contains([{", ".join(f"'{a}>{b}'" for a, b in rules.TRANSITIONS)}], a.s || '>' || m.s) THEN struct_pack(s := m.s, bad := a.bad) ELSE struct_pack(s := a.s, bad := a.bad + 1) END) AS r
            FROM e LEFT JOIN sh ON user_id = id)
        SELECT user_id AS show_id, nullif(r.s, '') AS status, events, r.bad AS refused FROM f""",
    "schedule_file": f"""
        WITH {_SCHEDULE} SELECT show_ AS show, 'Berlin' AS place, link, strftime(d, '%Y-%m-%d') AS event_date, strftime(d - INTERVAL 14 DAY, '%Y-%m-%d 09:00:00') AS run_at FROM sc WHERE show_ <> ''""",
    "skipped_schedule_rows": f"""
        WITH {_SCHEDULE} SELECT '' AS show, CASE WHEN d IS NULL THEN 'soon' ELSE strftime(d, '%b %-d, %Y') END AS date, 'Berlin' AS place, link FROM sc WHERE show_ = ''""",
    "show_listing": f"""
        WITH {_SHOWS}, {_RUNS}, f AS (SELECT id FROM sh ORDER BY event_date, id LIMIT 1)
        SELECT id, strftime(event_date, '%Y-%m-%d') AS event_date, CASE WHEN id = (SELECT id FROM f) THEN (SELECT count(*) FROM ru WHERE show_id = (SELECT id FROM f)) ELSE -1 END AS runs FROM sh""",
    "image_lines": """
        WITH t AS (SELECT conv_id, turn, regexp_split_to_array(replace(text, '. ', '.' || chr(10)), '\\r\\n|\\r|\\n') AS l FROM conversations),
        u AS (SELECT conv_id, turn, unnest(range(len(l))) AS n, unnest(l) AS raw FROM t),
        v AS (SELECT *, trim(regexp_replace(raw, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+', ' ', 'g')) AS line FROM u)
        SELECT concat('img-', conv_id) AS image_url, turn AS image_rank, n AS line_no, line FROM v WHERE line <> ''""",
    "seed_outcomes": f"""
        WITH {_ENTRIES}, k AS (SELECT k, seed_url AS own FROM c), z AS (SELECT k, k // {CHAIN} AS chain FROM k),
        g AS (SELECT z.k, l.own AS target FROM z LEFT JOIN k l ON l.k = z.chain * {CHAIN} + {CHAIN - 1} AND z.chain % 3 <> 0),
        h AS (SELECT k, target, CASE WHEN k % 7 = 0 THEN 5 WHEN k % 5 = 0 THEN 2 ELSE 1 END AS a FROM g),
        m AS (SELECT h.k, count(e.k) AS n FROM h LEFT JOIN e ON e.seed_url = h.target AND e.page >= h.a GROUP BY h.k)
        SELECT CASE WHEN k % 11 = 0 THEN concat('https://missing-', k, '.example.com/') ELSE concat('https://gate-', k, '.example.com/') END AS seed_url,
            CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN 0 ELSE n END AS entries,
            CASE WHEN k % 11 = 0 THEN '{directory.UNKNOWN}' WHEN k % 7 = 0 THEN '{directory.EMPTY_RANGE}' WHEN n = 0 THEN '{directory.NO_ENTRIES}' ELSE '' END AS error FROM m""",
}
