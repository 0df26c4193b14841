"""Schedule, campaign state, dashboard and payloads, with orders as shows and lineitems as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallworks import rules
from stallworks.functions import dates as D
from stallworks.operators import campaign as C, dashboard as B, entries as N
from stallworks.sinks import export as X, payloads as L
from stallworks.sources import embedded as E, schedule as S
from workloads import shared

NOW = "1998-06-01 12:00:00"
SCRAPED_AT = "2026-01-02T03:04:05+00:00"


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def shows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("id"), F.concat(F.lit("Show "), c.cast("string")).alias("name"), day.alias("event_date"),
        F.concat(F.lit("Hall "), (c % 20).cast("string")).alias("place"),
        F.concat(F.lit("https://show.example.com/"), k.cast("string")).alias("source_url"),
        F.lit(14).alias("run_offset_days"), D.run_at(day, F.lit(14)).alias("run_at"),
        _pick(rules.SHOW_STATUSES, k).alias("status"), F.lit(True).alias("approval_required"),
        F.lit(None).cast("timestamp_ntz").alias("approved_at"),
        F.when(c % 2 == 0, F.concat(F.lit("/exports/"), k.cast("string"))).otherwise("").alias("latest_export_path"),
        (c % 4 * 10).cast("int").alias("company_count"), (c % 3).cast("int").alias("failure_count"),
        F.when(k % 7 == 6, F.concat(F.lit("HTTP 429 for "), c.cast("string"))).otherwise("").alias("last_error"),
        _pick(rules.PROVIDER_STATUSES, k + c).alias("notification_status"), _pick(rules.PROVIDER_STATUSES, c).alias("clay_status"),
        _pick(rules.PROVIDER_STATUSES, F.floor(k / 7)).alias("heyreach_status"), _pick(rules.PROVIDER_STATUSES, F.floor(k / 28)).alias("smartlead_status"),
        F.date_sub(day, 30).cast("timestamp_ntz").alias("created_at"), F.date_sub(day, 30).cast("timestamp_ntz").alias("updated_at"),
    )
    return rows


def runs(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("day"), F.sum("l_quantity").cast("int").alias("qty")
    )
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.select(
        k.alias("id"), F.col("l_orderkey").alias("show_id"), _pick(rules.RUN_STATUSES, k).alias("status"), F.lit("").alias("output_path"),
        F.col("qty").alias("company_count"), F.lit(0).alias("failure_count"), F.lit("").alias("error_message"),
        F.col("day").cast("date").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def schedule(spark, sf_dir):
    """Schedule rows: each order is a row; links repeat, some rows are incomplete, some dates unknown."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("New "), k.cast("string"))).alias("show"),
        F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "MMM d, yyyy")).alias("date"),
        F.lit("Berlin").alias("place"),
        F.concat(F.lit("https://show.example.com/"), (F.floor(k / 2) * 2 + F.when(k % 3 == 0, 0).otherwise(k % 2)).cast("string")).alias("link"),
        k.alias("row_no"),
    )


def schedule_upsert(spark, sf_dir):
    known = shows(spark, sf_dir)
    parsed = S.parsed_schedule(schedule(spark, sf_dir), "1998-06-01")
    out = C.upsert_shows(known, parsed, NOW)
    return out.select("source_url", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "name", "place", "status", stamp("run_at"), stamp("created_at"), stamp("updated_at"))


def schedule_summary(spark, sf_dir):
    known = shows(spark, sf_dir)
    rows = schedule(spark, sf_dir)
    return C.import_summary(rows, S.parsed_schedule(rows, "1998-06-01"), known)


def due_queue(spark, sf_dir):
    s, r = C.queue_due(shows(spark, sf_dir), runs(spark, sf_dir), NOW)
    a = s.groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", F.lit("show"))
    b = r.groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", F.lit("run"))
    return a.unionByName(b)


def due_shows(spark, sf_dir):
    return C.due_shows(shows(spark, sf_dir), NOW).select("id", stamp("run_at"))


def queue_asked(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    s, r = C.queue_now(shows(spark, sf_dir), runs(spark, sf_dir), ids, NOW)
    added = r.filter(F.col("created_at") == C.instant(NOW)).select(F.col("show_id").alias("id"), F.lit(1).alias("new_runs"))
    return s.join(added, "id", "left").select("id", "status", stamp("run_at"), "failure_count", "last_error", "clay_status", F.coalesce("new_runs", F.lit(0)).alias("new_runs"))


def run_results(spark, sf_dir):
    s, r = shows(spark, sf_dir), runs(spark, sf_dir)
    s, r = C.start_runs(s, r, NOW)
    results = r.filter("status = 'running'").select(
        F.col("id").alias("run_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("failed run "), F.col("id").cast("string"))).alias("error"),
        F.concat(F.lit("/out/"), F.col("id").cast("string")).alias("output_path"), "company_count", F.lit(2).alias("failure_count"),
        F.when(F.col("id") % 3 == 0, "failed").otherwise("success").alias("clay_status"), F.lit("Clay said no").alias("clay_message"),
        F.lit("skipped").alias("notification_status"),
    )
    s, _ = C.apply_run_results(s, r, results, NOW)
    return s.select("id", "status", "latest_export_path", "company_count", "failure_count", "last_error", "clay_status", "heyreach_status", "notification_status")


def approve_and_sync(spark, sf_dir):
    base = shows(spark, sf_dir)
    ids = base.filter("status = 'ready_for_review' AND company_count > 0").select("id")
    approved = C.approve(base, ids, NOW)
    deliveries = base.select(
        F.col("id").alias("show_id"), F.when(F.col("id") % 2 == 0, "success").otherwise("failed").alias("clay"),
        F.lit("success").alias("heyreach"), F.when(F.col("id") % 5 == 0, "skipped").otherwise("success").alias("smartlead"),
    )
    out = C.sync_approved(approved, deliveries, NOW)
    return out.select("id", "status", "clay_status", "heyreach_status", "smartlead_status", F.col("approved_at").isNotNull().cast("int").alias("stamped"))


def delete_section(spark, sf_dir):
    s, r = shows(spark, sf_dir), runs(spark, sf_dir)
    left, left_runs = C.delete_shows(s, r, B.ids_in_section(s, "active", NOW))
    return left.groupBy("status").agg(F.count("*").alias("shows")).join(
        left_runs.join(left.select(F.col("id").alias("show_id"), F.col("status").alias("show_status")), "show_id")
        .groupBy(F.col("show_status").alias("status")).agg(F.count("*").alias("runs")), "status", "left"
    ).select("status", "shows", F.coalesce("runs", F.lit(0)).alias("runs"))


def transition_check(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("user_id").alias("show_id"), _pick([*rules.SHOW_STATUSES, "sold"], F.col("event_id")).alias("new_status")
    )
    good, bad = C.validate_transitions(shows(spark, sf_dir), events)
    return good.withColumn("allowed", F.lit(1)).unionByName(bad.withColumn("allowed", F.lit(0))).select("event_id", "new_status", "allowed")


def delivery_results(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("show_id"), F.col("event_id").alias("row_no"),
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), 500).otherwise(200).alias("status_code"),
    )


def delivery_status(spark, sf_dir):
    return C.delivery_status(delivery_results(spark, sf_dir), shows(spark, sf_dir)).select("show_id", "status", "sent", "message")


def next_active(spark, sf_dir):
    s = shows(spark, sf_dir)
    nobody = s.filter("status = 'no such status'").select(F.col("id").alias("show_id"))
    busy = s.filter("status = 'live'").select(F.col("id").alias("show_id"))
    return C.next_to_activate(s, nobody).select("id", F.lit("free").alias("state")).unionByName(
        C.next_to_activate(s, busy).select("id", F.lit("busy").alias("state"))
    )


def show_cards(spark, sf_dir):
    cards = B.show_cards(shows(spark, sf_dir), NOW)
    return cards.select("id", "section", "step_label", "next_action", "notice_tone", "notice_title", "notice_detail", "error_summary", "run_timing", "provider_summary", "status_label")


def dashboard_counts(spark, sf_dir):
    return B.dashboard_counts(B.show_cards(shows(spark, sf_dir), NOW)).select(F.coalesce("board", F.lit("all")).alias("board"), "shows", "ready", "completed", "leads")


def section_positions(spark, sf_dir):
    """Cards of the board in display order."""
    return B.section_order(B.show_cards(shows(spark, sf_dir), NOW)).select("id", "section")


def runs_latest(spark, sf_dir):
    return B.latest_runs(runs(spark, sf_dir)).select("show_id", "run_count", "run_id", "run_status", stamp("run_created_at"))


def shows_with_runs(spark, sf_dir):
    return B.shows_with_runs(shows(spark, sf_dir), runs(spark, sf_dir)).select("id", "name", F.coalesce("run_id", F.lit(-1)).alias("run_id"), "run_status", F.coalesce("run_company_count", F.lit(-1)).alias("run_company_count"))


def run_queue(spark, sf_dir):
    r = runs(spark, sf_dir)
    first = C.next_run(r).select("id", F.lit(1).alias("is_next"))
    return C.queue_order(r).join(first, "id", "left").select("id", "show_id", F.coalesce("is_next", F.lit(0)).alias("is_next"))


def export_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("show_id"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("sort_index"),
        F.concat(F.lit("Company "), F.col("l_partkey").cast("string")).alias("company_name"),
        F.concat(F.lit("https://c"), F.col("l_suppkey").cast("string"), F.lit(".example.com/")).alias("website_url"),
        F.lit("old").alias("show_name"),
    )


def delivery_payload(spark, sf_dir):
    rows = L.delivery_payload(export_table(spark, sf_dir), shows(spark, sf_dir), SCRAPED_AT)
    names = ("company_name", "website_url", "sort_index", "show_name", "show_date", "show_day", "show_date_pretty", "show_place", "source_url", "scraped_at")
    parsed = rows.select("show_id", F.from_json("payload", ", ".join(f"{n} string" for n in names)).alias("p"))
    return parsed.select("show_id", *[F.col(f"p.{n}").alias(n) for n in names])


def delivery_batches(spark, sf_dir):
    """The body of every show, put together from its parts of three records."""
    export, all_shows = export_table(spark, sf_dir), shows(spark, sf_dir)
    parts = L.delivery_body(export, all_shows, SCRAPED_AT, part_rows=3).repartition(L.row_tasks(export, all_shows), "show_id")
    whole = parts.groupBy("show_id").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part_no", "text"))).alias("all"))
    rows = whole.withColumn("body", F.array_join(F.transform("all", lambda p: p["text"]), ""))
    records = F.from_json("body", "records array<struct<id string, cells map<string, string>>>")["records"]
    return rows.select(
        "show_id", "parts", F.size(records).alias("records"),
        F.size(F.array_distinct(F.transform(records, lambda r: r["id"]))).alias("ids"),
        F.get(records, F.lit(0))["cells"]["company_name"].alias("first_company"),
    )


def notifications(spark, sf_dir):
    return L.notification_text(shows(spark, sf_dir), "Board").select("show_id", "subject", "body")


def export_names(spark, sf_dir):
    return shows(spark, sf_dir).select("id", X.show_file_stem("name", "event_date").alias("show_stem"), X.conference_file_stem(F.concat(F.lit(" The "), "name", F.lit("! "))).alias("conference_stem"))


def lead_dedupe(spark, sf_dir):
    leads = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 40).alias("show_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "A").otherwise("a"), (F.col("user_id") % 30).cast("string"), F.lit("@x.org ")).alias("email"),
        F.col("ts").alias("arrived_at"), F.col("event_id").alias("lead_id"), F.col("event_type").alias("job_title"),
    )
    return C.dedupe_leads(leads).select("show_id", "email_key", "lead_id", "job_title")


def status_fold(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("show_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return C.latest_status(events).select("show_id", "status", "events")


def json_leaves(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.concat(F.lit('{"Event Type":"'), "event_type", F.lit('","inner":{"User-Id":'), F.col("user_id").cast("string"), F.lit(',"list":[1,2]},"props":'), "props", F.lit("}")).alias("j")
    )
    return E.json_leaves(events, "j", "event_id")


def stall_pages(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        F.col("event_type").alias("seed_url"), F.floor(F.col("event_id") / 400).alias("directory_page"),
        F.when(F.col("event_id") % 2 == 0, (F.col("user_id") * F.when(F.col("event_id") < 3000, 1).otherwise(0)).cast("string")).alias("profile_url"),
    )
    return N.stall_cut(rows).groupBy("seed_url").agg(F.max("directory_page").alias("last_page"), F.count("*").alias("rows_kept"))


def entries_dedupe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        F.col("source").alias("seed_url"), F.floor(F.col("doc_id") / 50).alias("directory_page"), F.col("doc_id").alias("ord"),
        F.concat(F.upper("lang"), F.lit(" "), (F.length(F.coalesce("text", F.lit(""))) % 60).cast("string")).alias("company_name"), F.lit("").alias("profile_url"), F.lit("").alias("website_url_hint"),
    )
    return N.dedupe_entries(rows, ["directory_page"], ["ord"]).select("seed_url", "sort_index", "directory_page", "company_name")


def source_precedence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.concat_ws("-", "source", F.col("doc_id") % 3).alias("seed_url"), (F.length(F.coalesce("text", F.lit(""))) % 7).alias("priority"), "doc_id")
    gated = N.at_least(N.best_source(rows), ["seed_url"], rules.MIN_EMBEDDED)
    return gated.select("seed_url", "priority", "doc_id")


def page_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("seed_url"), (k % 30 + 1).alias("directory_page"), k.alias("ord"))
    limits = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("seed_url"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 10).cast("int").alias("start_page"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 25).cast("int").alias("end_page"), F.lit(12).alias("max_pages"),
    )
    kept, errors = N.page_range(entries, limits)
    return kept.groupBy("seed_url").agg(F.count("*").alias("n"), F.lit("").alias("error").alias("e")).withColumnRenamed("e", "error").unionByName(
        errors.select("seed_url", F.lit(0).cast("bigint").alias("n"), "error")
    )


def url_set_equality(spark, sf_dir):
    """Do the orders of a group and the order lines of a group name the same orders?"""
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 100).alias("seed_url"), (F.col("o_orderkey") % 400).alias("profile_url"))
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 100).alias("seed_url"), (F.col("l_orderkey") % 400).alias("profile_url"))
    return N.same_url_set(a, b).select("seed_url", F.col("same_set").cast("int").alias("same_set"), "n_a", "n_b")


def unseen_profiles(spark, sf_dir):
    """Order keys that no part bears."""
    k = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    seen = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    return N.unseen(k, seen, ["k"])


def export_roundtrip(spark, sf_dir):
    """Write the export of all shows as CSV folders and read it back."""
    from stallworks.session import shared_folder
    import uuid

    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("show-"), F.col("c_nationkey").cast("string")).alias("show"), F.col("c_custkey").alias("sort_index"),
        F.concat(F.lit('Co "'), "c_name", F.lit('", Inc')).alias("company_name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("https://x.example.com/").alias("website_url"),
        F.lit("Berlin, DE").alias("Location"), F.col("c_mktsegment").alias("Conference"),
    )
    X.write_export(rows, path)
    return X.read_export(spark, path).select("show", *X.COLUMNS)


QUERIES = {f.__name__: f for f in (
    schedule_upsert, schedule_summary, due_queue, due_shows, queue_asked, run_results, approve_and_sync, delete_section, transition_check,
    delivery_status, next_active, show_cards, dashboard_counts, section_positions, runs_latest, shows_with_runs, run_queue, delivery_payload,
    delivery_batches, notifications, export_names, lead_dedupe, status_fold, json_leaves, stall_pages, entries_dedupe, source_precedence,
    page_ranges, url_set_equality, unseen_profiles, export_roundtrip,
)}


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SHOWS = f"""
    sh AS (SELECT o_orderkey AS id, concat('Show ', o_custkey) AS name, CAST(o_orderdate AS DATE) AS event_date, concat('Hall ', o_custkey % 20) AS place,
        concat('https://show.example.com/', o_orderkey) AS source_url, CAST(o_orderdate AS DATE) - INTERVAL 14 DAY + INTERVAL 9 HOUR AS run_at,
        {_list(rules.SHOW_STATUSES)}[o_orderkey % 7 + 1] AS status, CASE WHEN o_custkey % 2 = 0 THEN concat('/exports/', o_orderkey) ELSE '' END AS latest_export_path,
        o_custkey % 4 * 10 AS company_count, o_custkey % 3 AS failure_count, CASE WHEN o_orderkey % 7 = 6 THEN concat('HTTP 429 for ', o_custkey) ELSE '' END AS last_error,
        {_list(rules.PROVIDER_STATUSES)}[(o_orderkey + o_custkey) % 4 + 1] AS notification_status, {_list(rules.PROVIDER_STATUSES)}[o_custkey % 4 + 1] AS clay_status,
        {_list(rules.PROVIDER_STATUSES)}[o_orderkey // 7 % 4 + 1] AS heyreach_status, {_list(rules.PROVIDER_STATUSES)}[o_orderkey // 28 % 4 + 1] AS smartlead_status,
        CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS created_at FROM orders)"""
_RUNS = f"""
    ru AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS show_id, {_list(rules.RUN_STATUSES)}[(l_orderkey * 10 + l_linenumber) % 4 + 1] AS status,
        CAST(sum(l_quantity) AS INT) AS company_count, CAST(min(l_shipdate) AS DATE) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_SCHEDULE = """
    sc AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('New ', o_orderkey) END AS show_, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
        concat('https://show.example.com/', o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 2 END) AS link FROM orders),
    inc AS (SELECT link, d, arg_max(show_, row_no) AS show_ FROM sc WHERE show_ <> '' AND d IS NOT NULL GROUP BY link, d)"""
_ACTIVE = f"(status = 'waiting' AND run_at <= TIMESTAMP '{NOW}') OR status IN ('queued', 'scraping', 'failed')"
_FLOW = {row[0]: row for row in B.FLOW}


def _flow_case(position):
    cases = " ".join(f"WHEN '{state}' THEN '{row[position]}'" for state, row in _FLOW.items())
    return f"CASE CASE WHEN status = 'waiting' AND run_at <= TIMESTAMP '{NOW}' THEN 'waiting_due' ELSE status END {cases} ELSE '{B.OTHER[position - 1]}' END"


_ORD = "concat(day(event_date), CASE WHEN day(event_date) BETWEEN 10 AND 20 THEN 'th' WHEN day(event_date) % 10 = 1 THEN 'st' WHEN day(event_date) % 10 = 2 THEN 'nd' WHEN day(event_date) % 10 = 3 THEN 'rd' ELSE 'th' END)"
_ERR = "CASE WHEN last_error = '' THEN '' ELSE 'Clay throttled the upload after the scrape finished. Retry later to resend the export.' END"
_DETAILS = """concat_ws(' ', CASE clay_status WHEN 'failed' THEN 'The export finished, but Clay throttled or rejected the row push.' WHEN 'success' THEN 'Rows were sent to Clay.' END,
    CASE notification_status WHEN 'failed' THEN 'The export is ready, but the Outlook notification email did not send.' END)"""
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in rules.TRANSITIONS)

ORACLES = {
    "schedule_upsert": f"""
        WITH {_SHOWS}, {_SCHEDULE}, kn AS (SELECT * FROM sh)
        SELECT coalesce(source_url, link) AS source_url, strftime(coalesce(event_date, d), '%Y-%m-%d') AS event_date, coalesce(show_, name) AS name,
            CASE WHEN show_ IS NOT NULL THEN 'Berlin' ELSE place END AS place, coalesce(status, 'waiting') AS status,
            strftime(coalesce(event_date, d) - INTERVAL 14 DAY, '%Y-%m-%d 09:00:00') AS run_at,
            CASE WHEN id IS NULL THEN '{NOW}' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at,
            CASE WHEN show_ IS NOT NULL THEN '{NOW}' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
        FROM kn FULL JOIN inc ON source_url = link AND event_date = d""",
    "schedule_summary": f"""
        WITH {_SHOWS}, {_SCHEDULE}, kn AS (SELECT source_url, event_date FROM sh)
        SELECT (SELECT count(*) FROM inc LEFT JOIN kn ON source_url = link AND event_date = d WHERE source_url IS NULL) AS created,
               (SELECT count(*) FROM inc JOIN kn ON source_url = link AND event_date = d) AS updated,
               (SELECT count(*) FROM sc WHERE show_ = '') AS skipped, (SELECT count(*) FROM sc WHERE show_ <> '' AND d IS NULL) AS bad_dates""",
    "due_queue": f"""
        WITH {_SHOWS}, {_RUNS}, s2 AS (SELECT CASE WHEN status = 'waiting' AND run_at <= TIMESTAMP '{NOW}' THEN 'queued' ELSE status END AS status FROM sh)
        SELECT 'show' AS kind, status, count(*) AS n FROM s2 GROUP BY status
        UNION ALL SELECT 'run', status, count(*) FROM (SELECT status FROM ru UNION ALL SELECT 'queued' FROM sh WHERE status = 'waiting' AND run_at <= TIMESTAMP '{NOW}') GROUP BY status""",
    "due_shows": f"WITH {_SHOWS} SELECT id, strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at FROM sh WHERE status = 'waiting' AND run_at <= TIMESTAMP '{NOW}'",
    "queue_asked": f"""
        WITH {_SHOWS}, a AS (SELECT sh.*, c_custkey IS NOT NULL AND status NOT IN ('queued', 'scraping') AS hit FROM sh LEFT JOIN customer ON id = c_custkey)
        SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit THEN '{NOW}' ELSE strftime(run_at, '%Y-%m-%d %H:%M:%S') END AS run_at,
            CASE WHEN hit THEN 0 ELSE failure_count END AS failure_count, CASE WHEN hit THEN '' ELSE last_error END AS last_error,
            CASE WHEN hit THEN 'pending' ELSE clay_status END AS clay_status, CAST(hit AS INT) AS new_runs FROM a""",
    "run_results": f"""
        WITH {_SHOWS}, {_RUNS}, q AS (SELECT show_id, max(struct_pack(c := created_at, id := id, n := company_count)) AS r FROM ru WHERE status IN ('queued', 'running') GROUP BY show_id),
        j AS (SELECT sh.*, r.id AS rid, r.n AS n, r.id % 5 = 0 AS bad, r.id % 3 = 0 AS cl FROM sh LEFT JOIN q ON sh.id = show_id)
        SELECT id, CASE WHEN rid IS NULL THEN status WHEN bad THEN 'failed' ELSE 'ready_for_review' END AS status,
            CASE WHEN NOT bad THEN concat('/out/', rid) ELSE latest_export_path END AS latest_export_path, CASE WHEN NOT bad THEN n ELSE company_count END AS company_count,
            CASE WHEN NOT bad THEN 2 ELSE failure_count END AS failure_count,
            CASE WHEN rid IS NULL THEN last_error WHEN bad THEN concat('failed run ', rid) WHEN cl THEN 'Clay said no' ELSE '' END AS last_error,
            CASE WHEN NOT bad THEN CASE WHEN cl THEN 'failed' ELSE 'success' END ELSE clay_status END AS clay_status,
            CASE WHEN NOT bad THEN 'pending' ELSE heyreach_status END AS heyreach_status, CASE WHEN NOT bad THEN 'skipped' ELSE notification_status END AS notification_status FROM j""",
    "approve_and_sync": f"""
        WITH {_SHOWS}, a AS (SELECT *, status = 'ready_for_review' AND company_count > 0 AS ap FROM sh),
        b AS (SELECT *, ap OR (status = 'approved' AND (heyreach_status = 'pending' OR smartlead_status = 'pending')) AS op FROM a)
        SELECT id, CASE WHEN op AND id % 2 = 0 AND id % 5 <> 0 THEN 'live' WHEN ap THEN 'approved' ELSE status END AS status,
            CASE WHEN op THEN CASE WHEN id % 2 = 0 THEN 'success' ELSE 'failed' END ELSE clay_status END AS clay_status,
            CASE WHEN op THEN 'success' ELSE heyreach_status END AS heyreach_status,
            CASE WHEN op THEN CASE WHEN id % 5 = 0 THEN 'skipped' ELSE 'success' END ELSE smartlead_status END AS smartlead_status, CAST(ap AS INT) AS stamped FROM b""",
    "delete_section": f"""
        WITH {_SHOWS}, {_RUNS}, k AS (SELECT id, status FROM sh WHERE NOT ({_ACTIVE})),
        r AS (SELECT k.status, count(*) AS n FROM ru JOIN k ON show_id = k.id GROUP BY k.status)
        SELECT status, count(*) AS shows, coalesce(any_value(n), 0) AS runs FROM k LEFT JOIN r USING (status) GROUP BY status""",
    "transition_check": f"""
        WITH {_SHOWS}, t(a, b) AS (VALUES {_ALLOWED}), e AS (SELECT event_id, user_id, {_list([*rules.SHOW_STATUSES, "sold"])}[event_id % 8 + 1] AS new_status FROM events)
        SELECT event_id, new_status, CAST(t.a IS NOT NULL AS INT) AS allowed FROM e LEFT JOIN sh ON user_id = id LEFT JOIN t ON status = a AND new_status = b""",
    "delivery_status": f"""
        WITH {_SHOWS}, e AS (SELECT user_id, event_id, event_type = 'error' AND user_id % 2 = 0 AS bad FROM events),
        f AS (SELECT user_id, min(event_id) FILTER (bad) AS b FROM e GROUP BY user_id),
        g AS (SELECT e.user_id, count(*) FILTER (b IS NULL OR event_id < b) AS sent, any_value(b) AS b FROM e JOIN f USING (user_id) GROUP BY e.user_id)
        SELECT id AS show_id, CASE WHEN sent IS NULL THEN 'skipped' WHEN b IS NULL THEN 'success' ELSE 'failed' END AS status, coalesce(sent, 0) AS sent,
            CASE WHEN sent IS NULL THEN 'No Clay integration method is configured.' WHEN b IS NULL THEN concat('Sent ', sent, ' row(s) from the scraper export to Clay via webhook.')
                 ELSE 'Clay webhook returned non-success status 500.' END AS message FROM sh LEFT JOIN g ON id = user_id""",
    "next_active": f"""WITH {_SHOWS} (SELECT id, 'free' AS state FROM sh WHERE status IN ('ready_for_review', 'approved') ORDER BY event_date, id LIMIT 1)
        UNION ALL (SELECT id, 'busy' FROM sh WHERE status IN ('ready_for_review', 'approved') AND NOT EXISTS (SELECT 1 FROM sh WHERE status = 'live') ORDER BY event_date, id LIMIT 1)""",
    "show_cards": f"""
        WITH {_SHOWS}, t AS (SELECT *, date_diff('second', TIMESTAMP '{NOW}', run_at) AS s FROM sh), u AS (SELECT *, abs(s) // 3600 // 24 AS dd, abs(s) // 3600 AS hh FROM t)
        SELECT id, {_flow_case(1)} AS section, {_flow_case(2)} AS step_label, {_flow_case(3)} AS next_action,
            CASE WHEN status = 'failed' THEN 'danger' WHEN company_count > 0 THEN CASE WHEN clay_status = 'failed' OR notification_status = 'failed' THEN 'warning' ELSE 'success' END END AS notice_tone,
            CASE WHEN status = 'failed' THEN 'Scrape needs attention' WHEN company_count > 0 THEN CASE WHEN clay_status = 'failed' THEN 'Clay upload needs retry'
                WHEN notification_status = 'failed' THEN 'Email notification needs retry' ELSE 'Scrape completed' END END AS notice_title,
            CASE WHEN status = 'failed' THEN coalesce(nullif({_ERR}, ''), 'The latest scrape attempt failed.') WHEN company_count > 0 THEN
                coalesce(nullif({_DETAILS}, ''), concat(company_count, ' companies were exported and are ready for review.')) END AS notice_detail,
            {_ERR} AS error_summary,
            concat(CASE WHEN s <= 0 THEN CASE WHEN dd > 0 THEN concat('Should have queued ', dd, ' day(s) ago') WHEN hh > 0 THEN concat('Should have queued ', hh, ' hour(s) ago') ELSE 'Should queue now' END
                WHEN dd > 0 THEN concat('Queues in ', dd, ' day(s)') WHEN hh > 0 THEN concat('Queues in ', hh, ' hour(s)') ELSE 'Queues in under an hour' END,
                ' · scheduled for ', strftime(run_at, '%b %d, %Y at %-I:%M %p')) AS run_timing,
            CASE WHEN clay_status = 'success' THEN 'Clay received the export.' WHEN clay_status = 'failed' THEN 'Clay push needs a retry.'
                 WHEN company_count > 0 THEN 'Clay has not received this export yet.' ELSE 'Clay has nothing to send yet.' END AS provider_summary, replace(status, '_', ' ') AS status_label FROM u""",
    "dashboard_counts": f"""
        WITH {_SHOWS}, b AS (SELECT CASE WHEN {_ACTIVE} THEN 'active' WHEN status = 'waiting' THEN 'scheduled_later' ELSE 'completed' END AS board, status, company_count FROM sh)
        SELECT coalesce(board, 'all') AS board, count(*) AS shows, count(*) FILTER (status = 'ready_for_review') AS ready, count(*) FILTER (company_count > 0) AS completed, CAST(sum(company_count) AS BIGINT) AS leads
        FROM b GROUP BY ROLLUP (board)""",
    "section_positions": f"""
        WITH {_SHOWS}, c AS (SELECT *, {_flow_case(1)} AS section FROM sh)
        SELECT id, section FROM c ORDER BY section, CASE WHEN section = 'completed' THEN event_date END NULLS FIRST, run_at, event_date, id""",
    "runs_latest": f"""
        WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY created_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY show_id) AS c FROM ru)
        SELECT show_id, c AS run_count, id AS run_id, status AS run_status, strftime(created_at, '%Y-%m-%d 00:00:00') AS run_created_at FROM r WHERE n = 1""",
    "shows_with_runs": f"""WITH {_SHOWS}, {_RUNS} SELECT sh.id, name, coalesce(ru.id, -1) AS run_id, ru.status AS run_status, coalesce(ru.company_count, -1) AS run_company_count FROM sh LEFT JOIN ru ON sh.id = show_id""",
    "run_queue": f"""WITH {_RUNS}, q AS (SELECT id, show_id, row_number() OVER (ORDER BY created_at, id) AS n FROM ru WHERE status = 'queued') SELECT id, show_id, CAST(n = 1 AS INT) AS is_next FROM q""",
    "delivery_payload": f"""
        WITH {_SHOWS} SELECT CAST(id AS VARCHAR) AS show_id, concat('Company ', l_partkey) AS company_name, concat('https://c', l_suppkey, '.example.com/') AS website_url,
            CAST(l_partkey * 100 + l_suppkey AS VARCHAR) AS sort_index, name AS show_name, strftime(event_date, '%Y-%m-%d') AS show_date, concat(strftime(event_date, '%B '), {_ORD}) AS show_day,
            concat(strftime(event_date, '%B '), {_ORD}, ', ', year(event_date)) AS show_date_pretty, place AS show_place, source_url, '{SCRAPED_AT}' AS scraped_at FROM lineitem JOIN sh ON l_orderkey = id""",
    "delivery_batches": f"""
        WITH e AS (SELECT l_orderkey AS id, l_partkey * 100 + l_suppkey AS s, concat('Company ', l_partkey) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT CAST(id AS VARCHAR) AS show_id, (count(*) + 2) // 3 AS parts, count(*) AS records, count(DISTINCT s) AS ids, arg_min(c, s) AS first_company FROM e GROUP BY id""",
    "notifications": f"""
        WITH {_SHOWS} SELECT id AS show_id, concat('[Board] ', name, ' is ready for review') AS subject,
            concat('Show: ', name, chr(10), 'Date: ', strftime(event_date, '%Y-%m-%d'), chr(10), 'Place: ', place, chr(10), 'Source URL: ', source_url, chr(10), 'Rows exported: ', company_count, chr(10),
                'Profile failures: ', failure_count, chr(10), 'Export path: ', coalesce(nullif(latest_export_path, ''), 'not available'), chr(10), chr(10),
                'The show has finished scraping and is ready for review in the dashboard.') AS body FROM sh WHERE status = 'ready_for_review'""",
    "export_names": f"""WITH {_SHOWS} SELECT id, concat(replace(lower(name), ' ', '-'), '_', strftime(event_date, '%Y-%m-%d')) AS show_stem, concat('the_', replace(lower(name), ' ', '_')) AS conference_stem FROM sh""",
    "lead_dedupe": """
        WITH l AS (SELECT user_id % 40 AS show_id, concat('a', user_id % 30, '@x.org') AS email_key, ts, event_id, event_type,
            row_number() OVER (PARTITION BY user_id % 40, user_id % 30 ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT show_id, email_key, event_id AS lead_id, event_type AS job_title FROM l WHERE n = 1""",
    "status_fold": "SELECT user_id AS show_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, count(*) AS events FROM events GROUP BY user_id",
    "json_leaves": """
        SELECT event_id, 'eventtype' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'inner.userid', CAST(user_id AS VARCHAR) FROM events
        UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k') FROM events""",
    "stall_pages": """
        WITH r AS (SELECT event_type AS s, event_id // 400 AS p, CASE WHEN event_id % 2 = 0 THEN CAST(user_id * CASE WHEN event_id < 3000 THEN 1 ELSE 0 END AS VARCHAR) END AS u FROM events),
        f AS (SELECT s, u, min(p) AS p FROM r WHERE u IS NOT NULL GROUP BY s, u), n AS (SELECT s, p, count(*) AS n FROM f GROUP BY s, p),
        g AS (SELECT s, p, coalesce(n, 0) AS n FROM (SELECT DISTINCT s, p FROM r) LEFT JOIN n USING (s, p)),
        h AS (SELECT s, p, n = 0 AND lag(n) OVER (PARTITION BY s ORDER BY p) = 0 AS st FROM g), c AS (SELECT s, min(p) FILTER (st) AS cut FROM h GROUP BY s)
        SELECT s AS seed_url, max(p) AS last_page, count(*) AS rows_kept FROM r JOIN c USING (s) WHERE cut IS NULL OR p <= cut GROUP BY s""",
    "entries_dedupe": """
        WITH d AS (SELECT source AS s, doc_id, concat(upper(lang), ' ', length(coalesce(text, '')) % 60) AS c, row_number() OVER (PARTITION BY source, lower(concat(lang, ' ', length(coalesce(text, '')) % 60)) ORDER BY doc_id) AS n FROM documents)
        SELECT s AS seed_url, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS sort_index, doc_id // 50 AS directory_page, c AS company_name FROM d WHERE n = 1""",
    "source_precedence": """
        WITH r AS (SELECT concat(source, '-', doc_id % 3) AS s, length(coalesce(text, '')) % 7 AS p, doc_id, min(length(coalesce(text, '')) % 7) OVER (PARTITION BY source, doc_id % 3) AS m FROM documents),
        k AS (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM r WHERE p = m) SELECT s AS seed_url, p AS priority, doc_id FROM k WHERE c >= 3""",
    "page_ranges": """
        WITH l AS (SELECT c_custkey AS s, greatest(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END, 1), 1) AS a, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 25 END AS e FROM customer),
        r AS (SELECT s, a, least(coalesce(e, a + 11), a + 11) AS b FROM l)
        SELECT o_custkey AS seed_url, count(*) AS n, '' AS error FROM orders LEFT JOIN r ON s = o_custkey WHERE s IS NULL OR o_orderkey % 30 + 1 BETWEEN a AND b GROUP BY o_custkey
        UNION ALL SELECT s, 0, 'start page is greater than end page' FROM r WHERE a > b""",
    "url_set_equality": """
        WITH o AS (SELECT DISTINCT o_custkey % 100 AS s, o_orderkey % 400 AS u FROM orders), l AS (SELECT DISTINCT l_suppkey % 100 AS s, l_orderkey % 400 AS u FROM lineitem)
        SELECT s AS seed_url, CAST(count(*) FILTER (o.u IS NULL OR l.u IS NULL) = 0 AS INT) AS same_set, count(o.u) AS n_a, count(l.u) AS n_b FROM o FULL JOIN l USING (s, u) GROUP BY s""",
    "unseen_profiles": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)",
    "export_roundtrip": """
        SELECT concat('show-', c_nationkey) AS show, concat('Co "', c_name, '", Inc') AS company_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://x.example.com/' END AS website_url,
            'Berlin, DE' AS Location, c_mktsegment AS Conference FROM customer""",
}
