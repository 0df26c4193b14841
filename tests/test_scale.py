"""Work is dealt out by rows, and a commit shuffles only what it changes."""

import re

from pyspark.sql import functions as F

from stallworks import session
from stallworks.operators import crawl, listing
from stallworks.plans import directory
from stallworks.sinks import payloads
from stallworks.sources import signals as G
from stallworks.streaming import status
from stallworks.streaming.store import Change, Layout, StateStore
from workloads import campaigns, shared


def test_spread_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 10)
    assert shared.spread(spark, spark.range(1000)).rdd.getNumPartitions() == 100


def test_derived_pages_are_dealt_out(spark, tmp_path):
    spark.range(64).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    pages = shared.derived_pages(spark, str(tmp_path), "scale", "concat('https://a/', c_custkey)", "'<p>'")
    assert pages.count() == 64
    assert pages.select(F.input_file_name()).distinct().count() > 1


def test_commit_keeps_the_rest_in_its_buckets(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path), {"t": Layout("k bigint, v string", "k", "k")})
    store.create(t=spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    plans, write = [], store._write

    def watched(name, rows, folder):
        dealt = rows.withColumn("slot", store.slot("k")).repartition(store.buckets, "k")
        plans.append(dealt._jdf.queryExecution().executedPlan().toString())
        return write(name, rows, folder)

    monkeypatch.setattr(store, "_write", watched)
    store.commit("w", 0, lambda now: {"t": Change(spark.range(50).select(F.col("id").alias("k"), F.lit("b").alias("v")))})
    # one exchange for the keys of the changed rows, one for the rows themselves, none above the union
    assert plans[0].count("Exchange") == 2 and "BroadcastExchange" not in plans[0]
    rows = store.read().tables["t"].groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in rows} == {"a": 950, "b": 50}


def test_state_starts_with_the_first_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.PROVIDER)
    schema = "show_id long, event_id long, ts timestamp, new_status string"
    spark.sql("SELECT 1L show_id, 1L event_id, timestamp'2020-01-01' ts, 'b' new_status UNION ALL SELECT NULL, 2L, timestamp'2020-01-01', 'b'").write.parquet(f"{tmp_path}/in")
    initial = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "c")], "show_id long, status string")
    moved = status.moves(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), initial, [("a", "b")])
    query = moved.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(
        lambda rows, n: rows.write.mode("append").parquet(f"{tmp_path}/out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[0].stateOperators[0].numRowsTotal <= 2  # shows without events have no state
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.show_id, r.status, r.allowed) for r in rows} == {(1, "b", True), (None, "c", False)}


def test_containers_are_cut_once(spark, monkeypatch):
    calls, cut = [], listing.cut_lineage
    monkeypatch.setattr(listing, "cut_lineage", lambda rows: calls.append(rows.columns) or cut(rows))
    from stallworks.sources import signals as G
    pages = spark.createDataFrame([("https://a.example.com/x", "<p>x</p>")], "url string, html string")
    listing.listing_candidates(G.page_signals(pages).withColumn("seed_url", F.col("url")))
    assert len(calls) == 1 and "actions" in calls[0]


def test_body_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(7).alias("o_custkey"), F.lit("2026-01-01").cast("date").alias("o_orderdate"))
    lines = spark.range(260).select(F.greatest(F.col("id") - 220, F.lit(0)).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1).alias("l_suppkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(payloads, "TASK_ROWS", 10, raising=False)
    bodies = campaigns.delivery_batches(spark, str(tmp_path))
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) == {"30"}  # 300 rows, ten in a task, whatever the session sets
    assert "BroadcastExchange" not in plan  # more shows than one task takes
    got = {r.show_id: (r.parts, r.records, r.ids, r.first_company) for r in bodies.collect()}
    assert got == {str(k): (74, 221, 221, "Company 0") if k == 0 else (1, 1, 1, f"Company {k + 220}") for k in range(40)}


def test_a_crowded_body_lies_in_several_tasks(spark, monkeypatch):
    export = spark.createDataFrame([(1, i, "Co") for i in range(200)], "show_id long, sort_index long, company_name string")
    shows = spark.createDataFrame([(1, "A")], "id long, name string").select("id", "name", F.lit("2026-01-01").cast("date").alias("event_date"), F.lit("P").alias("place"), F.lit("u").alias("source_url"))
    whole = {(r.part_no, r.text) for r in payloads.delivery_body(export, shows, "now", part_rows=4).collect()}
    monkeypatch.setattr(payloads, "TASK_ROWS", 20, raising=False)
    parts = payloads.delivery_body(export, shows, "now", part_rows=4).select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in parts}) > 1
    assert len(whole) == 50 and {(r.part_no, r.text) for r in parts} == whole


def test_circles_do_not_wait_for_all_pages(spark, monkeypatch):
    chains = spark.range(2000).select(F.concat(F.lit("https://p"), F.col("id").cast("string"), F.lit(".org/")).alias("url"), F.lit(False).alias("is_platform"),
                                      F.lit(None).cast("string").alias("frame_url"), F.concat(F.lit("https://p"), (F.col("id") + F.when(F.col("id") < 3, F.when(F.col("id") == 2, -2).otherwise(1)).when(F.col("id") % 2 == 0, 1)).cast("string"), F.lit(".org/")).alias("link_url"))
    hops = session.cut_lineage(chains)
    calls = []
    monkeypatch.setattr(crawl, "cut_lineage", lambda rows: calls.append(1) or session.cut_lineage(rows))
    got = {r.seed_url: r.resolved_url for r in crawl.resolve_seeds(hops.select(F.col("url").alias("seed_url")), hops).collect()}
    page = "https://p{}.org/".format
    assert got == {page(i): page((i + 2) % 3 if i < 3 else i + 1 if i % 2 == 0 else i) for i in range(2000)}
    assert len(calls) <= 8  # not one for every doubling up to the number of pages


def test_seeds_of_one_directory_share_its_entries(spark, monkeypatch):
    cards = "".join(f'<li class="card"><a class="name" href="/list/company/{i}">{name} Works</a></li>' for i, name in enumerate(("Amber", "Cedar", "Delta", "Ember")))
    gates = [(f"https://gate{i}.org/", '<main><a href="https://expo.org/list">Exhibitors</a></main>') for i in range(12)]
    pages = session.cut_lineage(spark.createDataFrame([("https://expo.org/list", f"<main><ul>{cards}</ul></main>"), *gates], "url string, html string"))
    seeds = spark.createDataFrame([(url, None if i % 3 else 1, 0 if i == 11 else None) for i, (url, _) in enumerate(gates)], "seed_url string, start_page int, end_page int")
    ranged, page_range = [], directory.page_range
    monkeypatch.setattr(directory, "page_range", lambda entries, limits: ranged.append(entries.count()) or page_range(entries, limits))
    run = directory.directory_run(seeds, pages, session.cut_lineage(G.page_signals(pages)))
    assert ranged == [4]
    assert {r.seed_url: (r.entries, r.error) for r in run.outcomes.collect()} == {url: (4, None) if i < 11 else (0, directory.EMPTY_RANGE) for i, (url, _) in enumerate(gates)}
    found = sorted((r.seed_url, r.sort_index, r.company_name) for r in run.entries.collect())
    assert found == sorted((url, n, f"{name} Works") for url, _ in gates[:11] for n, name in enumerate(("Amber", "Cedar", "Delta", "Ember")))


def test_addresses_are_resolved_once(spark):
    pages = spark.createDataFrame([("https://a.org/", '<a href="/x">X</a>')], "url string, html string")
    links = G.anchors(session.cut_lineage(G.page_signals(pages)))
    resolved = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z0-9+.-]*")
    assert links.collect()[0].absolute_url == "https://a.org/x"
    assert resolved(links) == resolved(links.filter("absolute_url <> url").filter("length(absolute_url) > 3")) > 0


def _export(spark):
    export = spark.createDataFrame([(1, i, "Co") for i in range(200)] + [(2, i, "Co") for i in (7, 3, None, 3)] + [(3, 5, "A"), (3, 5, "B"), (4, 1, "No show"), (None, 1, "None")], "show_id long, sort_index long, company_name string")
    shows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (3, "D"), (5, "E")], "id long, name string")
    return export, shows.select("id", "name", F.lit("2026-01-01").cast("date").alias("event_date"), F.lit("P").alias("place"), F.lit("u").alias("source_url"))


def test_bodies_are_dealt_out_once(spark):
    parts = payloads.delivery_body(*_export(spark), "now", part_rows=4)
    plan = parts.groupBy("show_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the export and, at most, the shows


def test_crowded_and_other_shows_have_the_same_parts(spark, monkeypatch):
    export, shows = _export(spark)
    whole = sorted((r.show_id, r.part_no, r.text) for r in payloads.delivery_body(export, shows, "now", part_rows=4).collect())
    monkeypatch.setattr(payloads, "TASK_ROWS", 20)
    assert payloads.crowded_shows(export) == ["1"]
    assert sorted((r.show_id, r.part_no, r.text) for r in payloads.delivery_body(export, shows, "now", part_rows=4).collect()) == whole
    monkeypatch.setattr(payloads, "crowded_shows", lambda export: ["1", "2", "3", "4"])
    assert sorted((r.show_id, r.part_no, r.text) for r in payloads.delivery_body(export, shows, "now", part_rows=4).collect()) == whole
