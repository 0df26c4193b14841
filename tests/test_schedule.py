"""Schedule import, state steps and streams."""

import pytest
from pyspark.sql import functions as F

from stallworks.operators import campaign as C, dashboard as B
from stallworks.sources import schedule as S

NOW = "2026-06-01 12:00:00"


def schedule_file(tmp_path, text):
    path = tmp_path / "shows.csv"
    path.write_bytes(text.encode("utf-8-sig"))
    return str(path)


def no_shows(spark):
    return spark.createDataFrame([], S.SHOWS), spark.createDataFrame([], S.RUNS)


def test_import(spark, tmp_path):
    path = schedule_file(tmp_path, 'Conference, Start Date ,Location,URL\nBoat Expo,"Oct 24, 2026",Reno,https://a.org\nBoat Expo 2,10/24/2026,"Reno, NV",https://a.org\n,2026-01-01,X,https://b.org\nBad,someday,X,https://c.org\n')
    rows = S.read_schedule(spark, path)
    parsed = S.parsed_schedule(rows, "2026-06-01")
    shows, _ = no_shows(spark)
    assert C.import_summary(rows, parsed, shows).first().asDict() == {"created": 1, "updated": 0, "skipped": 1, "bad_dates": 1}
    first = C.upsert_shows(shows, parsed, NOW)
    row = first.first()
    assert (row.name, row.place, str(row.event_date), str(row.run_at), row.status) == ("Boat Expo 2", "Reno, NV", "2026-10-24", "2026-10-10 09:00:00", "waiting")
    # importing again changes nothing but the update time
    again = C.upsert_shows(first, parsed, "2026-06-02 00:00:00")
    assert again.count() == 1 and again.first().id == row.id and again.first().created_at == row.created_at
    with pytest.raises(Exception, match="Unsupported date format"):
        C.upsert_shows(shows, parsed, NOW, strict=True).collect()


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="place, link"):
        S.read_schedule(spark, schedule_file(tmp_path, "Show,Date\nA,2026-01-01\n"))


def some_shows(spark, tmp_path):
    lines = "".join(f"Show {i},2026-{6 + i % 3:02d}-1{i % 5},P,https://s{i}.org\n" for i in range(10))
    rows = S.read_schedule(spark, schedule_file(tmp_path, "Show,Date,Place,Link\n" + lines))
    shows, runs = no_shows(spark)
    return C.upsert_shows(shows, S.parsed_schedule(rows, "2026-06-01"), "2026-05-01 00:00:00"), runs


def test_life_of_a_show(spark, tmp_path):
    shows, runs = some_shows(spark, tmp_path)
    shows, runs = C.queue_due(shows, runs, NOW)
    queued = shows.filter("status = 'queued'").count()
    assert queued > 0 and runs.count() == queued
    shows, runs = C.start_runs(shows, runs, NOW)
    assert shows.filter("status = 'scraping'").count() == queued
    results = runs.select(F.col("id").alias("run_id"), F.lit(None).cast("string").alias("error"), F.lit("/x").alias("output_path"), F.lit(5).alias("company_count"),
                          F.lit(0).alias("failure_count"), F.lit("skipped").alias("clay_status"), F.lit("").alias("clay_message"), F.lit("skipped").alias("notification_status"))
    shows, runs = C.apply_run_results(shows, runs, results, NOW)
    assert shows.filter("status = 'ready_for_review' AND company_count = 5").count() == queued
    shows = C.approve(shows, shows.filter("status = 'ready_for_review'").select("id"), NOW)
    good = shows.select(F.col("id").alias("show_id"), *[F.lit("success").alias(c) for c in ("clay", "heyreach", "smartlead")])
    shows = C.sync_approved(shows, good, NOW)
    assert shows.filter("status = 'live'").count() == queued
    left, left_runs = C.delete_shows(shows, runs, B.ids_in_section(shows, "completed", NOW))
    assert left.count() == 10 - queued and left_runs.count() == 0
