"""Date and time expressions.  ``today`` and ``now`` are always parameters, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallworks import rules
from stallworks.functions.binding import let
from stallworks.functions.text import normalize_text


def _read(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def parse_show_date(text: Column | str, today: Column) -> Column:
    """Date of a schedule row; NULL where the text follows none of the known forms.

    Two-digit years from 69 on belong to the last century.  A date without year
    is this year's, or next year's when that lies more than 30 days back.
    """

    def parsed(value: Column) -> Column:
        dated = []
        for fmt in rules.DATED_FORMATS:
            date = _read(value, fmt)
            if fmt.endswith("/yy"):
                date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)
            dated.append(date)
        return F.coalesce(*dated, F.when(value.rlike(r"^\p{L}+ \d"), yearless(value)))

    def yearless(value: Column) -> Column:
        def in_year(year: Column) -> Column:
            dated = F.concat_ws(" ", value, year.cast("string"))
            return F.coalesce(*[_read(dated, f"{fmt} yyyy") for fmt in rules.YEARLESS_FORMATS])

        this_year = in_year(F.year(today))
        oldest = F.date_sub(today, rules.YEARLESS_GRACE_DAYS)
        return F.when(this_year < oldest, in_year(F.year(today) + 1)).otherwise(this_year)

    return let(normalize_text(text), parsed)


def run_at(event_date: Column | str, offset_days: Column) -> Column:
    """Trigger time: that many days before the event, at nine."""
    day = F.date_sub(event_date, offset_days)
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(rules.RUN_HOUR))


def ordinal_day(day: Column) -> Column:
    suffix = (
        F.when((day % 100).between(10, 20), "th")
        .when(day % 10 == 1, "st")
        .when(day % 10 == 2, "nd")
        .when(day % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(day.cast("string"), suffix)


def pretty_day(date: Column | str) -> Column:
    return F.concat(F.date_format(date, "MMMM "), ordinal_day(F.dayofmonth(date)))


def is_due(run_at_: Column | str, now: Column) -> Column:
    return F.col(run_at_) <= now if isinstance(run_at_, str) else run_at_ <= now


def run_timing_label(run_at_: Column, now: Column) -> Column:
    """How far a trigger time is from now, in whole days, else hours."""
    seconds = F.timestamp_diff("SECOND", now, run_at_)
    hours = F.floor(F.abs(seconds) / 3600)
    days = F.floor(hours / 24)
    when = F.concat(F.lit(" · scheduled for "), F.date_format(run_at_, "MMM dd, yyyy 'at' h:mm a"))
    past = seconds <= 0
    text = (
        F.when(past & (days > 0), F.concat(F.lit("Should have queued "), days.cast("string"), F.lit(" day(s) ago")))
        .when(past & (hours > 0), F.concat(F.lit("Should have queued "), hours.cast("string"), F.lit(" hour(s) ago")))
        .when(past, F.lit("Should queue now"))
        .when(days > 0, F.concat(F.lit("Queues in "), days.cast("string"), F.lit(" day(s)")))
        .when(hours > 0, F.concat(F.lit("Queues in "), hours.cast("string"), F.lit(" hour(s)")))
        .otherwise(F.lit("Queues in under an hour"))
    )
    return F.coalesce(F.concat(text, when), F.lit("No run time set"))
