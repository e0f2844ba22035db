"""Hour keys, recency cutoffs and display dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# The zone of the hourly feed, and the texts shown when there is none.
FEED_ZONE = "Asia/Kolkata"
NO_TITLE = "Untitled Article"
NO_SUMMARY = "No summary available for this article."


def hour_key(ts: Column, zone: str = FEED_ZONE) -> Column:
    """``yyyy/MM/dd/HH`` of an instant in the feed's own zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy/MM/dd/HH")


def hourly_path(ts: Column, zone: str = FEED_ZONE) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.concat(
        F.date_format(local, "yyyy/MM/dd"), F.lit("/et_"), F.date_format(local, "HH"), F.lit(".json")
    )


def recency_cutoff(as_of_ms: Column, days: Column) -> Column:
    """Oldest millisecond still allowed; null when the filter is off."""
    return F.when(days != 0, as_of_ms - days.cast("bigint") * DAY_MS)


def display_date(timestamp: Column, unix_ms: Column, published: Column) -> Column:
    """Date of the millisecond stamp, else the date part of the published text."""
    def present(c: Column) -> Column:
        return F.when(c != 0, c)

    ms = F.coalesce(present(timestamp), present(unix_ms))
    from_stamp = F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")
    from_text = F.when(published != "", F.split(published, " ")[0])
    return F.coalesce(from_stamp, from_text)


def feed_title(title: Column, full_title: Column) -> Column:
    return _first_text(title, full_title, F.lit(NO_TITLE))


def feed_summary(summary: Column, full_intro: Column) -> Column:
    return _first_text(summary, full_intro, F.lit(NO_SUMMARY))


def _first_text(*options: Column) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options])
