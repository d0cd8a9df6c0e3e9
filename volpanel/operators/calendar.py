"""Session calendar as a dimension table: ordinals, offsets, next sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions.num import add


def session_calendar(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct sessions (of each key) with their ordinal and neighbours.

    One row per trading day (about 250 a year), so the ordering window over the
    whole calendar is bounded by time, not by data volume.
    """
    days = sessions.select(*keys, "session_date").distinct()
    over = (f"PARTITION BY {', '.join(keys)} " if keys else "") + "ORDER BY session_date"
    return add(
        days,
        {
            "ordinal": f"row_number() OVER ({over}) - 1L",
            "previous_session": f"lag(session_date) OVER ({over})",
            "next_session": f"lead(session_date) OVER ({over})",
        },
    )


def at_offset(df: DataFrame, calendar: DataFrame, ordinal: str, out: str) -> DataFrame:
    """Session at an ordinal expression, NULL outside the calendar (equi-join)."""
    target = calendar.selectExpr("ordinal AS _target", f"session_date AS {out}")
    return add(df, {"_target": f"bigint({ordinal})"}).join(target, "_target", "left").drop("_target")


def decision_time(df: DataFrame, calendar: DataFrame, out: str = "decision_as_of", clock: str = "09:00:00") -> DataFrame:
    """Opening time of the session after each row's session."""
    nxt = calendar.selectExpr("session_date", f"to_timestamp_ntz(concat(next_session, ' {clock}')) AS {out}")
    return df.join(nxt, "session_date", "left")


def first_session_from(calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For every calendar day (of each key), the first session on or after it.

    Each session owns the days since the previous one, so a forward as-of
    lookup becomes an equi-join on the day. Days before the calendar have no row.
    """
    start = "coalesce(date_add(previous_session, 1), session_date)"
    return calendar.selectExpr(
        *keys, f"explode(sequence({start}, session_date)) AS day", "session_date AS first_session", "ordinal AS first_ordinal"
    )


def listing_age(df: DataFrame, calendar: DataFrame, listing: str, out: str = "listing_age_sessions") -> DataFrame:
    """Sessions since listing, counting the listing session as 1; NULL before it.

    A listing before the calendar, however long, counts from its first session.
    """
    own = calendar.selectExpr("session_date", "ordinal AS _own")
    launch = first_session_from(calendar).selectExpr(f"day AS {listing}", "first_ordinal AS _launch")
    joined = df.join(own, "session_date", "left").join(launch, listing, "left")
    return add(joined, {out: f"CASE WHEN session_date >= {listing} THEN _own - coalesce(_launch, 0) + 1 END"}).drop("_own", "_launch")


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("session_year", F.year("session_date"))
