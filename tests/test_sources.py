"""Source rules: the bar at the decision time, opening anchors, table fingerprints, the universe guard."""

import datetime as dt

import pytest

from volpanel.operators import quality as Q
from volpanel.sources import scans, sinks
from volpanel.sources.views import SPARK, VIEWS, view

DAY = dt.date(2024, 3, 5)


def bars(spark, rows):
    full = [("x", DAY, dt.datetime.combine(DAY, dt.time.fromisoformat(c)), c, p, p + 1, p - 1, v, int(p * v)) for c, p, v in rows]
    return spark.createDataFrame(full, "code string, session_date date, bar_time timestamp_ntz, clock string, close double, high double, low double, vol long, amount long")


def test_mark_ignores_bars_after_the_decision(spark):
    daily = spark.createDataFrame([("x", DAY, 1.5)], "code string, session_date date, adj_factor double")
    row = scans.underlying_marks(bars(spark, [("14:55:00", 3.0, 1), ("14:56:00", 1.0, 1), ("15:00:00", 2.0, 1)]), daily).head()
    assert (row.etf_mark, row.tr_mark) == (1.0, 1.5)


def test_anchors_use_the_opening_minutes_only(spark):
    rows = [("09:34:00", 9.0, 5), ("09:35:00", 10.0, 5), ("09:36:00", 20.0, 1), ("09:45:00", 40.0, 3), ("09:46:00", 99.0, 9)]
    row = scans.opening_anchors(bars(spark, rows)).head()
    assert (row.spot_0935, row.entry_vwap, row.entry_high, row.entry_low) == (10.0, 35.0, 41.0, 19.0)


def test_fingerprints_tell_cells_and_nulls_apart(spark):
    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("~", "c")], [("", "c")], [("1:a", None)], [("1", "a~")]]
    hashes = {sinks.fingerprint(spark.createDataFrame(t, "a string, b string")).head().content_hash for t in tables}
    assert len(hashes) == len(tables)


def test_universe_guard_raises(spark):
    frame = lambda *codes: spark.createDataFrame([(c,) for c in codes], "code string")
    assert Q.require_members(frame("a", "b", "b", "z"), "code", ["a", "b"], ["x"]).count() == 4
    for broken in (("a", "b", "x"), ("a",)):
        with pytest.raises(Exception, match="universe broken"):
            Q.require_members(frame(*broken), "code", ["a", "b"], ["x"]).collect()


def test_views_of_days_and_listings_read_the_raw_tables_once(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("spot", "expiry_iv", "marks", "calendar"):
        made = view(spark, folder, name)
        assert not [f for f in made.inputFiles() if "lineitem" in f or "orders" in f], name
        text = VIEWS[name](SPARK)
        tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "orders") if "{" + t + "}" in text}
        direct = spark.sql(text, **tables)
        assert direct.exceptAll(made).isEmpty() and made.exceptAll(direct).isEmpty(), name
