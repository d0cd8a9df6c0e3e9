import itertools

import pytest
from pyspark.sql import functions as F

from volpanel.functions import num, tri
from volpanel.operators.quality import require_unique, validate_quotes

T, U, N = True, None, False


def value(spark, text):
    return spark.range(1).select(F.expr(text).alias("v")).first().v


def lit(v):
    return "CAST(NULL AS BOOLEAN)" if v is None else str(v).lower()


def test_truth_table(spark):
    assert value(spark, tri.all_of(lit(N), lit(U))) is False
    assert value(spark, tri.all_of(lit(T), lit(U))) is None
    assert value(spark, tri.any_of(lit(T), lit(U))) is True
    assert value(spark, tri.any_of(lit(N), lit(U))) is None
    assert value(spark, tri.negate(lit(U))) is None


def test_counting_matches_enumeration(spark):
    rows = list(itertools.product([T, U, N], repeat=3))
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    abc = ["a", "b", "c"]
    out = num.add(df, {"two": tri.at_least_k(abc, 2), "one": tri.exactly_one(abc), "n": tri.count_if_all_known(abc)}).collect()
    for r in out:
        worlds = [w for w in itertools.product([T, N], repeat=3) if all(x is None or x == y for x, y in zip(r[:3], w))]
        two = {sum(w) >= 2 for w in worlds}
        assert r.two == (two.pop() if len(two) == 1 else None)
        # exactly_one is decided through "at least two", then "at least one"
        if r.two is True:
            assert r.one is False
        elif r.two is None:
            assert r.one is None
        assert r.n == (None if None in r[:3] else sum(r[:3]))


def test_named_examples(spark):
    assert value(spark, tri.at_least_k([lit(T), lit(U), lit(N)], 2)) is None
    assert value(spark, tri.at_least_k([lit(T), lit(T), lit(U)], 2)) is True
    assert value(spark, tri.exactly_one([lit(T), lit(N), lit(N)])) is True
    assert value(spark, tri.exactly_one([lit(T), lit(T), lit(U)])) is False
    assert value(spark, tri.exactly_one([lit(N), lit(N), lit(U)])) is None


def test_choice_stops_at_unknown(spark):
    assert value(spark, tri.choose([("A", lit(N)), ("B", lit(U)), ("C", lit(T))], "D")) == "UNKNOWN"
    assert value(spark, tri.choose([("A", lit(N)), ("C", lit(T))], "D")) == "C"
    assert value(spark, tri.choose([("A", lit(N))], "D")) == "D"


def test_guards(spark):
    assert value(spark, num.known("double('NaN')")) is None
    assert value(spark, num.ratio("1", "0")) is None
    assert value(spark, num.log_ratio("0D", "1D")) is None
    assert value(spark, num.same_number("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")) is True
    assert value(spark, num.same_number("1D", "CAST(NULL AS DOUBLE)")) is False
    assert value(spark, num.forward_variance_issue("40D", "20D")) == "NEGATIVE_FORWARD_VARIANCE"


def test_repeated_key_fails(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="key repeats"):
        require_unique(df, ["k"]).collect()


def quotes(spark, **changes):
    carriers = ["SSE50_510050", "CSI300_510300", "CSI500_510500", "STAR50_588000"]
    rows = [("2026-01-05", c, f"q{i}", "C", 3.0, "2026-02-25", 0.10, 0.11) for i, c in enumerate(carriers)]
    df = spark.createDataFrame(rows, "session_date string, carrier_id string, contract_id string, option_type string, strike double, expiry string, bid double, ask double")
    base = {
        "event_time": "timestamp'2026-01-05 14:56:57 Asia/Shanghai'",
        "available_at": "timestamp'2026-01-05 14:56:58 Asia/Shanghai'",
        "vintage_kind": "'AS_TRADED'",
        "revision_id": "'r1'",
        "licence_scope": "'full'",
    }
    return num.add(df, {**base, **changes})


def test_quote_gate(spark):
    ok = validate_quotes(quotes(spark), licence_verified=True).first()
    assert ok.accepted and ok.accepted_rows == 4
    refused = validate_quotes(quotes(spark), licence_verified=False).first()
    assert not refused.accepted and refused.issues == ["NON_DISPLAY_LICENCE_NOT_VERIFIED"]
    late = validate_quotes(quotes(spark, event_time="timestamp'2026-01-05 14:56:50 Asia/Shanghai'"), licence_verified=True).first()
    assert late.issues == ["QUOTE_SYNC_TOLERANCE_FAILED"] and late.accepted_rows == 0
    crossed = validate_quotes(quotes(spark, ask="bid - 0.01D"), licence_verified=True).first()
    assert crossed.issues == ["INVALID_TWO_SIDED_QUOTE"]
    missing = validate_quotes(quotes(spark).drop("bid"), licence_verified=True).first()
    assert missing.issues == ["MISSING_FIELDS:bid"]
