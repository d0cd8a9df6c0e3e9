import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions import black as B
from volpanel.operators import surface as Sf

SESSION = dt.date(2026, 1, 5)


def chain(spark, days=(20, 45, 75, 120), vols=(0.20, 0.22, 0.24, 0.26)):
    rows = []
    for d, base in zip(days, vols):
        t = (d * 86400 + 240) / (365 * 86400)
        discount = math.exp(-0.018 * t)
        forward = 3.0 / discount
        for n, k in enumerate(np.round(np.arange(2.40, 3.601, 0.05), 2)):
            sigma = base + 0.12 * math.log(k / forward) ** 2
            for kind in "CP":
                p = float(B.price_array(np.array([kind == "C"]), forward, k, sigma, t, discount)[0])
                rows.append((SESSION, "CSI300_510300", "CSI300", f"{kind}{d}-{n}", SESSION + dt.timedelta(days=d), float(k), kind, p, 100, 10, 1000, True, 10000, 3.0))
    return spark.createDataFrame(
        rows,
        "session_date date, carrier_id string, economic_index_id string, contract_id string, expiry date, strike double, option_type string, price double, "
        "open_interest long, daily_volume long, daily_amount long, is_standard boolean, contract_unit int, spot double",
    )


def test_price_round_trip():
    t = 45 / 365
    price = B.price_array(np.array([False]), 3.02, 3.10, np.array([0.235]), t, 0.996)
    root = B.implied_sigma_array(np.array([False]), price, np.array([3.02]), np.array([3.10]), np.array([t]), np.array([0.996]))
    assert abs(root[0] - 0.235) < 1e-10


def test_roots_outside_bounds_are_missing():
    one = np.array([1.0])
    assert np.isnan(B.implied_sigma_array(np.array([True]), np.array([1.2]), one, one, one, one))[0]
    assert np.isnan(B.implied_sigma_array(np.array([True]), np.array([-0.1]), one, one, one, one))[0]


def test_column_price_equals_array_price(spark):
    df = spark.createDataFrame([("C", 3.02, 3.1, 0.235, 0.12, 0.996), ("P", 3.02, 2.7, 0.4, 0.5, 0.98)],
                               "option_type string, forward double, strike double, sigma double, year_fraction double, discount_factor double")
    for r in B.with_forward_delta(B.with_black_price(df)).collect():
        expected = B.price_array(np.array([r.option_type == "C"]), r.forward, r.strike, r.sigma, r.year_fraction, r.discount_factor)[0]
        assert r.model_price == pytest.approx(expected, abs=1e-14)
        assert (0 < r.delta < 1) if r.option_type == "C" else (-1 < r.delta < 0)


def test_synthetic_chain_is_valid(spark):
    carriers, expiries = Sf.build_surface_history(chain(spark))
    c = carriers.first()
    assert c.surface_status == "VALID"
    assert None not in (c.iv30_mf, c.iv60_mf, c.iv90_mf, c.iv_25d_put30, c.iv_25d_call30)
    assert c.iv30_method == "TOTAL_VARIANCE_INTERPOLATION"
    e = expiries.orderBy("expiry").first()
    assert e.discount_factor == pytest.approx(math.exp(-0.018 * e.year_fraction), abs=1e-9)
    assert e.forward == pytest.approx(3.0 / e.discount_factor, abs=1e-8)
    assert e.atm_iv == pytest.approx(20.0, abs=0.1)


def test_single_expiry_is_a_labelled_proxy(spark):
    c = Sf.build_surface_history(chain(spark, (20,), (0.20,)))[0].first()
    assert c.iv30_mf is not None and c.iv30_method == "NEAREST_EXPIRY_PROXY"
    assert c.iv90_mf is None and c.iv90_method == "UNAVAILABLE"
    assert "IV90_UNBRACKETED_TENOR" in c.issues and "IV30_NEAREST_EXPIRY_PROXY" in c.issues


def test_tenor_interpolation(spark):
    rows = [(SESSION, "c", SESSION + dt.timedelta(days=d), d / 365, float(d), v * v) for d, v in ((20, 0.20), (50, 0.24), (130, 0.28))]
    df = spark.createDataFrame(rows, "session_date date, carrier_id string, expiry date, year_fraction double, dte double, variance double")
    for c in ("atm_iv", "iv_25d_put", "iv_25d_call"):
        df = df.withColumn(c, F.lit(20.0))
    for c in ("atm_method", "put25_method", "call25_method"):
        df = df.withColumn(c, F.lit("X"))
    expected = (20 / 365 * 0.04 * (2 / 3) + 50 / 365 * 0.0576 * (1 / 3)) / (30 / 365)
    assert Sf.tenor_points(df).first().iv30_mf == pytest.approx(100 * math.sqrt(expected), abs=1e-9)


def test_mirrored_duplicates_and_bad_prices_change_nothing(spark):
    base = chain(spark)
    worse = base.withColumn("contract_id", F.concat("contract_id", F.lit("x"))).withColumn("open_interest", F.lit(1)).withColumn("price", F.col("price") * 1.5)
    bad = base.withColumn("price", F.lit(float("nan"))).withColumn("open_interest", F.lit(10**9))
    a = Sf.build_surface_history(base)[0].first()
    b = Sf.build_surface_history(base.unionByName(worse.select(base.columns)).unionByName(bad))[0].first()
    assert (a.iv30_mf, a.atm_iv30, a.iv_25d_put30) == (b.iv30_mf, b.atm_iv30, b.iv_25d_put30)


def test_too_few_pairs(spark):
    few = chain(spark).filter("strike BETWEEN 2.9 AND 3.05")
    e = Sf.build_expiry_surfaces(few).first()
    assert e.issues[0] == "PARITY_PAIR_MISSING" and e.variance is None and e.atm_method == "UNAVAILABLE"


def test_params_are_defaults():
    assert P.SurfaceParams().minimum_total_strikes == 9


def test_strikes_and_totals_do_not_sort_all_quotes(spark):
    day = "date'2024-01-02', 'c', 'i', date'2024-02-01'"
    rows = [
        (2.0, "C", 5, 1, "b", 0.5), (2.0, "C", 5, 1, "a", 0.4), (2.0, "C", 5, 0, "0", 0.3), (2.0, "C", 9, 9, "x", 0.0),
        (2.0, "P", None, 3, "p", 0.2), (2.0, "P", 0, 2, "o", 0.1), (2.5, "C", 1, 1, "y", 0.0), (2.5, "P", 1, 1, "z", None),
    ]
    quotes = spark.createDataFrame(rows, "strike double, option_type string, open_interest long, daily_volume long, contract_id string, price double")
    chain = quotes.selectExpr(
        "*", *[f"{v} AS {n}" for v, n in zip(day.split(", "), ("session_date", "carrier_id", "economic_index_id", "expiry"))],
        "3D AS spot", "10000 AS contract_unit", "true AS is_standard", "1L AS daily_amount",
    )
    pairs = Sf.paired_strikes(chain, keep=("economic_index_id", "spot"))
    got = {r.strike: (r.call_price, r.put_price, r.economic_index_id, r.spot) for r in pairs.collect()}
    assert got == {2.0: (0.4, 0.2, "i", 3.0), 2.5: (None, None, "i", 3.0)}
    total = Sf.chain_totals(chain).collect()[0]
    assert (total.input_contracts, total.economic_index_id, total.pcr_volume) == (8, "i", 6 / 12)
    # only the most held contracts reach the aggregate that sorts, and the totals of raw rows are hashed
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (pairs, Sf.chain_totals(chain))]
    assert "Join" in plans[0]
    assert [x for x in plans[1].splitlines() if "Aggregate" in x][-1].strip(" +-:").startswith("HashAggregate")
