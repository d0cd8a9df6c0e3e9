"""Audit panel, summary counts, reconciliation and named checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add, same_number
from volpanel.operators import calendar as C

SURFACE = (
    "surface_status evidence_tier vintage_kind iv30_mf iv30_method iv60_mf iv60_method iv90_mf iv90_method iv_25d_put30 iv_25d_put30_method "
    "iv_25d_call30 iv_25d_call30_method down_skew25 up_skew25 fvar_30_90 input_contracts eligible_contracts issues"
).split()
FEATURE = "rv_forecast30 vrp_ewma94 vrp_percentile insurance_compensation".split()
STATE = "data_status primary_phase pressure_score shock down_tail up_tail breadth repair hard_acute".split()


def coverage_regime(date: str, eras: Sequence[tuple[str, str, str | None]] = P.ERAS) -> str:
    """Listing era of a date; the eras are a short fixed list, so no join is needed."""
    cases = " ".join(
        f"WHEN {date} >= DATE'{a}'" + (f" AND {date} <= DATE'{b}'" if b else "") + f" THEN '{n}'" for n, a, b in eras
    )
    return f"CASE {cases} END"


def method_exactness(method: str) -> str:
    return (
        f"CASE WHEN {method} = 'TOTAL_VARIANCE_INTERPOLATION' THEN 'EXACT_EXPIRY_BRACKET' "
        f"WHEN contains(coalesce({method}, ''), 'NEAREST') THEN 'NEAREST_EXPIRY_PROXY' ELSE 'UNAVAILABLE' END"
    )


def session_grid(surfaces: DataFrame, universe: P.Universe = P.DEFAULT_UNIVERSE) -> DataFrame:
    """Every session with every member: distinct sessions unfolded over the fixed universe."""
    members = ", ".join(
        f"named_struct('carrier_id', '{m.carrier}', 'economic_index_id', '{m.index}')" for m in universe.members
    )
    return surfaces.select("session_date").distinct().selectExpr("session_date", f"inline(array({members}))")


def business_audit(
    surfaces: DataFrame,
    features: DataFrame,
    states: DataFrame,
    listings: DataFrame,
    calendar: DataFrame,
    *,
    universe: P.Universe = P.DEFAULT_UNIVERSE,
    eras: Sequence[tuple[str, str, str | None]] = P.ERAS,
) -> DataFrame:
    """Carrier by session audit rows, listed or not."""
    key = ["session_date", "carrier_id"]
    grid = session_grid(surfaces, universe).join(listings.select("carrier_id", "listing_date"), "carrier_id", "left")
    grid = add(grid, {"is_listed": "coalesce(session_date >= listing_date, false)", "coverage_regime": coverage_regime("session_date", eras)})
    grid = C.listing_age(grid, calendar, "listing_date")
    grid = add(grid, {"available_carrier_count": "count_if(is_listed) OVER (PARTITION BY session_date)"})
    observed = surfaces.groupBy("session_date").agg(F.expr("count(DISTINCT carrier_id) AS observed_carrier_count"))
    df = grid.join(observed, "session_date", "left")
    df = df.join(surfaces.select(*key, *[c for c in SURFACE if c in surfaces.columns]), key, "left")
    df = df.join(features.select(*key, *FEATURE), key, "left")
    df = df.join(states.selectExpr("session_date", *[f"{c} AS market_{c}" for c in STATE]), "session_date", "left")
    return add(
        df,
        {
            "data_status": "CASE WHEN NOT is_listed THEN 'NOT_LISTED' WHEN surface_status IS NULL THEN 'MISSING' ELSE surface_status END",
            "price_proxy": "CASE WHEN surface_status IS NOT NULL THEN 'MINUTE_CLOSE_1456' END",
            "q_30_method_status": method_exactness("iv30_method"),
            "q_variance_30_annualized": "pow(iv30_mf / 100D, 2)",
            "p_variance_30_annualized": "rv_forecast30",
            "q_minus_p_variance_30_annualized": "pow(iv30_mf / 100D, 2) - rv_forecast30",
            "history_evidence_kind": "'RETROSPECTIVE_WALK_FORWARD'",
        },
    )


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.expr("count(1) AS rows"))


def premium_identity(features: DataFrame) -> DataFrame:
    """Largest departure from vrp = (iv / 100)^2 - forecast over complete rows."""
    rows = features.filter("iv30_mf IS NOT NULL AND rv_forecast30 IS NOT NULL AND vrp_ewma94 IS NOT NULL")
    out = rows.agg(
        F.expr("count(1) AS checked_rows"),
        F.expr("max(abs(pow(iv30_mf / 100D, 2) - rv_forecast30 - vrp_ewma94)) AS max_absolute_residual"),
    )
    return add(out, {"identity_passed": "max_absolute_residual <= 1e-12"})


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), numeric: Sequence[str] = (), tolerance: float = 1e-10
) -> DataFrame:
    """Full outer comparison of two tables on a key: one verdict per key."""
    a = left.selectExpr(*keys, "true AS _l", *[f"{c} AS _l_{c}" for c in (*exact, *numeric)])
    b = right.selectExpr(*keys, "true AS _r", *[f"{c} AS _r_{c}" for c in (*exact, *numeric)])
    rules = ["_l IS NOT NULL", "_r IS NOT NULL"]
    rules += [f"_l_{c} <=> _r_{c}" for c in exact]
    rules += [same_number(f"_l_{c}", f"_r_{c}", tolerance) for c in numeric]
    both = a.join(b, list(keys), "full")
    return both.selectExpr(*keys, f"({' AND '.join(rules)}) AS reconciled")


def checks(named: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(check, passed) rows; all checks of a table are taken in one pass over it."""
    tables: dict[int, tuple[DataFrame, dict[str, str]]] = {}
    for name, (df, rule) in named.items():
        tables.setdefault(id(df), (df, {}))[1][name] = rule
    parts = []
    for df, rules in tables.values():
        one = df.agg(*[F.expr(f"coalesce({rule}, false) AS `{name}`") for name, rule in rules.items()])
        listed = ", ".join(f"'{name}', `{name}`" for name in rules)
        parts.append(one.selectExpr(f"stack({len(rules)}, {listed}) AS (check, passed)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def acceptance_checks(
    observations: DataFrame, surfaces: DataFrame, states: DataFrame, ledger: DataFrame, judged: DataFrame, universe: P.Universe = P.DEFAULT_UNIVERSE
) -> DataFrame:
    publishable = "data_status = 'OK' AND primary_phase <> 'UNKNOWN'"
    methods = "iv30_method iv60_method iv90_method atm_iv30_method iv_25d_put30_method iv_25d_call30_method".split()
    carriers = ", ".join(f"'{c}'" for c in universe.carriers)
    excluded = ", ".join(f"'{c}'" for c in universe.excluded_option_codes)
    last = universe.members[-1].option_code
    return checks(
        {
            "real_input_used": (observations, "count(1) > 0"),
            "four_carriers_present": (surfaces, f"count(DISTINCT carrier_id) = {len(universe.members)} AND bool_and(carrier_id IN ({carriers}))"),
            "excluded_code_absent": (
                observations,
                f"bool_or(option_underlying_code = '{last}') AND NOT bool_or(option_underlying_code IN ({excluded}))",
            ),
            "state_history_nonempty": (states, "count(1) > 0"),
            "minimum_60_state_sessions": (states, "count(1) >= 60"),
            "minimum_60_publishable_states": (states, f"count_if({publishable}) >= 60"),
            "latest_state_publishable": (states, f"max_by({publishable}, session_date)"),
            "latest_probability_available": (
                judged, "max(CASE WHEN probability IS NOT NULL THEN prediction_position END) = max(prediction_position)"
            ),
            "proxy_methods_disclosed": (surfaces, f"bool_and({' AND '.join(f'{m} IS NOT NULL' for m in methods)})"),
            "five_event_ledgers_present": (ledger, f"count(DISTINCT event_id) = {len(P.EVENTS)}"),
            "formal_gate_passed": (ledger.limit(1), "max(false)"),
        }
    )


def verify_outputs(
    *, observations: DataFrame, surfaces: DataFrame, features: DataFrame, states: DataFrame, index_states: DataFrame,
    judged: DataFrame, evidence: DataFrame, issues: DataFrame, snapshots: DataFrame, revision: str,
    universe: P.Universe = P.DEFAULT_UNIVERSE,
) -> DataFrame:
    """Named reconciliation checks of the written tables against the latest document."""
    n = len(universe.members)
    excluded_codes = ", ".join(f"'{c}'" for c in universe.excluded_option_codes)
    excluded = ", ".join(f"'{c}'" for c in universe.excluded_carriers)
    last = states.agg(F.expr("max(session_date) AS session_date"))
    documents = snapshots.join(last, "session_date", "left_semi")
    state_doc = reconcile(
        states.join(last, "session_date", "left_semi"), documents, ["session_date"], exact=["primary_phase"], numeric=["pressure_score"]
    )
    surface_doc = reconcile(
        surfaces.join(last, "session_date", "left_semi"),
        documents.select("session_date", F.explode("surfaces").alias("economic_index_id", "s")).selectExpr(
            "session_date", "economic_index_id", "s.surface.iv30_mf AS iv30_mf", "s.surface.iv90_mf AS iv90_mf"
        ),
        ["session_date", "economic_index_id"],
        numeric=["iv30_mf", "iv90_mf"],
    )
    event_doc = reconcile(
        judged.join(last, "session_date", "left_semi"),
        documents.select("session_date", F.explode("probabilities").alias("event_id", "p")).selectExpr(
            "session_date", "event_id", "p.model_status", "p.event_status", "p.probability"
        ),
        ["session_date", "event_id"],
        exact=["model_status", "event_status"],
        numeric=["probability"],
    )
    sizes = (
        states.selectExpr("1 AS s", "0 AS i", "0 AS d")
        .unionAll(index_states.selectExpr("0 AS s", "1 AS i", "0 AS d"))
        .unionAll(snapshots.selectExpr("0 AS s", "0 AS i", "1 AS d"))
    )
    return checks(
        {
            "real_input_nonempty": (observations, "count(1) > 0"),
            "excluded_absent": (
                observations, f"NOT bool_or(option_underlying_code IN ({excluded_codes}) OR coalesce(carrier_id IN ({excluded}), false))"
            ),
            "latest_features_complete": (features.join(last, "session_date", "left_semi"), f"count(1) = {n}"),
            "index_states_complete": (sizes, f"sum(i) = {n} * sum(s)"),
            "daily_replay_complete": (sizes, "sum(d) = sum(s)"),
            "evidence_nonempty": (evidence, "count(1) > 0"),
            "issue_ledger_nonempty": (issues, "count(1) > 0"),
            "state_document_reconciled": (state_doc, "bool_and(reconciled)"),
            "surface_document_reconciled": (surface_doc, f"bool_and(reconciled) AND count(1) = {n}"),
            "probability_document_reconciled": (event_doc, f"bool_and(reconciled) AND count(1) = {len(P.EVENTS)}"),
            "revision_reconciled": (snapshots, f"bool_and(revision_id = '{revision}')"),
            "proxy_confidence_not_full": (documents, "bool_and(size(narrative.research_proxies) = 0 OR confidence <> 'FULL')"),
            "formal_publication_withheld": (snapshots, "bool_and(publication_status = 'RESEARCH_ONLY_NOT_FORMAL')"),
            "minimum_60_sessions": (states, "count(1) >= 60"),
        }
    )
