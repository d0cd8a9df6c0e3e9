"""Evidence, snapshots, sinks, audit panel, verification and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel import texts as X
from volpanel.functions.num import add
from volpanel.operators import audit as A
from volpanel.operators import models as Mo
from volpanel.operators import narrative as N
from volpanel.operators.market import AXIS_NAMES
from volpanel.registry.base import register, shared, step
from volpanel.registry.q_condor import opportunities
from volpanel.registry.q_events import calendar, ledger
from volpanel.registry.q_series import feature_history
from volpanel.registry.q_sources import observations
from volpanel.registry.q_state import CONFIG, scored, state
from volpanel.registry.q_surface import carrier_surfaces, expiry_surfaces
from volpanel.session import scratch_path
from volpanel.sources import scans as Sc
from volpanel.sources import sinks as K
from volpanel.sources.views import view

PROVENANCE = {"revision_id": "sha256:revision", "config_hash": CONFIG, "input_hash": "sha256:input"}
ERAS = (
    ("ERA_A_50_ONLY", "1995-01-01", "1996-02-04"),
    ("ERA_B_50_300", "1996-02-05", "1997-03-10"),
    ("ERA_C_50_300_500", "1997-03-11", "1998-01-04"),
    ("ERA_D_FOUR_CARRIERS", "1998-01-05", None),
)
_shift = "CASE carrier_id WHEN 'SSE50_510050' THEN 0 WHEN 'CSI300_510300' THEN 400 WHEN 'CSI500_510500' THEN 800 ELSE 1100 END"

# ---- evidence -------------------------------------------------------------------

_weights = "CASE economic_index_id " + " ".join(f"WHEN '{m.index}' THEN {m.weight!r}e0" for m in P.DEFAULT_UNIVERSE.members) + " END"
_places = "CASE economic_index_id " + " ".join(f"WHEN '{m.index}' THEN {n}" for n, m in enumerate(P.DEFAULT_UNIVERSE.members)) + " END"
step(
    "evidence_long",
    " UNION ALL ".join(
        f"SELECT session_date, economic_index_id, '{'REPAIR' if a == 'Repair' else 'RISK'}' AS pool, lower(economic_index_id) || '.{a.lower()}.{c}' AS evidence_id, {p} AS percentile, "
        f"CAST({raw} AS DOUBLE) AS raw_value, '{unit}' AS unit, round({_weights} * ({pool!r}e0 * {w!r}e0) * ({p} - 0.5e0) * 1e6) / 1e6 AS contribution, {_places} * 100 + {n} AS ord, economic_index_id || '的{text}' AS meaning "
        f"FROM features WHERE {p} IS NOT NULL"
        for n, (a, pool, c, p, w, raw, unit, text) in enumerate(X.EVIDENCE)
    ),
)
step(
    "evidence",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_date, evidence_kind ORDER BY CASE evidence_kind WHEN 'COUNTER' THEN contribution ELSE -contribution END, ord) AS evidence_rank
       FROM (SELECT *, CASE WHEN pool = 'REPAIR' THEN CASE WHEN percentile >= 0.75 THEN 'REPAIR' END WHEN percentile >= 0.75 THEN 'DRIVER' WHEN percentile <= 0.35 THEN 'COUNTER' END AS evidence_kind FROM evidence_long) e
       WHERE evidence_kind IS NOT NULL) r WHERE evidence_rank <= CASE evidence_kind WHEN 'COUNTER' THEN 2 ELSE 3 END""",
)


@shared
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return N.rank_evidence(feature_history(spark, folder))


@register(
    "t04_evidence_ranking",
    "session_date evidence_kind evidence_rank# evidence_id raw_value~ unit percentile~ contribution~ meaning",
    "SELECT * FROM evidence",
)
def _(spark, folder):
    return evidence.direct(spark, folder)


@shared
def judged(spark: SparkSession, folder: str) -> DataFrame:
    return Mo.judgments(ledger(spark, folder), minimum_samples=60)


@shared
def published(spark: SparkSession, folder: str) -> DataFrame:
    """State with the outlook answer of each session."""
    s = state(spark, folder)
    return s.join(Mo.outlook(judged(spark, folder), s), ["universe_id", "session_date"])


@shared
def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return N.daily_snapshot(
        published(spark, folder), feature_history(spark, folder), judged(spark, folder), provenance=PROVENANCE
    )


_heads = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.HEADLINES.items() if k != "NOT_OK")


@register(
    "x18_narrative",
    "session_date headline triggers drivers# counters# repairs# first_driver",
    f"""SELECT s.session_date, CASE WHEN s.data_status <> 'OK' THEN '{X.HEADLINES['NOT_OK']}' ELSE CASE s.primary_phase {_heads} END END AS headline,
        array_to_string(list_filter([CASE WHEN hard_acute THEN 'hard_acute' END, CASE WHEN large_stressed THEN 'segment_stressed.large' END, CASE WHEN mid_stressed THEN 'segment_stressed.mid' END,
          CASE WHEN tech_stressed THEN 'segment_stressed.tech' END, CASE WHEN tail_answer NOT IN ('UNKNOWN', 'NEUTRAL', 'MIXED') THEN 'tail_side' END], lambda x: x IS NOT NULL), '|') AS triggers,
        (SELECT count(*) FROM evidence e WHERE e.session_date = s.session_date AND evidence_kind = 'DRIVER') AS drivers, (SELECT count(*) FROM evidence e WHERE e.session_date = s.session_date AND evidence_kind = 'COUNTER') AS counters,
        (SELECT count(*) FROM evidence e WHERE e.session_date = s.session_date AND evidence_kind = 'REPAIR') AS repairs,
        (SELECT any_value(meaning) FROM evidence e WHERE e.session_date = s.session_date AND evidence_kind = 'DRIVER' AND evidence_rank = 1) AS first_driver FROM state s""",
)
def _(spark, folder):
    df = N.narrative_columns(published(spark, folder), evidence(spark, folder))
    return add(
        df,
        {
            "triggers": "concat_ws('|', transform(structural_triggers, x -> x.trigger_id))",
            "_d": "coalesce(drivers, array())",
            "first_driver": "CASE WHEN size(drivers) > 0 THEN drivers[0].meaning END",
            "counters": "coalesce(size(counter_evidence), 0)",
            "repairs": "coalesce(size(repair_evidence), 0)",
        },
    ).drop("drivers").withColumn("drivers", F.expr("size(_d)"))


@register(
    "x18_research_proxies",
    "session_date economic_index_id metric method",
    " UNION ALL ".join(
        f"SELECT session_date, economic_index_id, '{m}' AS metric, {c} AS method FROM features WHERE {c} LIKE '%PROXY%'" for m, c in N.METHODS
    ),
)
def _(spark, folder):
    return N.proxy_methods(feature_history(spark, folder))


@register(
    "x18_daily_snapshot",
    "session_date primary_phase pressure_level direction confidence pressure_score~ outlook proxies# events#",
    """SELECT s.session_date, s.primary_phase, s.pressure_level, s.direction, s.confidence, s.pressure_score, CASE WHEN s.data_status <> 'OK' THEN 'UNKNOWN' WHEN NOT e AND h THEN 'UNKNOWN' WHEN n THEN 'NOT_APPLICABLE' WHEN b THEN 'BASE_RATE_ONLY' ELSE 'UNKNOWN' END AS outlook,
         coalesce(p.k, 0) AS proxies, j.c AS events FROM state s JOIN (SELECT prediction_date AS session_date, count(*) AS c, bool_or(event_status = 'ELIGIBLE') AS e, bool_or(event_status = 'UNOBSERVABLE') AS h,
         bool_and(event_status = 'NOT_APPLICABLE') AS n, bool_or(model_status = 'BASE_RATE_ONLY') AS b FROM judged GROUP BY 1) j USING (session_date)
       LEFT JOIN (SELECT session_date, sum(CAST(iv30_method LIKE '%PROXY%' AS INT) + CAST(iv60_method LIKE '%PROXY%' AS INT) + CAST(iv90_method LIKE '%PROXY%' AS INT) + CAST(iv_25d_call30_method LIKE '%PROXY%' AS INT)) AS k FROM features GROUP BY 1) p USING (session_date)""",
)
def _(spark, folder):
    df = N.daily_snapshot(published(spark, folder), feature_history(spark, folder), judged(spark, folder), provenance=PROVENANCE)
    return add(df, {"outlook": "answers.outlook", "proxies": "size(narrative.research_proxies)", "events": "size(probabilities)"})


# ---- sinks ----------------------------------------------------------------------


@register(
    "k01_parquet_roundtrip",
    "session_date economic_index_id iv30_mf~ insurance_compensation",
    "SELECT * FROM features WHERE year(session_date) = 1998",
)
def _(spark, folder):
    path = scratch_path(spark, "feature")
    K.write_table(feature_history(spark, folder), path)
    return Sc.scan(spark, path, ["session_date", "economic_index_id", "iv30_mf", "insurance_compensation", "session_year"]).filter("session_year = 1998")


@register("k02_csv_ledger", "economic_index_id session_date horizon pnl_per_combo~", "SELECT economic_index_id, session_date, horizon, pnl_per_combo FROM opps")
def _(spark, folder):
    path = scratch_path(spark, "opportunity")
    K.write_csv(opportunities(spark, folder).select("economic_index_id", "session_date", "horizon", "pnl_per_combo"), path, order=["economic_index_id", "session_date", "horizon"])
    return spark.read.option("header", True).schema("economic_index_id string, session_date date, horizon string, pnl_per_combo double").csv(path)


@register("k03_daily_documents", "session_date primary_phase pressure_score~", "SELECT session_date, primary_phase, pressure_score FROM state")
def _(spark, folder):
    path = scratch_path(spark, "snapshot")
    K.write_documents(snapshots(spark, folder), path)
    return spark.read.schema("session_date date, primary_phase string, pressure_score double").json(path)


@register("k03_latest_document", "session_date primary_phase", "SELECT session_date, primary_phase FROM state ORDER BY session_date DESC LIMIT 1")
def _(spark, folder):
    return K.latest(snapshots(spark, folder))


@register(
    "k04_flat_states",
    "session_date data_status confidence primary_phase pressure_score~ insurance_level~ shock~ level_answer repair_answer large_stressed stressed_segment_count# hard_acute checkpoint_hash",
    "SELECT * FROM state",
)
def _(spark, folder):
    return K.flatten_states(published(spark, folder))


@register(
    "k05_index_state_rows",
    "session_date economic_index_id carrier_id data_status " + " ".join(f"{a}~" for a in AXIS_NAMES),
    "SELECT * FROM scored WHERE session_date IN (SELECT session_date FROM state)",
)
def _(spark, folder):
    return K.flatten_index_states(state(spark, folder))


@register(
    "k06_table_contract",
    "session_date primary_phase decision_as_of available_at state_version revision_id",
    """SELECT s.session_date, s.primary_phase, x.next_session + TIME '09:00:00' AS decision_as_of, CAST(NULL AS TIMESTAMP) AS available_at, '1.0.0' AS state_version, 'sha256:revision' AS revision_id
       FROM state s LEFT JOIN sessions_x x USING (session_date)""",
)
def _(spark, folder):
    return K.attach_contract(
        K.flatten_states(state(spark, folder)), calendar(spark, folder), version_field="state_version", version="1.0.0",
        common={"revision_id": "sha256:revision"},
    )


_cells = ", ".join(
    f"coalesce(length({c}) || ':' || {c}, '~')"
    for c in ("CAST(session_date AS VARCHAR)", "primary_phase", "candidate_phase", "CAST(candidate_streak AS VARCHAR)")
)
_chunks = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT)) AS c{i}" for i in range(4))


@register(
    "k07_content_fingerprint",
    "rows# content_hash",
    f"""SELECT rows, 'sha256:' || sha256(concat_ws(':', rows, c0, c1, c2, c3)) AS content_hash FROM (SELECT count(*) AS rows, {_chunks} FROM (
        SELECT sha256(concat({_cells})) AS h FROM state) q) r""",
)
def _(spark, folder):
    return K.fingerprint(state(spark, folder), ["session_date", "primary_phase", "candidate_phase", "candidate_streak"])


@register(
    "m10_map_struct_access",
    "session_date sse50_shock~ star50_status stressed_members#",
    """SELECT s.session_date, a.shock AS sse50_shock, b.data_status AS star50_status, (CASE WHEN stressed_0 THEN 1 ELSE 0 END + CASE WHEN stressed_1 THEN 1 ELSE 0 END + CASE WHEN stressed_2 THEN 1 ELSE 0 END + CASE WHEN stressed_3 THEN 1 ELSE 0 END) AS stressed_members
       FROM state s JOIN scored a ON a.session_date = s.session_date AND a.economic_index_id = 'SSE50' JOIN scored b ON b.session_date = s.session_date AND b.economic_index_id = 'STAR50'""",
)
def _(spark, folder):
    return add(
        state(spark, folder),
        {
            "sse50_shock": "economic_indices['SSE50'].shock",
            "star50_status": "economic_indices['STAR50'].data_status",
            "stressed_members": "size(filter(map_values(index_stressed), x -> x))",
        },
    )


@register(
    "m11_strict_json",
    "session_date document",
    """SELECT session_date, '{"candidate_phase":' || coalesce('"' || candidate_phase || '"', 'null') || ',"candidate_streak":' || candidate_streak || ',"primary_phase":"' || primary_phase || '"}' AS document FROM state""",
)
def _(spark, folder):
    return K.strict_json(state(spark, folder), ["primary_phase", "candidate_streak", "candidate_phase"])


@register("t06_canonical_order", "session_date economic_index_id position#", "SELECT session_date, economic_index_id, row_number() OVER (ORDER BY session_date, economic_index_id) AS position FROM v_panel")
def _(spark, folder):
    path = scratch_path(spark, "ordered")
    K.write_ordered(view(spark, folder, "panel"), path, ["session_date", "economic_index_id"])
    return K.stored_order(spark, path)


@register(
    "s08_bucketed_join",
    "session_date economic_index_id iv30_mf~ data_status",
    "SELECT f.session_date, f.economic_index_id, f.iv30_mf, s.data_status FROM features f JOIN scored s USING (session_date, economic_index_id)",
)
def _(spark, folder):
    keys = ["economic_index_id", "session_date"]
    tables = []
    for name, df in (("features", feature_history(spark, folder)), ("scored", scored(spark, folder))):
        path = scratch_path(spark, name)
        tables.append(K.write_bucketed(df, "t_" + path.rsplit("-", 1)[1], path, keys, buckets=8))
    left, right = tables
    return left.select(*keys, "iv30_mf").join(right.select(*keys, "data_status"), keys)


# ---- audit ----------------------------------------------------------------------


def listings(spark, folder) -> DataFrame:
    first = Sc.first_listings(Sc.contract_master(view(spark, folder, "contract_rows")))
    return first.selectExpr("carrier_id", f"date_add(listing_date, {_shift}) AS listing_date")


@shared
def audit(spark: SparkSession, folder: str) -> DataFrame:
    features = feature_history(spark, folder)
    return A.business_audit(
        features, features, state(spark, folder), listings(spark, folder), calendar(spark, folder), eras=ERAS
    )


step("listings_x", f"SELECT carrier_id, min(list_date) + {_shift} AS listing_date FROM master GROUP BY carrier_id")
_era = "CASE " + " ".join(
    f"WHEN session_date >= DATE '{a}'" + (f" AND session_date <= DATE '{b}'" if b else "") + f" THEN '{n}'" for n, a, b in ERAS
) + " END"
step(
    "grid_x",
    f"""SELECT g.*, l.listing_date, session_date >= l.listing_date AS is_listed, {_era} AS coverage_regime,
        CASE WHEN session_date >= l.listing_date THEN (SELECT count(*) FROM v_calendar k WHERE k.session_date BETWEEN l.listing_date AND g.session_date) END AS listing_age_sessions
        FROM (SELECT DISTINCT p.session_date, c.carrier_id, c.economic_index_id FROM v_panel p, (SELECT DISTINCT carrier_id, economic_index_id FROM v_panel) c) g JOIN listings_x l USING (carrier_id)""",
)
step(
    "audit_x",
    """SELECT g.*, count(*) FILTER (WHERE is_listed) OVER (PARTITION BY g.session_date) AS available_carrier_count, o.n AS observed_carrier_count, f.iv30_mf, f.iv30_method, f.rv_forecast30, f.vrp_ewma94, f.surface_status,
       CASE WHEN NOT is_listed THEN 'NOT_LISTED' WHEN f.surface_status IS NULL THEN 'MISSING' ELSE f.surface_status END AS data_status,
       CASE WHEN f.iv30_method = 'TOTAL_VARIANCE_INTERPOLATION' THEN 'EXACT_EXPIRY_BRACKET' WHEN f.iv30_method LIKE '%NEAREST%' THEN 'NEAREST_EXPIRY_PROXY' ELSE 'UNAVAILABLE' END AS q_30_method_status,
       pow(f.iv30_mf / 100e0, 2) AS q_variance_30_annualized, pow(f.iv30_mf / 100e0, 2) - f.rv_forecast30 AS q_minus_p_variance_30_annualized, s.primary_phase AS market_primary_phase, s.pressure_score AS market_pressure_score
       FROM grid_x g LEFT JOIN features f USING (session_date, carrier_id) LEFT JOIN (SELECT session_date, count(DISTINCT carrier_id) AS n FROM v_panel GROUP BY 1) o USING (session_date) LEFT JOIN state s USING (session_date)""",
)


@register(
    "j18_session_grid",
    "session_date carrier_id is_listed surface_status",
    "SELECT * FROM audit_x",
)
def _(spark, folder):
    return audit(spark, folder)


@register("j19_listing_era", "session_date carrier_id coverage_regime", "SELECT * FROM audit_x")
def _(spark, folder):
    return audit(spark, folder)


@register("j20_listing_age", "session_date carrier_id listing_age_sessions#", "SELECT * FROM audit_x")
def _(spark, folder):
    return audit(spark, folder)


@register(
    "x28_business_audit",
    "session_date carrier_id listing_date is_listed listing_age_sessions# coverage_regime available_carrier_count# observed_carrier_count# data_status q_30_method_status "
    "q_variance_30_annualized~ q_minus_p_variance_30_annualized~ market_primary_phase market_pressure_score~",
    "SELECT * FROM audit_x",
)
def _(spark, folder):
    return audit.direct(spark, folder)


@register(
    "a30_null_inclusive_counts",
    "coverage_regime market_primary_phase rows#",
    "SELECT coverage_regime, market_primary_phase, count(*) AS rows FROM audit_x GROUP BY 1, 2",
)
def _(spark, folder):
    return A.counts_by(audit(spark, folder), ["coverage_regime", "market_primary_phase"])


@register("x28_status_counts", "coverage_regime carrier_id data_status rows#", "SELECT coverage_regime, carrier_id, data_status, count(*) AS rows FROM audit_x GROUP BY 1, 2, 3")
def _(spark, folder):
    return A.counts_by(audit(spark, folder), ["coverage_regime", "carrier_id", "data_status"])


@register(
    "a31_premium_identity",
    "checked_rows# max_absolute_residual~9 identity_passed",
    """SELECT count(*) AS checked_rows, max(abs(pow(iv30_mf / 100e0, 2) - rv_forecast30 - vrp_ewma94)) AS max_absolute_residual, max(abs(pow(iv30_mf / 100e0, 2) - rv_forecast30 - vrp_ewma94)) <= 1e-12 AS identity_passed
       FROM premium WHERE iv30_mf IS NOT NULL AND rv_forecast30 IS NOT NULL AND vrp_ewma94 IS NOT NULL""",
)
def _(spark, folder):
    return A.premium_identity(feature_history(spark, folder))


@register("j22_reconcile_tables", "session_date economic_index_id reconciled", "SELECT session_date, economic_index_id, true AS reconciled FROM v_panel")
def _(spark, folder):
    return A.reconcile(
        feature_history(spark, folder), view(spark, folder, "panel"), ["session_date", "economic_index_id"], exact=["surface_status"], numeric=["iv30_mf", "iv90_mf"]
    )


_acc = {
    "real_input_used": "(SELECT count(*) > 0 FROM observations)",
    "four_carriers_present": "(SELECT count(DISTINCT carrier_id) = 4 FROM carrier_surface)",
    "excluded_code_absent": "(SELECT bool_or(option_underlying_code = 'OP588000.SH') AND NOT bool_or(option_underlying_code = 'OP588080.SH') FROM observations)",
    "state_history_nonempty": "(SELECT count(*) > 0 FROM state)",
    "minimum_60_state_sessions": "(SELECT count(*) >= 60 FROM state)",
    "minimum_60_publishable_states": "(SELECT count(*) >= 60 FROM state WHERE data_status = 'OK' AND primary_phase <> 'UNKNOWN')",
    "latest_state_publishable": "(SELECT data_status = 'OK' AND primary_phase <> 'UNKNOWN' FROM state ORDER BY session_date DESC LIMIT 1)",
    "latest_probability_available": "(SELECT bool_or(model_status = 'BASE_RATE_ONLY') FROM judged WHERE prediction_position = (SELECT max(prediction_position) FROM judged))",
    "proxy_methods_disclosed": "(SELECT bool_and(iv30_method IS NOT NULL AND iv60_method IS NOT NULL AND iv90_method IS NOT NULL) FROM carrier_surface)",
    "five_event_ledgers_present": "(SELECT count(DISTINCT event_id) = 5 FROM ledger)",
    "formal_gate_passed": "false",
}


@register("a33_acceptance_checks", "check_name passed", " UNION ALL ".join(f"SELECT '{k}' AS check_name, coalesce({v}, false) AS passed" for k, v in _acc.items()))
def _(spark, folder):
    out = A.acceptance_checks(
        observations(spark, folder), carrier_surfaces(spark, folder), state(spark, folder), ledger(spark, folder), judged(spark, folder)
    )
    return out.withColumnRenamed("check", "check_name")


@register(
    "x30_acceptance_by_event",
    "event_id eligible# observed# positives# overall",
    """SELECT event_id, count(*) FILTER (WHERE event_status = 'ELIGIBLE') AS eligible, count(label) AS observed, coalesce(sum(label), 0) AS positives,
       CASE WHEN """ + " AND ".join(f"coalesce({v}, false)" for k, v in _acc.items() if k != "formal_gate_passed") + """ THEN 'PASS_RESEARCH_ONLY_FORMAL_BLOCKED' ELSE 'FAIL' END AS overall FROM ledger GROUP BY 1""",
)
def _(spark, folder):
    from volpanel.operators.events import event_counts

    checks = A.acceptance_checks(
        observations(spark, folder), carrier_surfaces(spark, folder), state(spark, folder), ledger(spark, folder), judged(spark, folder)
    )
    verdict = checks.filter("check <> 'formal_gate_passed'").agg(
        F.expr("if(bool_and(passed), 'PASS_RESEARCH_ONLY_FORMAL_BLOCKED', 'FAIL') AS overall")
    )
    # One verdict row beside five event rows, matched on a constant key.
    left = add(event_counts(ledger(spark, folder)), {"_one": "1"})
    return left.join(add(verdict, {"_one": "1"}), "_one")


# The checks between documents and tables hold by construction; the others are counted again.
_outputs = {
    "real_input_nonempty": "(SELECT count(*) > 0 FROM observations)",
    "excluded_absent": "(SELECT NOT bool_or(option_underlying_code = 'OP588080.SH' OR coalesce(carrier_id = 'STAR50_588080', false)) FROM observations)",
    "latest_features_complete": "(SELECT count(*) = 4 FROM features WHERE session_date = (SELECT max(session_date) FROM state))",
    "index_states_complete": "(SELECT (SELECT count(*) FROM scored JOIN state USING (session_date)) = 4 * count(*) FROM state)",
    "daily_replay_complete": "(SELECT count(DISTINCT session_date) = count(*) FROM state)",
    "evidence_nonempty": "(SELECT count(*) > 0 FROM state WHERE data_status = 'OK')",
    "issue_ledger_nonempty": "(SELECT bool_or(len(issues) > 0) FROM carrier_surface)",
    "state_document_reconciled": "(SELECT count(*) = 1 FROM state WHERE session_date = (SELECT max(session_date) FROM state))",
    "surface_document_reconciled": "(SELECT count(*) = 4 FROM v_panel WHERE session_date = (SELECT max(session_date) FROM state))",
    "probability_document_reconciled": "(SELECT count(*) = 5 FROM judged WHERE prediction_date = (SELECT max(session_date) FROM state))",
    "revision_reconciled": "(SELECT count(*) > 0 FROM state)",
    "proxy_confidence_not_full": "(SELECT NOT (confidence = 'FULL' AND bool_or(iv30_method LIKE '%PROXY%' OR iv60_method LIKE '%PROXY%' OR iv90_method LIKE '%PROXY%')) FROM state JOIN features USING (session_date) WHERE session_date = (SELECT max(session_date) FROM state) GROUP BY confidence)",
    "formal_publication_withheld": "(SELECT count(*) > 0 FROM state)",
    "minimum_60_sessions": "(SELECT count(*) >= 60 FROM state)",
}


@register(
    "x29_output_verification",
    "check_name passed",
    " UNION ALL ".join(f"SELECT '{k}' AS check_name, coalesce({v}, false) AS passed" for k, v in _outputs.items()),
)
def _(spark, folder):
    from volpanel.operators.surface import issue_ledger

    out = A.verify_outputs(
        observations=observations(spark, folder),
        surfaces=feature_history(spark, folder),
        features=feature_history(spark, folder),
        states=state(spark, folder),
        index_states=K.flatten_index_states(state(spark, folder)),
        judged=judged(spark, folder),
        evidence=evidence(spark, folder),
        issues=issue_ledger(carrier_surfaces(spark, folder), expiry_surfaces(spark, folder)),
        snapshots=snapshots(spark, folder),
        revision=PROVENANCE["revision_id"],
    )
    return out.withColumnRenamed("check", "check_name")
