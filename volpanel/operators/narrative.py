"""Ranked evidence, triggers, headline and the daily snapshot document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel import texts as X
from volpanel.functions.num import add
from volpanel.operators.market import AXIS_NAMES, UNIVERSE

SESSION = [UNIVERSE, "session_date"]
ANSWERS = ("level", "shock", "tail", "term", "breadth", "repair")
METHODS = (
    ("IV30", "iv30_method"),
    ("IV60", "iv60_method"),
    ("IV90", "iv90_method"),
    ("ATM30", "atm_iv30_method"),
    ("PUT25_30", "iv_25d_put30_method"),
    ("CALL25_30", "iv_25d_call30_method"),
)


def _with_universe(df: DataFrame) -> DataFrame:
    return df if UNIVERSE in df.columns else add(df, {UNIVERSE: "'DEFAULT'"})


def rank_evidence(features: DataFrame, universe: P.Universe = P.DEFAULT_UNIVERSE) -> DataFrame:
    """Top drivers, counters and repairs per session.

    Each index row unfolds into its 18 components (a fixed number), then one
    ranking window per (session, pool). Ties follow index, axis, component order.
    """
    weights = "map(" + ", ".join(f"'{m.index}', {m.weight!r}D" for m in universe.members) + ")"
    places = "map(" + ", ".join(f"'{m.index}', {n}" for n, m in enumerate(universe.members)) + ")"
    parts = ", ".join(
        f"named_struct('n', {n}, 'pool', '{'REPAIR' if axis == 'Repair' else 'RISK'}', 'axis', '{axis.lower()}', 'component', '{c}', "
        f"'w', {pool!r}D * {w!r}D, 'percentile', {p}, 'raw_value', double({raw}), 'unit', '{unit}', 'text', '{text}')"
        for n, (axis, pool, c, p, w, raw, unit, text) in enumerate(X.EVIDENCE)
    )
    rows = _with_universe(features).selectExpr(
        *SESSION, "economic_index_id", f"explode(array({parts})) AS e"
    ).select(*SESSION, "economic_index_id", "e.*").filter("percentile IS NOT NULL")
    raw = f"{weights}[economic_index_id] * w * (percentile - 0.5D)"
    rows = add(rows, {"contribution": f"round(({raw}) * 1e6) / 1e6", "_order": f"{places}[economic_index_id] * 100 + n"})
    kinds = (
        "CASE WHEN pool = 'REPAIR' THEN CASE WHEN percentile >= 0.75D THEN 'REPAIR' END "
        "WHEN percentile >= 0.75D THEN 'DRIVER' WHEN percentile <= 0.35D THEN 'COUNTER' END"
    )
    rows = add(rows, {"evidence_kind": kinds}).filter("evidence_kind IS NOT NULL")
    lead = "CASE WHEN evidence_kind = 'COUNTER' THEN contribution ELSE -contribution END"
    over = f"PARTITION BY {', '.join(SESSION)}, evidence_kind ORDER BY {lead}, _order"
    rows = add(rows, {"evidence_rank": f"row_number() OVER ({over})"})
    keep = " ".join(f"WHEN '{k}' THEN {n}" for k, (n, _, _) in X.POOLS.items())
    return rows.filter(f"evidence_rank <= CASE evidence_kind {keep} END").selectExpr(
        *SESSION,
        "evidence_kind",
        "evidence_rank",
        "concat_ws('.', lower(economic_index_id), axis, component) AS evidence_id",
        "'DERIVED' AS identity",
        "economic_index_id AS carrier_or_index",
        "raw_value",
        "unit",
        "percentile",
        "contribution",
        f"concat(economic_index_id, '{X.NARRATIVE['of']}', text) AS meaning",
    )


def headline() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.HEADLINES.items() if k != "NOT_OK")
    return f"CASE WHEN data_status <> 'OK' THEN '{X.HEADLINES['NOT_OK']}' ELSE CASE primary_phase {cases} END END"


def structural_triggers() -> str:
    def trigger(name: str, condition: str, value: str = "'true'") -> str:
        return f"CASE WHEN {condition} THEN named_struct('trigger_id', '{name}', 'identity', 'DERIVED', 'value', {value}) END"

    parts = [trigger("hard_acute", "hard_acute")]
    parts += [trigger(f"segment_stressed.{s}", f"{s}_stressed") for s in P.DEFAULT_UNIVERSE.segments]
    parts.append(trigger("tail_side", "tail_answer NOT IN ('UNKNOWN', 'NEUTRAL', 'MIXED')", "tail_answer"))
    return f"array_compact(array({', '.join(parts)}))"


def view_changes() -> str:
    def items(key: str) -> str:
        return "array(" + ", ".join(f"'{t}'" for t in X.VIEW_CHANGES[key]) + ")"

    acute = ", ".join(f"'{p}'" for p in P.ACUTE_PHASES)
    return (
        f"CASE WHEN primary_phase IN ({acute}) THEN {items('ACUTE')} "
        + " ".join(
            f"WHEN primary_phase = '{k}' THEN {items(k)}" for k in ("REPAIR_IN_PROGRESS", "BROAD_PERSISTENT_PRESSURE", "UNKNOWN")
        )
        + f" ELSE {items('OTHER')} END"
    )


def narrative_columns(state: DataFrame, evidence: DataFrame) -> DataFrame:
    """State rows with headline, triggers, evidence lists and the narrative text."""
    # At most three rows per kind and session, so the lists have a fixed bound.
    item = "struct(evidence_rank, evidence_id, carrier_or_index, raw_value, unit, percentile, contribution, meaning)"
    lists = evidence.groupBy(*SESSION).agg(
        *[
            F.expr(f"array_sort(collect_list(CASE WHEN evidence_kind = '{k}' THEN {item} END)) AS {n}")
            for k, n in (("DRIVER", "drivers"), ("COUNTER", "counter_evidence"), ("REPAIR", "repair_evidence"))
        ]
    )
    df = _with_universe(state).join(lists, SESSION, "left")
    df = add(
        df,
        {
            "headline": headline(),
            "structural_triggers": structural_triggers(),
            "what_changes_the_view": view_changes(),
            **{
                f"_{n}": f"coalesce(array_join(transform({n}, x -> x.meaning), '{X.NARRATIVE['join']}'), '')"
                for n in ("drivers", "counter_evidence", "repair_evidence")
            },
        },
    )
    t = X.NARRATIVE
    outlook = "outlook_answer" if "outlook_answer" in df.columns else "'UNKNOWN'"
    lines = ", ".join(
        [
            "headline",
            f"concat('{t['price']}', level_answer, '{t['stop']}')",
            f"concat('{t['shock']}', shock_answer, '{t['term']}', term_answer, '{t['stop']}')",
            f"concat('{t['tail']}', tail_answer, '{t['breadth']}', breadth_answer, '{t['stop']}')",
            f"concat('{t['repair']}', repair_answer, '{t['join']}', if(_repair_evidence = '', '{t['no_repair']}', _repair_evidence), '{t['stop']}')",
            f"concat('{t['drivers']}', if(_drivers = '', '{t['no_driver']}', _drivers), '{t['stop']}')",
            f"if(_counter_evidence = '', NULL, concat('{t['counter']}', _counter_evidence, '{t['stop']}'))",
            f"concat('{t['outlook']}', {outlook}, '{t['stop']}')",
            f"concat('{t['changes']}', array_join(what_changes_the_view, '{t['join']}'), '{t['stop']}')",
            f"'{t['boundary']}'",
        ]
    )
    return add(df, {"narrative": f"concat_ws('\\n', {lines})"}).drop("_drivers", "_counter_evidence", "_repair_evidence")


def proxy_methods(features: DataFrame) -> DataFrame:
    """Disclosed proxy measures per session."""
    parts = ", ".join(
        f"CASE WHEN contains({c}, 'PROXY') THEN named_struct('metric', '{m}', 'method', {c}) END" for m, c in METHODS
    )
    return _with_universe(features).selectExpr(
        *SESSION, "economic_index_id", f"explode(array_compact(array({parts}))) AS p"
    ).select(*SESSION, "economic_index_id", "p.metric", "p.method")


def daily_snapshot(
    state: DataFrame, features: DataFrame, judged: DataFrame, *, provenance: dict[str, str], decision: DataFrame | None = None
) -> DataFrame:
    """One nested document row per session."""
    surface_fields = [
        "iv30_mf", "iv30_method", "iv60_mf", "iv60_method", "iv90_mf", "iv90_method", "fvol_30_90", "atm_iv30", "atm_iv30_method",
        "iv_25d_put30", "iv_25d_put30_method", "iv_25d_call30", "iv_25d_call30_method", "down_skew25", "up_skew25",
    ]
    features = _with_universe(features)
    surface_fields = [f for f in surface_fields if f in features.columns]
    # Four indices, five events and at most 24 proxies a session: bounded lists.
    surfaces = features.groupBy(*SESSION).agg(
        F.expr(
            "map_from_entries(collect_list(struct(economic_index_id, struct(carrier_id, surface_status, "
            f"struct({', '.join(surface_fields)}) AS surface, insurance_compensation)))) AS surfaces"
        )
    )
    fields = (
        "event_status, model_status, probability_kind, probability, base_rate, uplift, target_window_end_session, "
        "base_rate_sample_size, base_rate_positive_count, training_sample_size, training_positive_count, brier_skill, ece, interpretation"
    )
    events = judged.groupBy(*SESSION).agg(
        F.expr(f"map_from_entries(collect_list(struct(event_id, struct({fields})))) AS probabilities")
    )
    proxies = proxy_methods(features).groupBy(*SESSION).agg(
        F.expr("array_sort(collect_list(struct(economic_index_id, metric, method))) AS research_proxies")
    )
    df = narrative_columns(state, rank_evidence(features))
    for part in (surfaces, events, proxies):
        df = df.join(part, SESSION, "left")
    if decision is not None:
        df = df.join(decision.select("session_date", "decision_as_of"), "session_date", "left")
    scores = [a for a in AXIS_NAMES if a != "index_pressure"] + ["breadth"]
    outlook = ["outlook_answer AS outlook"] if "outlook_answer" in df.columns else []
    return df.selectExpr(
        *SESSION,
        "'1.0.0' AS schema_version",
        *(["decision_as_of"] if decision is not None else []),
        "'RESEARCH_MINUTE_CLOSE' AS run_mode",
        "evidence_tier",
        "'RESEARCH_ONLY_NOT_FORMAL' AS publication_status",
        "data_status", "confidence", "primary_phase", "pressure_level", "direction", "pressure_score",
        *[f"'{v}' AS {k}" for k, v in provenance.items()],
        f"struct({', '.join(scores)}) AS scores",
        f"struct({', '.join([f'{a}_answer AS {a}' for a in ANSWERS] + outlook)}) AS answers",
        "struct(stressed_segment_count, stressed_index_count, broad_confirmed, systemic_confirmed, breadth AS breadth_score, "
        "weighted_breadth_score, nominal_index_breadth) AS breadth",
        "economic_indices",
        "surfaces",
        "probabilities",
        "struct(headline, drivers, counter_evidence, repair_evidence, structural_triggers, what_changes_the_view, "
        "coalesce(research_proxies, array()) AS research_proxies, "
        f"concat(narrative, if(size(research_proxies) > 0, concat('\\n{X.NARRATIVE['proxies']}', array_join(transform(research_proxies, "
        f"x -> concat(x.economic_index_id, '.', x.metric, '=', x.method)), '{X.NARRATIVE['join']}'), '{X.NARRATIVE['stop']}'), '')) AS narrative) AS narrative",
    )
