"""The end-to-end research job: sources to surfaces, state, events and documents.

Every stage writes its table and the next stage reads it back, so lineage stays
short, a lost executor costs one stage, and later jobs reuse the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.operators import calendar as C
from volpanel.operators import events as E
from volpanel.operators import features as X
from volpanel.operators import market as M
from volpanel.operators import models as Mo
from volpanel.operators import narrative as N
from volpanel.operators import state as St
from volpanel.operators import surface as Sf
from volpanel.sources import sinks as K


@dataclass(frozen=True)
class ResearchParams:
    surface: P.SurfaceParams = P.SurfaceParams()
    models: P.ModelParams = P.ModelParams()
    reference_sessions: int = P.REFERENCE_SESSIONS
    minimum_valid: int = P.RESEARCH_MINIMUM_VALID
    base_rate_minimum: int = 60
    base_rate_maximum: int = 504
    config_hash: str = "sha256:config"
    revision_id: str = "sha256:revision"


def build_research(
    observations: DataFrame, marks: DataFrame, sessions: DataFrame, folder: str, params: ResearchParams = ResearchParams()
) -> dict[str, str]:
    """Run all stages; returns the path of every table written under ``folder``.

    ``observations`` is the option chain (one bar per contract and session),
    ``marks`` the underlying marks, ``sessions`` the exchange calendar.
    """
    spark = observations.sparkSession
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame, date: str = "session_date") -> DataFrame:
        paths[name] = f"{folder.rstrip('/')}/{name}"
        K.write_table(df, paths[name], date=date)
        return spark.read.schema(df.schema).parquet(paths[name])

    calendar = C.session_calendar(sessions)
    chain = observations.drop("spot").join(
        marks.selectExpr(*Sf.CARRIER, "etf_mark AS spot"), Sf.CARRIER, "inner"
    )
    expiries = save("carrier_expiry_surface", Sf.build_expiry_surfaces(Sf.eligible_contracts(chain, params.surface), params.surface))
    carriers = save("carrier_surface", Sf.build_carrier_surfaces(chain, expiries, params.surface))
    save("issue_ledger", Sf.issue_ledger(carriers, expiries))
    flat = carriers.withColumn("issues", F.concat_ws("|", "issues"))
    features = save(
        "economic_index_feature",
        X.build_index_feature_history(flat, marks, reference_sessions=params.reference_sessions, minimum_valid=params.minimum_valid),
    )
    market = M.build_market_score_history(
        features, reference_sessions=params.reference_sessions, minimum_valid=params.minimum_valid
    )
    state = save(
        "market_state", E.add_predictors(St.apply_phase_hysteresis(St.add_state_ontology(market), config_hash=params.config_hash))
    )
    save("economic_index_state", K.flatten_index_states(state))
    ledger = save("target_ledger", E.build_target_ledger(state, calendar), date="prediction_date")
    oof = Mo.out_of_fold_scores(ledger, params.models)
    calibrated = save("oof_probability", Mo.sequential_calibration(oof, params.models), date="prediction_date")
    metrics = Mo.acceptance_metrics(calibrated, params.models)
    accepted = Mo.fit_current(ledger, calibrated, metrics, params.models)
    judged = save(
        "event_probability",
        Mo.judgments(ledger, accepted, minimum_samples=params.base_rate_minimum, maximum_samples=params.base_rate_maximum),
    )
    published = state.join(Mo.outlook(judged, state), [M.UNIVERSE, "session_date"])
    contract = {"revision_id": params.revision_id, "config_hash": params.config_hash, "vintage_kind": "PROVIDER_RECONSTRUCTED"}
    save(
        "daily_market_state",
        K.attach_contract(K.flatten_states(published), calendar, version_field="state_version", version=P.STATE_VERSION, common=contract),
    )
    save("market_evidence", N.rank_evidence(features))
    snapshots = N.daily_snapshot(
        published, features, judged, provenance={"revision_id": params.revision_id, "config_hash": params.config_hash},
        decision=C.decision_time(state.select("session_date"), calendar),
    )
    paths["daily"] = f"{folder.rstrip('/')}/daily"
    K.write_documents(snapshots, paths["daily"])
    return paths
