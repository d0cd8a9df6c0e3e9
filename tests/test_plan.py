from volpanel import params as P
from volpanel.operators import audit as A
from volpanel.plans.research import ResearchParams, build_research
from volpanel.session import scratch_path
from volpanel.sources.views import view

FOLDER = "/root/testdata/sf0.01"


def test_research_job_writes_consistent_tables(spark):
    chain = view(spark, FOLDER, "chain")
    marks = chain.selectExpr("session_date", "carrier_id", "spot AS etf_mark", "spot * 1.1D AS tr_mark").distinct()
    params = ResearchParams(reference_sessions=40, minimum_valid=10, base_rate_minimum=5)
    paths = build_research(chain, marks, chain.select("session_date"), scratch_path(spark, "research"), params)
    read = "market_state economic_index_state target_ledger daily_market_state carrier_surface".split()
    tables = {n: spark.read.parquet(paths[n]) for n in read}
    states = tables["market_state"]
    daily = spark.read.schema("session_date date, primary_phase string, pressure_score double").json(paths["daily"])
    assert states.count() == daily.count() > 60
    assert tables["economic_index_state"].count() == 4 * states.count()
    assert tables["target_ledger"].count() == len(P.EVENTS) * states.count()
    assert tables["daily_market_state"].filter("decision_as_of IS NULL").count() == 1
    same = A.reconcile(states, daily, ["session_date"], ["primary_phase"], ["pressure_score"])
    assert same.filter("NOT reconciled").count() == 0
    assert tables["carrier_surface"].filter("surface_status = 'VALID'").count() > 0
