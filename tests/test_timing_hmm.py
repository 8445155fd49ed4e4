from panelyard.operators import timing
from panelyard.plans import research_queries


def test_timing_hmm_takes_every_series_and_the_defaults(spark, monkeypatch):
    rows = [(d, str(c), 0.1 * d) for d in range(3) for c in range(25)]
    monkeypatch.setattr(research_queries, "_industry_returns", lambda *a: spark.createDataFrame(rows, "trade_date int, code string, r double"))
    seen = {}
    monkeypatch.setattr(timing, "hmm_filter", lambda series, *a, **params: seen.update(params) or series)
    assert research_queries.timing_hmm(spark, "").select("code").distinct().count() == 25
    assert not seen
