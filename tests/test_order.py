"""Published result orders, and an oracle that does not share the engine's labels."""

from crashlens.functions import codes
from crashlens.plans import oracle_labels, registry


def test_results_come_in_the_published_order(spark, sf):
    queries = registry.queries()
    for key in ("hourly_accident_stats", "time_period_comparison", "environment_risk_matrix", "profile_missing_pct"):
        names = registry.RESULT_ORDER[key]
        rows = queries[key](spark, sf).collect()
        keys = [tuple(-r[n[1:]] if n[0] == "-" else r[n] for n in names) for r in rows]
        assert keys == sorted(keys), key


def test_oracle_labels_are_stated_apart():
    assert oracle_labels.NOTEBOOK == codes.NOTEBOOK_LABELS
    assert oracle_labels.DOMAINS["weather"] is not codes.WEATHER and oracle_labels.DOMAINS["weather"] == codes.WEATHER
