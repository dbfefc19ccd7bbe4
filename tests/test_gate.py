"""The gate sends no evidence to the driver."""

from basketry.operators import gate
from basketry.plans import trust


def test_evidence_is_not_broadcast(spark, sf):
    rows = trust.stored_evidence(spark, sf)
    checked = gate.hard_gate(trust.faulty_responses(rows), rows)
    assert "BroadcastExchange" not in checked._jdf.queryExecution().executedPlan().toString()
