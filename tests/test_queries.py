"""Registered queries against their SQL. By default one or two per area; BASKETRY_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare, database

SHORT = [
    "read_topk_csv", "days_ago", "price_fit", "time_based_split", "user_coverage", "prediction_overlap", "item_catalog",
    "user_context", "candidate_features", "item_aliases", "session_mix", "time_gaps", "temporal_pairs", "cart_bypass",
    "fill_with_popularity", "next_week_top10", "evaluate_slices", "hit_rate_by_popularity", "rrf", "fusion_sweep",
    "tifu_scores", "profile_knn", "revisit", "carousel", "hard_gate", "self_check_flags", "fit_temperature",
    "prompt_table", "parse_ranked_list", "pad_sequences",
]
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
CHOSEN = sorted(QUERIES) if os.environ.get("BASKETRY_ALL") else SHORT


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert contract.entry(spark).columns == ["user_id", "item_id", "rank"]


@pytest.mark.parametrize("key", CHOSEN)
def test_query(spark, sf, key):
    ok, text, _, _ = compare(spark, sf, QUERIES[key], ORACLES.get(key), database(sf))
    assert ok is not False, text


def test_sections_do_not_overlap(spark, sf):
    rows = QUERIES["carousel"](spark, sf).filter("section <> 'revisit'")
    assert rows.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0
