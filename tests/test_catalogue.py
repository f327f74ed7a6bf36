import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from evifold.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query_and_names_are_unique():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 5) if hasattr(v, "__float__") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


COMPARED = [
    "bm25_topk", "rrf_fusion", "history_window", "bootstrap_ci", "greedy_selection", "fair_share_cap", "evidence_pack", "call_output_pairing", "budget_charge", "prefix_chain_merge", "jaccard_pairs", "state_grading", "terminal_penalty",
    "longest_context", "retry_outcomes", "final_attempts", "combined_advantage", "masked_log_probs", "acceptance_subset", "link_density_blocks", "retained_spans", "section_audit", "clean_lines", "query_anchors", "repeated_windows",
    "token_scopes", "longest_first", "retention_groups", "finalised_batches", "merged_routes", "rotated_order", "event_log", "call_receipts", "csv_benchmark", "alias_components",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=str)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
