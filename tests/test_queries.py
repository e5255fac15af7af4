"""Registered queries against DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

BASE = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not BASE.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    return con


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


ORDERED = [
    "pair_on_off_events", "rate_map_segments", "rate_map_as_of", "pairs_to_events", "canonical_pair_order", "score_diagnostics",
    "release_log_lines", "truncate_pairs", "phase_sequence", "pending_phase_transitions", "forward_snapshots_only",
    "frozen_at_transition", "merge_pass_pairs", "match_forward_backward", "session_order_audit", "linear_chain_test",
]


@pytest.mark.parametrize("ranges", ["many"], indirect=True)
@pytest.mark.parametrize("name", ORDERED)
def test_ordered_query_with_keys_across_ranges(spark, db, ranges, name):
    test_query(spark, db, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(BASE))
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    cursor = db.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(cursor.fetchall(), columns)
