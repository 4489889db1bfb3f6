"""Statements that DuckDB never ended under a LIMIT, until their last step was materialized."""

import glob
import os
import threading

import pytest

from tidemark.plans import control_plane, panel, studies  # noqa: F401 (they add to the panel queries)

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["routed_predictions", "conformal_sets", "conformal_group_sets"])
def test_statement_ends_under_a_limit(name):
    with duckdb.connect() as con:
        for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        stop = threading.Timer(60, con.interrupt)
        stop.start()
        try:
            assert len(con.execute(f"select * from ({panel.SQL[name]}) t limit 10").fetchall()) == 10
        finally:
            stop.cancel()
