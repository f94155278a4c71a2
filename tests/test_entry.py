"""Driver contract and oracle agreement on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

FAST = ["ownership_lww", "classify_clicks", "ownership_changes", "leaderboard_ranked", "ownership_pages_parity",
        "ownership_diff", "claim_audit", "tile_country", "country_tile_stats", "extract_roads", "land_filter",
        "parse_snapshot", "divergence_audit", "leaderboard_display", "element_counts"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["country_id", "score"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    from terrastate.plans import load_all

    assert set(load_all()) <= set(entry.oracle_sql()) & set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(load_all()) >= 88


@pytest.mark.parametrize("name", FAST)
def test_oracle_agreement(spark, name):
    from tools.oracle_check import TABLES, digest

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    orows, ocols = res.fetchall(), [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
