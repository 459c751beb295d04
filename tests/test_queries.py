"""Every query with an oracle gives the rows that DuckDB gives; the others give rows."""

import duckdb
import pandas as pd
import pytest

from tracewarden import catalog, oracles

TABLES = catalog.GIVEN


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    found, expected = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(oracles.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_boosted_trees_find_the_planted_proxy(spark, sf_dir):
    assert catalog.QUERIES["reconstruct_gbt"](spark, sf_dir).first()["auc"] > 0.7


def test_boosted_trees_take_every_testable_group_and_the_serving_features(spark, sf_dir):
    found = catalog.QUERIES["reconstruct_gbt"](spark, sf_dir, rounds=1, seeds=[17]).collect()
    groups = [("segment", g) for g in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")] + [("status_code", g) for g in "FP"]
    assert sorted((r["column_name"], r["grp"]) for r in found) == groups
    _, features, _ = catalog._serving_frame(spark)
    assert features == ["market_code", "origin_name", "status_code", "priority_code", "account_balance_usd"]
    # status_code is its own target there and must not be among what rebuilds it.
    assert all(r["auc"] < 0.9 for r in found if r["column_name"] == "status_code")
