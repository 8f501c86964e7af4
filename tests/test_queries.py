"""Every registered query against its SQL counterpart at the smallest size."""

import pytest

from tests.compare import duck, rows
from tickforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    mine = registry.queries()[name](spark, sf_dir).toPandas()
    theirs = duck(sf_dir, registry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    for a, b in zip(rows(mine), rows(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x[0] == y[0] == 1 and abs(x[1] - y[1]) <= 2e-6 * max(1, abs(x[1])), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_two_sets_hold_all_tickers(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(registry.utility, "tstr_benchmark", lambda *sets: (seen.append([{r[0] for r in x.select("ticker").distinct().collect()} for x in sets]), {"trtr": {"accuracy": 0.0, "f1": 0.0, "roc_auc": 0.0}})[1])
    registry.queries()["n15_tstr"](spark, sf_dir)
    tickers = {r[0] for r in registry._bars(spark, sf_dir).select("ticker").distinct().collect()}
    assert set.union(*seen[0]) == tickers and not set.intersection(*seen[0])
