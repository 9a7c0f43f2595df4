"""Every catalogue query next to its SQL twin, and the rows-only ones for shape and quality."""

import __spark_entry__ as entry
import oracle
import pytest

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    for row in rows:
        record = row.asDict()
        if "r2" in record and "rmse" in record:
            assert record["r2"] > 0.6, record


def test_training_queries_do_the_whole_job(spark, sf, monkeypatch):
    from tabforge.operators import experiments, resample
    from tabforge.operators.split import CV_SPLITS
    from tabforge.plans import model_queries

    class Stop(Exception):
        pass

    def asked(*args, **options):
        made.append((args, options))
        raise Stop

    monkeypatch.setattr(model_queries, "create_model", asked)
    monkeypatch.setattr(resample, "cross_validate", asked)
    monkeypatch.setattr(experiments, "run_grid", asked)
    for name in ("train_forest", "train_gbt", "train_regularised_gbt", "importance_topn", "cv_forest", "grid_run"):
        made = []
        with pytest.raises(Stop):
            QUERIES[name](spark, sf)
        ((args, options),) = made
        assert not set(options) & {"n_estimators", "max_depth", "learning_rate"}, name
        assert options.get("k", CV_SPLITS) == options.get("cv_splits", CV_SPLITS) == CV_SPLITS, name
        if name == "cv_forest":
            assert args[3:] == ()
        if name == "grid_run":
            assert args[2].count() == 8


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
