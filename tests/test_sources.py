"""CSV, cache, bundle, run log, requests and streams: round trips and failures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators.metrics import evaluation_report
from tabforge.operators.models import create_model
from tabforge.operators.profile import feature_ranges
from tabforge.operators.scoring import ranges_dict
from tabforge.operators.strategies import create_strategy
from tabforge.session import scratch_path
from tabforge.sources import files, requests, runlog
from tabforge.sources.bundle import Bundle, load_first
from tabforge.sources.cache import PreparedCache
from tabforge.sources.requests import parse_records
from tabforge.spec import HOUSING, Constraint, FeatureSpec
from tabforge.streaming import jobs, serve
from tabforge.streaming.reload import ModelSlots
from test_operators import SPEC, numbers


def write_csv(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def test_csv_null_marks_and_columns(spark, tmp_path):
    columns = list(HOUSING.columns)
    rows = [[v] * len(columns) for v in ("1.0", "NA", "", "NaN", "null", "2")]
    path = write_csv(tmp_path / "d.csv", columns, rows)
    df = files.read_csv(spark, path, columns, key="row_id")
    assert df.agg(F.count("CRIM"), F.count(F.lit(1))).first()[:] == (2, 6)
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"), columns)
    with pytest.raises(ValueError, match="Missing"):
        files.read_csv(spark, write_csv(tmp_path / "a.csv", columns[1:], []), columns)
    with pytest.raises(ValueError, match="Unexpected"):
        files.read_csv(spark, write_csv(tmp_path / "b.csv", [*columns, "Z"], []), columns)


def test_split_write_prunes_to_one_side(spark, tmp_path):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    files.write_split(rows, str(tmp_path / "s"))
    assert files.read_split(spark, str(tmp_path / "s"), "test").count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_split(spark, str(tmp_path / "nothing"))


def test_report_document(spark, tmp_path):
    def report(error, **parts):
        rows = [(s, float(i), i + (error if s == "test" else 0.0) * (-1) ** i) for s in ("train", "test") for i in range(10)]
        scored = spark.createDataFrame(rows, "split string, y double, p double")
        return evaluation_report(scored, "y", "p", **parts)

    files.write_json(report(2.0, params={"n": np.int64(3)}), str(tmp_path / "er.json"))
    report_row = json.loads(spark.read.text(str(tmp_path / "er.json")).first()["value"])
    assert report_row["overfitting_warning"] is True and "feature_importance" not in report_row
    assert report_row["model_params"] == {"n": "3"} and report_row["test_metrics"]["rmse"] == 2.0
    small = report(0.1, importance={"a": 1}).first()
    assert small["overfitting_warning"] is False and small["feature_importance"] == {"a": 1.0}
    report = report_row
    path = str(tmp_path / "deep" / "er" / "report")
    files.write_document(spark, {**report, "values": np.array([1.5, 2.0])}, path)
    assert files.read_document(spark, path)["values"] == [1.5, 2.0]


def test_cache_hit_miss_status_clear(spark, tmp_path):
    df, _, _ = numbers(spark, 100, gaps=0.1)
    cache = PreparedCache(spark, str(tmp_path / "cache"))
    first = cache.get_or_create(df, SPEC, "v1_median")
    assert (first.metadata["train_samples"], first.metadata["test_samples"]) == (80, 20)
    marker = first.metadata["created_at"]
    assert cache.get_or_create(df, SPEC, "v1_median").metadata["created_at"] == marker
    assert cache.get_or_create(df, SPEC, "v1_median", test_size=0.3).metadata["test_samples"] == 30
    changed = df.withColumn("a", F.col("a") + 1)
    assert cache.get_or_create(changed, SPEC, "v1_median").metadata["created_at"] != marker
    status = cache.status().collect()
    assert len(status) == 3 and all(r["complete"] for r in status)
    files.remove(spark, f"{tmp_path}/cache/{status[0]['entry']}/metadata")
    assert cache.status().where("not complete").count() == 1
    assert cache.clear("v2_knn") == 0 and cache.clear("v1_median") == 3


@pytest.fixture(scope="module")
def bundle(spark):
    df, _, _ = numbers(spark, 120, gaps=0.05)
    prep = create_strategy("v4_robust_col", SPEC).fit(df)
    model = create_model("linear", SPEC).fit(prep.transform(df))
    ranges = ranges_dict(feature_ranges(df, SPEC.features))
    return Bundle.create(model, prep, 120, 0, ranges, test_metrics={"r2": 0.9}), df


def test_bundle_round_trip(spark, bundle, tmp_path):
    made, df = bundle
    path = made.save(str(tmp_path / "bundle"))
    again = Bundle.load(path)
    expected = [r["prediction"] for r in made.predict(df).orderBy("id").collect()]
    assert np.allclose(expected, [r["prediction"] for r in again.predict(df).orderBy("id").collect()])
    assert again.metadata["artifact_id"] == made.metadata["artifact_id"]
    assert again.metadata["feature_stats"] == made.metadata["feature_stats"]
    assert again.info("local")["test_samples"] is None
    assert made.predict(df).orderBy("id").first()["a"] == df.orderBy("id").first()["a"]
    response = again.respond(df.limit(1)).first()
    assert response["model_version"] == made.metadata["artifact_id"][:8]
    assert response["prediction_formatted"].startswith("$")
    for part in ("model", "metadata"):
        files.remove(spark, f"{path}/{part}")
        with pytest.raises(FileNotFoundError):
            Bundle.load(path)
    assert load_first([path, str(tmp_path / "none")]) == (None, None)


def test_signature(spark, bundle):
    made, df = bundle
    with pytest.raises(ValueError, match="Missing"):
        made.predict(df.drop("b"))
    with pytest.raises(ValueError, match="not a number"):
        made.predict(df.withColumn("b", F.col("b").cast("string")))


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    runs = spark.createDataFrame(
        [("r1", {"source": "cli"}, {"n": "3"}, {"rmse": 1.5}, None)],
        "run_id string, tags map<string,string>, hyperparameters map<string,string>, "
        "test_metrics map<string,double>, cv_metrics map<string,double>",
    )
    runlog.append(path, runlog.long_form(runs))
    runlog.append(path, runlog.long_form(runs.withColumn("test_metrics", F.create_map(F.lit("rmse"), F.lit(1.25)))))
    log = runlog.read(spark, path)
    assert {tuple(r) for r in log.select("kind", "key").distinct().collect()} == {
        ("tag", "source"), ("param", "hp_n"), ("metric", "test_rmse"),
    }
    assert runlog.latest_metrics(log, ["test_rmse"]).first()["test_rmse"] == 1.25


def test_requests_from_json(spark):
    rows = spark.createDataFrame(
        [(1, '{"a": 1.5, "b": "x"}'), (2, "no json"), (3, '{"a": null}')], "id int, body string"
    )
    parsed = requests.parse_records(rows, "body", ["a", "b"]).orderBy("id").collect()
    assert (parsed[0]["a"], parsed[0]["b"]) == ("1.5", "x")
    assert parsed[1]["_corrupt_record"] == "no json" and parsed[2]["a"] is None
    batch = spark.createDataFrame([(1, '{"items": [{"a": 1}, {"a": 2}]}')], "id int, body string")
    items = requests.parse_batches(batch, "body", ["a"]).orderBy("item_index").collect()
    assert [(r["item_index"], r["a"]) for r in items] == [(0, "1"), (1, "2")]


def test_late_rows_are_dropped(spark):
    folder = scratch_path(spark, "in")
    schema = "ts timestamp, k string"

    def add(values):
        spark.createDataFrame(values, "ts string, k string").selectExpr("cast(ts as timestamp) ts", "k").coalesce(
            1
        ).write.mode("append").parquet(folder)

    out = scratch_path(spark, "out")
    for values in (
        [("2024-01-01 00:01:00", "x"), ("2024-01-01 02:00:00", "x")],
        [("2024-01-01 00:02:00", "x"), ("2024-01-01 04:00:00", "x")],
    ):
        add(values)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.run_append(jobs.windowed_counts(stream, "ts", "1 hour", "1 hour", ["k"]), out)
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["n"]) for r in rows] == [(0, 1), (2, 1)]


def test_service_scores_refuses_and_survives_a_replay(spark, bundle, tmp_path):
    """Accepted and refused add up, broken JSON is kept, and an epoch run again gives the same answers."""
    made, df = bundle
    paths = {"champion": made.save(str(tmp_path / "m1"))}
    slots = ModelSlots(lambda: spark.createDataFrame(list(paths.items()), "alias string, path string"), Bundle.load)
    rules = [Constraint(f, ge=-1000) for f in made.model.spec.features]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, " + ", ".join(f"`{f}` double" for f in made.model.spec.features)
    lines = [json.dumps({"id": r["id"], **{f: r[f] for f in made.model.spec.features}}) for r in df.limit(20).collect()]

    def stream():
        text = spark.readStream.text(inbox).withColumnRenamed("value", "payload")
        names = ["id", *made.model.spec.features]
        return parse_records(text, "payload", names).withColumn("id", F.col("id").try_cast("bigint"))

    spark.createDataFrame([(x,) for x in [*lines, "{broken"]], "value string").coalesce(1).write.mode("append").text(inbox)
    serve.run_service(stream(), slots, "id", rules, out)
    paths["champion"] = made.save(str(tmp_path / "m2"))
    spark.createDataFrame([(x,) for x in lines[:5]], "value string").coalesce(1).write.mode("append").text(inbox)
    serve.run_service(stream(), slots, "id", rules, out)
    logs = {part: serve.read_log(spark, out, part) for part in ("scores", "refused", "batches")}
    read, accepted, refused = logs["batches"].selectExpr("sum(read)", "sum(accepted)", "sum(refused)").first()
    assert (read, accepted, refused) == (26, logs["scores"].count(), logs["refused"].count())
    assert logs["batches"].where("seconds > 0").count() == 2
    broken = [r["errors"][0]["message"] for r in logs["refused"].where("_corrupt_record is not null").collect()]
    assert broken == ["Input should be valid JSON"]
    whole = {r["id"]: r["prediction"] for r in made.predict(df.limit(20)).collect()}
    scores = logs["scores"].collect()
    assert scores and all(np.isclose(whole[r["id"]], r["prediction"]) for r in scores)
    # The first epoch again, after the alias moved: its own bundle is loaded, nothing is doubled.
    loaded = []
    slots.load = lambda path: loaded.append(path) or Bundle.load(path)
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{inbox}-again")
    again = spark.read.schema(schema).json(f"{inbox}-again")
    serve.scorer(slots, "id", rules, out)(again, 0)
    assert loaded == [str(tmp_path / "m1")]
    assert serve.read_log(spark, out, "scores").count() == len(scores)


def test_reload_keeps_the_old_model_on_failure(spark):
    state = {"champion": "v1"}

    def aliases():
        return spark.createDataFrame(list(state.items()), "alias string, path string")

    def load(path):
        if path == "broken":
            raise FileNotFoundError(path)
        return path.upper()

    slots = ModelSlots(aliases, load)
    slots.refresh()
    slots.refresh()
    state["champion"] = "broken"
    slots.refresh()
    assert slots.models == {"champion": "V1"}
    state.update(champion="v2", challenger="v3")
    slots.refresh(only="challenger")
    assert slots.models == {"champion": "V1", "challenger": "V3"}
    out = scratch_path(spark, "served")
    run = slots.score_batches(lambda df, models: df.withColumn("by", F.lit(models["champion"])), out)
    run(spark.range(2), 0)
    run(spark.range(2), 0)
    assert [r["by"] for r in spark.read.parquet(out).collect()] == ["V2", "V2"]
    assert [status for _, _, status in slots.loads] == ["success", "failure", "success", "success"]


def test_single_and_batch_agree(spark, bundle):
    made, df = bundle
    whole = {r["id"]: r["prediction"] for r in made.predict(df.limit(8)).collect()}
    for i in list(whole)[:3]:
        assert np.isclose(made.predict(df.where(F.col("id") == i)).first()["prediction"], whole[i])


def test_end_to_end_on_housing_columns(spark, tmp_path):
    random = np.random.RandomState(0)
    n = 100
    x = random.uniform(1, 10, (n, 13))
    x[:, 3] = random.randint(0, 2, n)
    y = 20 + 4 * x[:, 5] - 0.5 * x[:, 12] - 0.1 * x[:, 0] + random.normal(0, 2, n)
    rows = [[*map(lambda v: f"{v:.6f}", r), f"{t:.6f}"] for r, t in zip(x, y, strict=True)]
    rows[0][2] = "NA"
    path = write_csv(tmp_path / "h.csv", HOUSING.columns, rows)
    df = files.read_csv(spark, path, HOUSING.columns, key=HOUSING.key)
    prepared = PreparedCache(spark, str(tmp_path / "c")).get_or_create(df, HOUSING, "v2_knn")
    model = create_model("linear", HOUSING).fit(prepared.side("train"))
    from tabforge.operators.metrics import regression_metrics

    assert regression_metrics(model.transform(prepared.side("test")), "MEDV", "prediction").first()["rmse"] < 10
    assert isinstance(model.spec, FeatureSpec)


def test_store_keeps_tables_together(spark, tmp_path):
    from tabforge.sources.store import Change, LostRace, Snapshot, TableStore

    def rows(*values):
        return spark.createDataFrame([(v,) for v in values], "a bigint")

    def seen(name, snapshot=None):
        return sorted(r["a"] for r in store.read(name, snapshot).collect())

    store = TableStore(spark, str(tmp_path / "store"))
    assert store.snapshot() == Snapshot() and store.numbers() == []
    with pytest.raises(ValueError, match="no table"):
        store.read("x")
    first = store.commit(Snapshot(), Change(append={"x": rows(1, 2)}, replace={"y": rows()}))
    second = store.commit(first, Change(append={"x": rows(2, 3)}, replace={"y": rows(9)}))
    assert (seen("x"), seen("y"), store.numbers()) == ([1, 2, 2, 3], [9], [1, 2])
    assert (seen("x", first), seen("y", store.snapshot(1))) == ([1, 2], [])
    with pytest.raises(LostRace):
        store.commit(first, Change(append={"x": rows(7)}, replace={"y": rows(7)}))
    with pytest.raises(ValueError, match="other types"):
        store.commit(second, Change(append={"x": spark.createDataFrame([("t",)], "a string")}))
    with pytest.raises(ValueError, match="both"):
        store.commit(second, Change(append={"x": rows()}, replace={"x": rows()}))
    with pytest.raises(ValueError, match="no snapshot 9"):
        store.snapshot(9)
    # Neither refused writer changed anything or left files.
    assert (seen("x"), seen("y"), store.numbers()) == ([1, 2, 2, 3], [9], [1, 2])
    assert len(list((tmp_path / "store" / "data").iterdir())) == 4
    assert [p.name for p in (tmp_path / "store" / "log").iterdir() if "draft" in p.name] == []


def test_store_update_after_a_lost_race(spark, tmp_path):
    from tabforge.sources.store import Change, LostRace, Snapshot, TableStore

    store = TableStore(spark, str(tmp_path / "store"))
    one = spark.range(1)
    store.commit(Snapshot(), Change(replace={"x": one}))
    calls = []

    def overtaken(own, base):
        calls.append(base.number)
        if len(calls) == 1:
            TableStore(spark, own.path).commit(base, Change(append={"x": one}))
        return Change(append={"x": one})

    assert store.update(overtaken, tries=2).number == 3
    assert calls == [1, 2] and store.read("x").count() == 3
    calls.clear()
    with pytest.raises(LostRace):
        store.update(overtaken)
    assert store.read("x").count() == 4
