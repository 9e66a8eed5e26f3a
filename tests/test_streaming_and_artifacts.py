from __future__ import annotations

from pathlib import Path

from larkspur.operators.search import Fit
from larkspur.sources import artifacts
from larkspur.streaming import leaderboard

BOARD = "task string, model string, score double"


def test_board_improves_with_each_batch(spark, tmp_path):
    parts = [[("t", "a", 0.5), ("u", "a", 0.4)], [("t", "b", 0.7)], [("t", "c", 0.6), ("u", "b", 0.9)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, BOARD).coalesce(1).write.parquet(str(tmp_path / "in" / f"day={i}"))
        stream = spark.readStream.schema(BOARD).parquet(str(tmp_path / "in" / "*"))
        leaderboard.follow(stream, str(tmp_path / "best"), str(tmp_path / "state"), ["task"], "score", "model").awaitTermination(120)
    last = max((tmp_path / "best").iterdir(), key=lambda p: int(Path(p).name))
    assert {(r.task, r.model, r.score) for r in spark.read.parquet(str(last)).collect()} == {("t", "b", 0.7), ("u", "b", 0.9)}


def test_windowed_accuracy(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", y, p) for h, y, p in ((1, 1, 1), (1, 0, 1), (2, 1, 1), (2, None, 1))]
    schema = "at string, y int, pred int"
    spark.createDataFrame(rows, schema).selectExpr("cast(at as timestamp) as at", "y", "pred").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("at timestamp, y int, pred int").parquet(str(tmp_path / "p"))
    out = leaderboard.windowed_accuracy(stream, "at", []).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted((r.n, r.accuracy) for r in spark.table("acc").collect()) == [(1, 1.0), (2, 0.5)]


def test_fits_round_trip(spark):
    fits = [Fit(0, 0.1, ("a",), (1.0, 2.0, 0.0)), Fit(1, 0.2, ("a", "b"), (0.5, 1.0, -1.0)), Fit(None, 0.3, ("b",), (0.0, 0.0, 4.0))]
    assert artifacts.load_fits(artifacts.fits_table(spark, fits, ["a", "b"]), ["a", "b"]) == fits


def test_whole_fit_is_saved_loaded_and_fitted_anew(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from larkspur.operators import grid

    rng = np.random.default_rng(1)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), float(c), int(a + b / 2 + rng.normal() > 0)) for i, (a, b, c) in enumerate(rng.normal(0, 1, (300, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, age double, y int")
    recipe = artifacts.Recipe("lr", ("a", "b"), "y", {"penalty": 0.01}, ("age",), 0.0, True)
    fit = artifacts.fit_whole(df, recipe)
    artifacts.save_fit(fit, str(tmp_path / "fit"))
    again = artifacts.load_fit(spark, str(tmp_path / "fit"))
    p = lambda f, d: {r.id: (r.prediction, r.p) for r in f.predict(d).collect()}
    assert again.recipe == recipe and p(again, df) == p(fit, df) and again.calibration == fit.calibration
    # the same steps and estimator as a fit of the grid's
    plain, used = grid.refit(df, "lr", grid.Trial((("penalty", 0.01),), ("a", "b"), 0.0), "y", covariates=["age"])
    want = {r.id: r.prediction for r in plain.transform(used).collect()}
    assert {i: x for i, (x, _) in p(fit, df).items()} == want
    half = df.where("id < 150")
    anew = artifacts.fit_whole(half, again.recipe)
    assert p(anew, df) != p(fit, df) and p(anew, half) == p(artifacts.fit_whole(half, recipe), half)
    plain_tree = artifacts.fit_whole(df.withColumn("v", F.col("a") * 2), artifacts.Recipe("rf_regression", ("a",), "v", {"trees": 3}))
    assert "p" not in plain_tree.predict(df).columns


def test_listings_and_arrays(spark, tmp_path):
    import numpy as np
    import pytest
    from pyspark.errors import PythonException

    from larkspur.sources import arrays

    whole = {"a_v1.npy": np.arange(12, dtype=np.float32).reshape(4, 3), "b_v2.npy": np.arange(8).reshape(2, 2, 2), "c.npy": np.float64(7)}
    (tmp_path / "sub").mkdir()
    for k, x in whole.items():
        np.save(tmp_path / ("sub" if k[0] == "b" else ".") / k, x)
    (tmp_path / "a_v1.txt").write_text("text")
    found = arrays.listing(spark, str(tmp_path), suffix=".npy")
    assert {(r.name, r.bytes) for r in found.collect()} == {(k, (tmp_path / ("sub" if k[0] == "b" else ".") / k).stat().st_size) for k in whole}
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert [r.name for r in found.where("bytes > 200").collect()] == [k for k in whole if (tmp_path / ("sub" if k[0] == "b" else ".") / k).stat().st_size > 200]
    got = {}
    for r in arrays.read_arrays(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row, list(r.shape), list(r.values)))
    for k, x in whole.items():
        assert sorted(got[k]) == [(i, list(x.shape), np.asarray(v, float).ravel().tolist()) for i, v in enumerate(np.atleast_1d(x) if x.ndim == 0 else x)]
    assert arrays.first_existing(spark, str(tmp_path), "a", ["_v2", "_v1"], [".pkl", ".txt", ".npy"]).endswith("a_v1.txt")
    with pytest.raises(FileNotFoundError):
        arrays.first_existing(spark, str(tmp_path / "none"), "a", ["_v1"], [".npy"])
    np.save(tmp_path / "objects.npy", np.array([{"code": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(PythonException):
        arrays.read_arrays(spark, str(tmp_path), "objects.npy").collect()
