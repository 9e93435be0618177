"""The booster equals a slow one, whatever the partitions; trees survive a store."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ohmwatch.learning import datasets as ds
from ohmwatch.learning import newton
from ohmwatch.session import run_dir, shuffles_freed


def slow(codes, y, spec, bins):
    """Boosting row by row and split by split."""
    base = y.mean() if spec.objective == "squared" else 0.0
    margin, trees = np.full(len(y), base), []
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-margin)) if spec.objective == "logistic" else margin
        g, h = p - y, p * (1 - p) if spec.objective == "logistic" else np.ones(len(y))
        tree = {}

        def split(place, rows, level):
            G, H = g[rows].sum(), h[rows].sum()
            value, best = -spec.rate * G / (H + spec.l2), (1e-12, None, None)
            if level < spec.depth:
                for f in range(codes.shape[1]):
                    for b in range(bins - 1):
                        to_left = codes[rows, f] <= b
                        gl, hl = g[rows[to_left]].sum(), h[rows[to_left]].sum()
                        if min(hl, H - hl) < spec.least_weight:
                            continue
                        gain = 0.5 * (gl**2 / (hl + spec.l2) + (G - gl) ** 2 / (H - hl + spec.l2) - G**2 / (H + spec.l2))
                        if gain > best[0] + 1e-12:
                            best = (gain, f, b)
            tree[place] = (value, best[1], best[2])
            if best[1] is None:
                margin[rows] += value
                return
            left = codes[rows, best[1]] <= best[2]
            split(2 * place + 1, rows[left], level + 1)
            split(2 * place + 2, rows[~left], level + 1)

        split(0, np.arange(len(y)), 0)
        trees.append(tree)
    return margin, trees


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 4))
    y = 2 * (x[:, 0] > 0.3) + np.sin(2 * x[:, 1]) + 0.5 * x[:, 2] * (x[:, 3] > 0)
    data = pd.DataFrame({"asset_id": 0, "ts": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3], "y": y, "z": (y > 1).astype(float), "fold": np.arange(n) // 100})
    return data, spark.createDataFrame(data)


@pytest.mark.parametrize("rows", [1 << 16, 60])
@pytest.mark.parametrize("objective, label", [("squared", "y"), ("logistic", "z")])
def test_trees_equal_the_slow_ones(frame, monkeypatch, objective, label, rows):
    """In one task, and with the sums of several tasks met by a shuffle."""
    monkeypatch.setattr(newton, "TASK_ROWS", rows)
    data, df = frame
    spec = newton.Spec("m", label, ("a", "b", "c", "d"), objective, trees=13, depth=3, rate=0.3)
    model = newton.fit(df.repartition(5), spec, bins=16)
    codes = model.codes([data[c].to_numpy() for c in "abcd"])
    assert codes.max() < 16 and len(model.trees) == 13
    margin, trees = slow(codes, data[label].to_numpy(), spec, 16)
    for made, want in zip(model.trees, trees):
        for place, (value, feature, b) in want.items():
            assert made["value"][place] == pytest.approx(value, abs=1e-9)
            assert (made["feature"][place], made["bin"][place]) == ((-1, made["bin"][place]) if feature is None else (feature, b))
    got = {r.ts: r.prediction for r in model.transform(df).collect()}
    want = 1 / (1 + np.exp(-margin)) if objective == "logistic" else margin
    assert [got[i] for i in range(len(data))] == pytest.approx(want.tolist())


def test_models_of_one_table_equal_those_grown_alone(spark, frame):
    _, df = frame
    cuts = newton.quantile_cuts(df, list("abcd"), 16)
    specs = [
        newton.Spec("all", "y", tuple("abcd"), trees=3, depth=3, row_share=0.8, column_share=0.5),
        newton.Spec("early", "y", tuple("acd"), trees=2, depth=2, fold="fold", below=2),
        newton.Spec("logit", "z", tuple("db"), "logistic", trees=3, depth=2),
    ]
    table = newton.binned(df, list("abcd"), ["y", "z", "fold"], cuts)
    both = newton.Booster(table, list("abcd"), cuts, specs, 16)
    both.grow()
    for spec, made in zip(specs, both.models):
        alone = newton.Booster(newton.binned(df.repartition(7), list("abcd"), ["y", "z", "fold"], cuts), list("abcd"), cuts, [spec], 16).grow()[0]
        for a, b in zip(made.trees, alone.trees, strict=True):
            assert (a["feature"] == b["feature"]).all() and a["value"] == pytest.approx(b["value"])
    assert {r["model"]: r["n"] for r in both.predictions({"early": ("fold", 3), "all": ("fold", 1)}).groupBy("model").agg({"*": "count"}).toDF("model", "n").collect()} == {"early": 100, "all": 100}
    path = run_dir(spark, "trees")
    both.models[2].save(spark, path)
    back = newton.Ensemble.load(spark, path)
    one, two = ([r.prediction for r in m.transform(df).orderBy("ts").collect()] for m in (back, both.models[2]))
    assert one == two and back.inputs == ["d", "b"]


def test_missing_and_empty_rows(spark, frame):
    data, df = frame
    holes = df.selectExpr("asset_id", "ts", "CASE WHEN ts % 7 <> 0 THEN a END AS a", "b", "CASE WHEN ts % 5 <> 0 THEN y END AS y")
    spec = newton.Spec("m", "y", ("a", "b"), trees=1, depth=1)
    model = newton.fit(holes, spec, bins=8)
    known = data[(data.ts % 7 != 0) & (data.ts % 5 != 0)]
    assert model.base == pytest.approx(known.y.mean())
    none = newton.fit(holes.filter("ts < 0"), spec, bins=8)
    assert none.trees == [] and none.transform(df).filter("prediction <> 0").count() == 0


@pytest.mark.parametrize("rows, groups, tasks", [(1 << 16, 4, 1), (60, 1, 7)])
def test_a_large_table_is_scanned_once_for_all_models(frame, monkeypatch, rows, groups, tasks):
    """A table of one task needs models side by side to fill the cores; one of many tasks does not."""
    monkeypatch.setattr(newton, "TASK_ROWS", rows)
    _, df = frame
    cuts = newton.quantile_cuts(df, list("abcd"), 16)
    specs = [newton.Spec(f"m{k}", "y", tuple("abcd"), trees=1, depth=2, fold="fold", below=k) for k in range(1, 5)]
    booster = newton.Booster(newton.binned(df.repartition(9), list("abcd"), ["y", "fold"], cuts), list("abcd"), cuts, specs, 16)
    scans = []
    grow = newton.Booster._grow
    monkeypatch.setattr(newton.Booster, "_grow", lambda self: scans.append(len(self.specs)) or grow(self))
    assert all(len(m.trees) == 1 for m in booster.grow())
    assert (len(scans), sum(scans), booster.tasks) == (groups, 4, tasks)


def test_inputs_are_checked_once_for_all_models_of_a_batch():
    codes = np.array([[1, 2, 255], [3, 255, 4], [5, 6, 7]], np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([0.5, None, 1.5])], names=["__row", "__codes", "y"]).slice(1)
    rows = newton._Rows(batch, 3)
    assert (rows.codes == codes[1:]).all() and rows.whole(np.array([0, 2])).tolist() == [True, True] and rows.whole(np.array([0, 1])).tolist() == [False, True]
    assert rows.whole(np.array([0, 1])) is rows.whole(np.array([0, 1]))


def test_shuffles_of_a_chain_of_tables_go_with_their_job(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    write = lambda: spark.range(1000).repartition(3, "id").write.parquet(run_dir(spark, "freed"))
    before, setting = held(), spark.conf.get(name)
    write()
    assert held() == before + 1
    with shuffles_freed(spark):
        write()
    for _ in range(50):
        if held() == before + 1:
            break
        time.sleep(0.1)
    assert held() == before + 1 and spark.conf.get(name) == setting


def test_folds_of_the_grid_equal_the_plan(spark):
    """Numbered inside blocks and by one row per block, with gaps, several assets and rows without a future."""
    rng = np.random.default_rng(5)
    rows = [
        (asset, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal()))
        for asset, n in ((1, 130), (2, 37), (None, 20))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "asset_id int, ts timestamp, H2 double, CO double, a double")
    targets, horizons = ["H2", "CO"], {"x": 5, "y": 30}
    grid, inputs = ds.forecast_grid(df, targets, horizons, ["a", "H2"], 2, block_rows=16)
    grid = newton._written(grid, "grid")
    assert inputs == ["a", "H2", "CO", "H2_lag1", "H2_lag2", "CO_lag1", "CO_lag2"]
    for h in horizons:
        got = ds.grid_folds(grid, targets, h, 3, gap=2)
        known = grid.filter(f"H2_in_{h} IS NOT NULL OR CO_in_{h} IS NOT NULL")
        want = grid.join(ds.fold_plan(known, 3, 2).toDF("asset_id", "ts", f"fold_{h}", f"learns_{h}"), ["asset_id", "ts"], "left")
        names = ["asset_id", "ts", f"fold_{h}", f"learns_{h}"]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        one, two = (sorted((tuple(r) for r in x.select(names).collect()), key=key) for x in (got, want))
        assert one == two and len({r[2] for r in one}) == 5
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text  # the wide rows stay where they are
