"""Skew, plans and rank statistics."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohmwatch.learning import evaluation as ev
from ohmwatch.operators import blocks as b
from ohmwatch.operators import cleaning as c
from ohmwatch.operators import tables as t
from ohmwatch.operators.quantiles import auc, quantiles
from ohmwatch.operators.rolling import rolling
from ohmwatch.plans.prepare import prepare
from ohmwatch.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    return query.executedPlan().toString()


@pytest.fixture(scope="module")
def readings(spark, sf):
    return fixtures.readings(spark, sf)


def test_attach_by_broadcast_and_by_shuffle(spark):
    """User 0 holds a third of all rows; the others hold one row each."""
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) AS asset_id", "id AS x")
    small = rows.selectExpr("asset_id", "asset_id * 2 AS y").distinct().filter("asset_id <> 1")
    for how, n in (("inner", 8999), ("left", 9000)):
        a = b.attach(rows, small, how=how)
        z = b.attach(rows, small, how=how, limit=10)
        assert "BroadcastHashJoin" in plan(a) and "BroadcastHint" not in plan(z)
        assert a.exceptAll(z).count() == 0 and a.count() == z.count() == n


def test_rolling_needs_one_shuffle(readings):
    """All nine columns, both windows, three statistics: one exchange of the series."""
    series = c.resample(readings).drop("fault_type")
    path_free = series.sparkSession.createDataFrame(series.limit(0).toPandas().astype({"asset_id": "int"}), series.schema)
    text = plan(rolling(path_free, windows=(24, 168)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "SinglePartition" not in text


def test_no_window_without_partition(readings):
    for df in (prepare(readings), t.latest(readings), b.row_index(readings)):
        assert "SinglePartition" not in plan(df)


def test_latest_and_first_copy_cut_before_the_shuffle(readings):
    for df in (t.latest(readings), c.keep_first(readings)):
        text = plan(df)
        first = text[text.index("Exchange hashpartitioning") :]
        assert "WindowGroupLimit" in first


def test_filters_and_columns_reach_the_scan(readings):
    text = plan(t.above(readings, "ambient_temp", 20.0).select("asset_id", "ts"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "value" not in schema


def test_row_index_equals_plain_numbering(readings):
    got = b.row_index(readings, block_rows=5).select("reading_id", "__rn", "__n").toPandas()
    raw = readings.select("reading_id", "asset_id", "ts").toPandas().sort_values(["asset_id", "ts", "reading_id"])
    raw["rn"] = raw.groupby("asset_id").cumcount() + 1
    raw["n"] = raw.groupby("asset_id").reading_id.transform("size")
    both = raw.merge(got, on="reading_id")
    assert (both.rn == both["__rn"]).all() and (both.n == both["__n"]).all()


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], n), "v": rng.normal(size=n).round(2)})
    got = quantiles(spark.createDataFrame(frame), ("g",), "v", {"q": 0.25, "m": 0.5, "z": 0.99}).toPandas()
    for row in got.itertuples():
        want = frame[frame.g == row.g].v.quantile([0.25, 0.5, 0.99]).tolist()
        assert [row.q, row.m, row.z] == pytest.approx(want, abs=1e-12)
    assert set(got.g) == set(frame.g)


def test_quantiles_with_one_value_holding_most_rows(spark):
    frame = pd.DataFrame({"v": [5.0] * 900 + list(np.arange(100.0))})
    got = quantiles(spark.createDataFrame(frame), (), "v", {"q": 0.25, "m": 0.5}).first()
    assert [got.q, got.m] == frame.v.quantile([0.25, 0.5]).tolist()


def test_quantiles_of_many_rows_look_at_few_values(spark):
    """Brackets hold some ten-thousandths of the rows; whatever lies in them is ranked whole or by blocks."""
    df = spark.range(300_000).selectExpr("if(id % 3 = 0, 'a', 'b') AS g", "CAST((id * 7919) % 300007 AS DOUBLE) / 7 AS v")
    frame = df.toPandas()
    wanted = {"q": 0.25, "m": 0.5, "z": 0.9999, "least": 0.0, "most": 1.0}
    for inside in (10**6, 3000, 10):
        got = {r.g: r for r in quantiles(df, ("g",), "v", wanted, inside=inside).collect()}
        for g, own in frame.groupby("g"):
            assert [got[g][n] for n in wanted] == pytest.approx(own.v.quantile(list(wanted.values())).tolist(), abs=1e-9)


def test_auc_of_many_small_groups(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS g", "CAST(id DIV 20000 = 1 AS INT) AS y", "CAST((id * 31) % 97 AS DOUBLE) AS s")
    got = auc(df, ("g",), "s", "y")
    frame = df.toPandas()
    found = {r.g: r.auc for r in got.collect()}
    assert len(found) == 20_000
    for g in (0, 1, 777, 19_999):
        own = frame[frame.g == g]
        assert found[g] == pytest.approx(brute_auc(own.y.to_numpy(), own.s.to_numpy()))


def test_a_burst_gets_blocks_of_its_own(spark):
    """20,000 rows of one hour, 3,000 of one second and a sparse year: no block over twice the target but that second."""
    burst = "timestamp_ntz'2024-05-01' + make_dt_interval(0, 0, 0, CAST({} AS DECIMAL(18,6)))"
    df = spark.range(20_000).selectExpr("0 AS asset_id", f"{burst.format('id * 0.18')} AS ts")
    df = df.union(spark.range(3000).selectExpr("0", "timestamp_ntz'2024-05-01 12:00:00'"))
    df = df.union(spark.range(900).selectExpr("id % 2", burst.format("id * 30000")))
    df = df.withColumn("reading_id", F.monotonically_increasing_id())
    blocks = b.density_blocks(df, 500).groupBy("asset_id", "__block").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert sorted(r.n for r in blocks)[-1] == 3000 and sorted(r.n for r in blocks)[-2] <= 1000
    for asset in (0, 1):
        own = sorted((r for r in blocks if r.asset_id == asset), key=lambda r: r["__block"])
        assert all(p.hi <= q.lo for p, q in zip(own, own[1:]))
    indexed = b.row_index(df, block_rows=500, dense=True)
    got = [r["__rn"] for r in indexed.filter("asset_id = 0").orderBy("ts", "reading_id").collect()]
    assert got == list(range(1, 23_451))


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos)
    return wins / len(pos) / len(neg)


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"fold": [1] * 500 + [2] * 5, "y": list(rng.integers(0, 2, 500)) + [1] * 5})
    frame["s"] = (rng.random(505) * 20).round() / 20 + 0.2 * frame.y
    got = {r.fold: r.auc for r in auc(spark.createDataFrame(frame), ("fold",), "s", "y").collect()}
    one = frame[frame.fold == 1]
    assert got[1] == pytest.approx(brute_auc(one.y.to_numpy(), one.s.to_numpy()))
    assert got[2] is None


def test_report_without_rows_or_positives(spark):
    rows = spark.createDataFrame([(0, 0, 0.1)] * 3, "y_true int, y_pred int, failure_proba double")
    assert ev.f1_and_auc(rows).first().f1 == 0.0
    report = {r["class"]: r for r in ev.classification_report(rows).collect()}
    assert report["1"].precision == 0.0 and report["accuracy"].f1 == 1.0
    assert sorted(report) == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert "accuracy" not in {r["class"] for r in ev.report_table(ev.classification_report(rows)).collect()}
    assert ev.classification_report(rows.limit(0)).count() == 0
    assert ev.confusion_matrix(rows).count() == 4


def test_hot_asset_series_equals_small_blocks(spark):
    """One asset holds nearly all rows; block size must not change the result."""
    hot = spark.range(30_000).selectExpr(
        "CAST(if(id % 50 = 0, 1 + id % 3, 0) AS INT) AS asset_id",
        "id AS reading_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 613) AS ts",
        "if(id % 7 = 0, NULL, CAST((id * 37) % 101 AS DOUBLE)) AS x",
        "if(id % 11 = 0, 'overheating', 'normal') AS fault_type",
    )
    a = prepare(hot, strict=False).collect()
    z = prepare(hot, block_rows=100, strict=False).collect()
    key = lambda r: (r.asset_id, r.ts)
    for p, q in zip(sorted(a, key=key), sorted(z, key=key), strict=True):
        assert key(p) == key(q) and p.fault_type == q.fault_type and p.x == pytest.approx(q.x)
