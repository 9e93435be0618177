"""Hand-made frames with the expected values written out."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add
from ohmwatch.learning import datasets as ds
from ohmwatch.operators import cleaning as c
from ohmwatch.operators import sequences as s
from ohmwatch.operators import tables as t
from ohmwatch.operators.rolling import rolling_columns
from ohmwatch.operators.blocks import home_rows, with_halo
from ohmwatch.plans.features import gas_diagnostics

BLOCKS = [1, 2, 3, 8192]


def at(hour, minute):
    return dt.datetime(2024, 1, 1, hour, minute)


@pytest.mark.parametrize("block", BLOCKS)
def test_interpolation_edges(series, column, block):
    df = series({"x": [None, 1.0, None, None, 4.0, None]})
    assert column(c.interpolate(df, ["x"], block_rows=block), "x") == [None, 1, 2, 3, 4, 4]
    filled = c.fill_series(df, ["x"], [], block_rows=block)
    assert column(filled, "x") == [1, 1, 2, 3, 4, 4]


def test_means_do_not_depend_on_the_order_of_readings(spark):
    """The mean is 80, which is not above 80; 2 of the 24 plain sums are."""
    values = [81.2, 65.7, 44.8, 128.3]
    rows = [(i, at(0, m), v) for i, p in enumerate(itertools.permutations(values)) for m, v in enumerate(p)]
    df = spark.createDataFrame(rows, "asset_id int, ts timestamp_ntz, top_oil_temp double").coalesce(1)
    for parts in (df, df.repartition(7)):
        means = c.resample(parts)
        assert {r.top_oil_temp for r in means.collect()} == {80.0}
        assert t.above(means, "top_oil_temp", 80.0).count() == 0


def test_means_of_odd_values(spark):
    """Missing, infinite and huge values as in a plain mean; whole numbers too."""
    inf = float("inf")
    cells = [[(None, None, None)], [(inf, 1.5, 1), (1.0, None, 2)], [(1e300, 1e-300, 2), (-1e300, 1e-300, 5)], [(0.1, 3e9, 1), (0.2, 0.5, None)]]
    rows = [(i, at(0, m), *v) for i, own in enumerate(cells) for m, v in enumerate(own)]
    df = spark.createDataFrame(rows, "asset_id int, ts timestamp_ntz, x double, y float, n int")
    got = {r.asset_id: (r.x, r.y, r.n) for r in c.resample(df).collect()}
    assert got == {0: (None, None, None), 1: (inf, 1.5, 1.5), 2: (0.0, 0.0, 3.5), 3: ((0.1 + 0.2) / 2, (3e9 + 0.5) / 2, 1.0)}


@pytest.mark.parametrize("block", BLOCKS)
def test_fills_carry_across_blocks(series, column, block):
    df = series({"x": [None, 1.0, None, None, None, None, None, 2.0, None], "k": ["a"] + [None] * 7 + ["b"]})
    assert column(c.forward_fill(df, ["x"], block_rows=block), "x") == [None, 1, 1, 1, 1, 1, 1, 2, 2]
    assert column(c.backward_fill(df, ["x"], block_rows=block), "x") == [1, 1, 2, 2, 2, 2, 2, 2, None]
    assert column(c.forward_fill(df, ["k"], block_rows=block), "k") == ["a"] * 8 + ["b"]


def test_all_missing_column_stays_missing_and_kind_becomes_normal(series, column):
    df = series({"x": [None, None], "k": [None, None]}).withColumn("k", d_null("string"))
    filled = c.fill_series(df, ["x"], ["k"])
    assert column(filled, "x") == [None, None]
    assert column(filled, "k") == ["normal", "normal"]


def d_null(kind):
    from pyspark.sql import functions as F

    return F.lit(None).cast(kind)


def test_resample_mean_and_last(spark, column):
    rows = [
        (1, 0, at(0, 10), 1.0, "a"),
        (2, 0, at(0, 50), 2.0, None),
        (3, 0, at(2, 5), 3.0, "b"),
        (4, 0, at(2, 30), 4.0, None),
    ]
    df = spark.createDataFrame(rows, "reading_id int, asset_id int, ts timestamp_ntz, x double, k string")
    laid = c.on_grid(c.resample(df), df)
    assert column(laid, "ts") == [at(0, 0), at(1, 0), at(2, 0)]
    assert column(laid, "x") == [1.5, None, 3.5]
    assert column(laid, "k") == ["a", None, "b"]
    with pytest.raises(ValueError):
        c.resample(df, step=7 * 3600)


def test_keep_first_takes_lowest_reading(spark):
    rows = [(7, 0, at(0, 0), 1.0), (3, 0, at(0, 0), 2.0), (9, 1, at(0, 0), 3.0)]
    df = spark.createDataFrame(rows, "reading_id int, asset_id int, ts timestamp_ntz, x double")
    assert sorted(r.reading_id for r in c.keep_first(df).collect()) == [3, 9]


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("limit", [0, 48])
def test_rolling_minimum_count(series, column, block, limit):
    df = with_halo(series({"x": [1.0, None, 3.0, 4.0]}), back=2, block_rows=block)
    out = home_rows(rolling_columns(df, ["x"], (3,), ("mean",), need=2, sliding_limit=limit))
    assert column(out, "x_mean_3h") == [None, None, 2.0, 3.5]


@pytest.mark.parametrize("block", BLOCKS)
def test_running_sum_with_gap(series, column, block):
    df = series({"x": [1.0, None, 2.0]})
    assert column(s.cumulative(df, {"total": "x"}, block_rows=block), "total") == [1, None, 3]


def test_tdcg_counts_missing_as_zero(series, column):
    df = series({g: [None, 1.0] for g in ("H2", "CO", "C2H4", "CH4")})
    assert column(add(df, {"t": d.tdcg()}), "t") == [0, 4]


def test_risk_bounds(series, column):
    df = series({"health_score": [0.0, 1e-9, 40.0, 40.0001, 65.0, 65.0001, 100.0, None]})
    assert column(add(df, {"r": d.risk_level()}), "r") == [
        "CRITIQUE", "CRITIQUE", "CRITIQUE", "ALERTE", "ALERTE", "NORMAL", "NORMAL", None,
    ]


def test_severity_and_message(series):
    df = series({"H2": [150.0, 150.1, 195.0, 195.1, None]})
    got = [(r.value, r.severity, r.message) for r in t.alerts(df).orderBy("ts").collect()]
    assert got == [
        (150.1, "ALERTE", "H2 = 150.1 > seuil 150.0 (ALERTE)"),
        (195.0, "ALERTE", "H2 = 195.0 > seuil 150.0 (ALERTE)"),
        (195.1, "CRITIQUE", "H2 = 195.1 > seuil 150.0 (CRITIQUE)"),
    ]
    arrays = t.with_alerts(df).orderBy("ts").collect()
    assert [len(r.active_alerts) for r in arrays] == [0, 1, 1, 1, 0]
    assert arrays[3].active_alerts[0].message == got[2][2]


def gases(series, rows):
    names = ("CH4", "C2H4", "H2", "CO")
    return gas_diagnostics(series({n: [float(r[i]) for r in rows] for i, n in enumerate(names)}))


def test_duval_zones(series, column):
    rows = [
        (0, 0, 0, 0),  # nothing dissolved
        (0, 0, 50, 0),  # hydrogen only
        (50, 0, 0, 0),  # methane only
        (0, 50, 0, 0),  # ethylene only
        (60, 30, 10, 0),
        (30, 10, 60, 0),
        (50, 15, 35, 0),
        (45, 15, 40, 0),
        (80, 20, 0, 0),  # 80 % is not above 80 %
    ]
    out = gases(series, rows)
    assert column(out, "duval_zone") == ["DT", "PD", "T1", "T3", "T2", "D1", "D2", "D2", "DT"]
    assert column(out, "duval_zone_code") == [6, 0, 1, 3, 2, 4, 5, 5, 6]


def test_rogers_codes(series, column):
    rows = [
        (1, 3, 100, 0),  # low first ratio wins over a high third one
        (50, 10, 100, 0),
        (100, 10, 50, 0),
        (10, 20, 50, 0),
        (10, 40, 50, 0),
        (0, 0, 0, 0),
    ]
    assert column(gases(series, rows), "rogers_code") == [1, 0, 2, 3, 4, 1]


def test_health_index_needs_every_sensor(series, column):
    best = {"top_oil_temp": 40.0, "hot_spot_temp": 50.0, "H2": 0.0, "C2H4": 0.0, "CH4": 0.0, "CO": 0.0,
            "moisture_ppm": 0.0, "vibration_mms": 0.0}
    df = series({k: [v, 1e4, v, None if k == "CO" else v] for k, v in best.items()})
    assert column(add(df, {"h": d.health_index()}), "h") == [pytest.approx(100), 0, pytest.approx(100), None]


def test_clipped_formulas_keep_missing(series, column):
    df = series({"load_kva": [1500.0, 500.0, None], "hot_spot_temp": [98.0, 200.0, None]})
    out = add(df, {"o": d.overload(), "a": d.aging_factor()})
    assert column(out, "o") == [0.5, 0.0, None]
    assert column(out, "a") == [1.0, 50.0, None]


@pytest.mark.parametrize("n", [5, 7, 8, 50])
@pytest.mark.parametrize("block", [3, 20, 8192])
def test_label_tail(series, column, n, block):
    health = [float((i * 37) % 101) for i in range(n)]
    want = (
        pd.Series(health).rolling(7, min_periods=1).min().shift(-7).ffill() < 20
    ).astype(int)
    df = series({"health_index": health})
    got = s.failure_label(df, 7, 20.0, block_rows=block)
    assert column(got, "failure_label") == list(want)


@pytest.mark.parametrize("block", [4, 8192])
def test_folds(series, column, block):
    folded = ds.fold_numbers(series({"x": [float(i) for i in range(20)]}), 5, block_rows=block)
    assert column(folded, "fold") == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3
    assert ds.train_rows(folded, 3).count() == 11
    assert ds.train_rows(folded, 3, gap=2).count() == 9


@pytest.mark.parametrize("block", [3, 8192])
def test_split(series, column, block):
    marked = c.chronological_split(series({"x": [1.0] * 10}), 0.2, block_rows=block)
    assert column(marked, "part") == ["train"] * 8 + ["test"] * 2
    train, test = c.train_test(series({"x": [1.0] * 10}))
    assert (train.count(), test.count()) == (8, 2)


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_episodes_join_over_blocks(series, rows):
    kinds = ["a", "a", "normal", "b", "b", "b", "b", "a", "b", "normal", "normal", "a"]
    out = s.fault_episodes(series({"fault_type": kinds}), target_rows=rows).orderBy("start_ts")
    got = [(r.fault_type, r.start_ts.hour, r.end_ts.hour, r.n_rows) for r in out.collect()]
    assert got == [("a", 0, 1, 2), ("b", 3, 6, 4), ("a", 7, 7, 1), ("b", 8, 8, 1), ("a", 11, 11, 1)]


def test_intervals_include_both_ends_and_later_kinds_win(spark):
    rows = [(i, 0, at(i, 0)) for i in range(8)]
    df = spark.createDataFrame(rows, "reading_id int, asset_id int, ts timestamp_ntz")
    spans = spark.createDataFrame(
        [(0, "partial_discharge", at(1, 0), at(4, 0)), (0, "moisture_fault", at(3, 0), at(5, 0)),
         (0, "overheating", at(4, 0), at(4, 0)), (1, "overheating", at(0, 0), at(9, 0))],
        "asset_id int, fault_type string, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    got = {r.reading_id: r.fault_label for r in t.label_intervals(df, spans, 2 * 3600).collect()}
    assert got == {1: "partial_discharge", 2: "partial_discharge", 3: "moisture_fault",
                   4: "moisture_fault", 5: "moisture_fault"}


def test_overlapping_intervals_equal_brute_force_without_a_join(spark):
    rng = np.random.default_rng(3)
    kinds = ["partial_discharge", "overheating", "moisture_fault", "it's", "other"]
    priority = {"partial_discharge": 1, "overheating": 2, "moisture_fault": 3}
    minute = dt.timedelta(minutes=1)
    spans = [(int(rng.integers(2)), kinds[rng.integers(5)], at(0, 0) + int(s) * minute, at(0, 0) + int(s + n) * minute)
             for s, n in zip(rng.integers(0, 9000, 300), rng.integers(-5, 400, 300))]
    rows = [(i, i % 3, at(0, 0) + int(m) * minute) for i, m in enumerate(rng.integers(0, 9000, 600))]
    df = spark.createDataFrame(rows, "reading_id int, asset_id int, ts timestamp_ntz")
    table = spark.createDataFrame(spans, "asset_id int, fault_type string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    found = t.label_intervals(df, table)
    want = {}
    for i, asset, ts in rows:
        over = [(priority.get(k, 0), k) for a, k, lo, hi in spans if a == asset and lo <= ts <= hi]
        if over:
            want[i] = max(over)[1]
    assert {r.reading_id: r.fault_label for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert t.label_intervals(df, table.limit(0)).count() == 0


def test_validation(series):
    df = series({"load_kva": [-1.0, 0.0, 1500.0, 1501.0, None], "H2": [1.0] * 5})
    assert [tuple(r) for r in c.bound_violations(df).collect()] == [("load_kva", 2)]
    masked = c.mask_bounds(df).orderBy("ts").collect()
    assert [r.load_kva for r in masked] == [None, 0, 1500, None, None]
    with pytest.raises(ValueError, match="ambient_temp"):
        c.require_columns(df)
    assert c.split_columns(df) == (["load_kva", "H2"], [])
