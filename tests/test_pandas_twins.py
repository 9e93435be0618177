"""Random series against pandas, for several block sizes."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from ohmwatch.config import REQUIRED
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import nan_to_null
from ohmwatch.operators import cleaning as c
from ohmwatch.operators import sequences as s
from ohmwatch.operators.rolling import per_asset_rolling, rolling
from ohmwatch.plans.features import build_features, feature_columns
from ohmwatch.plans.prepare import clean, prepare

N = 400
START = dt.datetime(2023, 12, 20)


def gappy(seed, n=N, share=0.1):
    rng = np.random.default_rng(seed)
    values = rng.normal(50, 20, n).round(3)
    values[rng.random(n) < share] = np.nan
    return values


@pytest.fixture(scope="module")
def frame():
    parts = []
    for asset, n in ((0, N), (1, N // 2), (2, 5)):
        index = pd.date_range(START + dt.timedelta(hours=asset * 13), periods=n, freq="h")
        part = pd.DataFrame({"asset_id": asset, "ts": index, "x": gappy(asset, n), "y": gappy(9 + asset, n, 0)})
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, frame):
    return nan_to_null(spark.createDataFrame(frame)).cache()


def compare(df, frame, columns, tolerance=1e-9):
    got = df.toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True)
    assert len(got) == len(frame)
    for name, want in columns.items():
        a, b = got[name].astype(float).to_numpy(), want.astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), name
        assert np.nanmax(np.abs(a - b), initial=0) < tolerance, name


def by_asset(frame, column, fn):
    return frame.groupby("asset_id", group_keys=False)[column].apply(fn)


@pytest.mark.parametrize("block", [7, 50, 8192])
def test_fill(table, frame, block):
    out = c.fill_series(table, ["x"], [], block_rows=block)
    want = pd.concat(
        [g.set_index("ts").x.interpolate(method="time").ffill().bfill() for _, g in frame.groupby("asset_id")]
    )
    compare(out, frame, {"x": want})


@pytest.mark.parametrize("block,limit", [(30, 0), (64, 48), (8192, 0), (8192, 1000)])
def test_rolling(table, frame, block, limit):
    out = rolling(table, ["x", "y"], (5, 72), block_rows=block, sliding_limit=limit)
    want = {}
    for w in (5, 72):
        for col in ("x", "y"):
            for stat in ("mean", "std", "max"):
                want[f"{col}_{stat}_{w}h"] = by_asset(
                    frame, col, lambda v: getattr(v.rolling(w, min_periods=max(1, w // 4)), stat)()
                )
    compare(out, frame, want, 1e-8)


def test_scans_are_exact_on_level_shifts(series):
    """Flat stretches at different levels must show no spread at all."""
    values = [1000.0] * 60 + [0.1] * 60 + [1e6] * 60
    out = rolling(series({"x": values}), ["x"], (20,), sliding_limit=0).orderBy("ts").toPandas()
    flat = out.x_std_20h[19:60].tolist() + out.x_std_20h[79:120].tolist() + out.x_std_20h[139:].tolist()
    assert max(flat) < 1e-12


def test_block_form_equals_plain_window(table):
    a = rolling(table, ["y"], (30,), block_rows=16, sliding_limit=0).toPandas()
    b = per_asset_rolling(table, ["y"], (30,)).toPandas()
    keys = ["asset_id", "ts"]
    a, b = (x.sort_values(keys).reset_index(drop=True)[list(a.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


@pytest.mark.parametrize("block", [16, 8192])
def test_changes_lags_future(table, frame, block):
    out = s.rate_of_change(table, ["x"], (1, 24), block_rows=block)
    compare(out, frame, {f"x_roc_{p}h": by_asset(frame, "x", lambda v: v.diff(p)) for p in (1, 24)})
    out = s.lags_and_future(table, "y", 3, 30, block_rows=block)
    want = {f"y_lag{k}": by_asset(frame, "y", lambda v: v.shift(k)) for k in (1, 2, 3)}
    want["future_target"] = by_asset(frame, "y", lambda v: v.shift(-30))
    compare(out, frame, want)


@pytest.mark.parametrize("block", [16, 8192])
def test_cumulative(table, frame, block):
    out = s.cumulative(table, {"total": "x"}, block_rows=block)
    compare(out, frame, {"total": by_asset(frame, "x", lambda v: v.cumsum())}, 1e-8)


@pytest.mark.parametrize("block", [50, 300, 8192])
@pytest.mark.parametrize("window", [20, 72])
def test_label(table, frame, block, window):
    out = s.failure_label(table, window, 10.0, "y", block_rows=block)
    want = by_asset(
        frame, "y", lambda v: (v.rolling(window, min_periods=1).min().shift(-window).ffill() < 10).astype(int)
    )
    compare(out, frame, {"failure_label": want})


@pytest.mark.parametrize("block", [64, 2048])
def test_expected_oil(spark, block):
    rng = np.random.default_rng(3)
    n = 700
    load, ambient = rng.uniform(100, 1400, n), rng.uniform(-15, 35, n)
    x = ambient + 55 * (load / 1000) ** 1.6
    y = [x[0]]
    for v in x[1:]:
        y.append(0.85 * y[-1] + 0.15 * v)
    rows = [(0, START + dt.timedelta(hours=i), float(load[i]), float(ambient[i]), 60.0) for i in range(n)]
    df = spark.createDataFrame(
        rows, "asset_id int, ts timestamp_ntz, load_kva double, ambient_temp double, top_oil_temp double"
    )
    got = s.expected_oil(df, block_rows=block).orderBy("ts").toPandas().expected_oil_temp
    assert np.abs(got.to_numpy() - np.array(y)).max() < 1e-10


def raw_readings(n, seed, start=START):
    """Irregular readings with duplicates, gaps and impossible values."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, n * 3600, 2 * n))
    data = {"reading_id": np.arange(2 * n), "asset_id": 0, "ts": [start + dt.timedelta(seconds=int(a)) for a in at]}
    data |= {c: rng.uniform(1, 100, 2 * n).round(2) for c in REQUIRED}
    data["load_kva"] = rng.uniform(-50, 1600, 2 * n).round(1)
    data["fault_type"] = rng.choice(["normal", "overheating"], 2 * n)
    return pd.DataFrame(data)


def pandas_clean(raw):
    from ohmwatch.config import BOUNDS

    df = raw.copy()
    for col, (lo, hi) in BOUNDS.items():
        df.loc[(df[col] < lo) | (df[col] > hi), col] = np.nan
    df = df.sort_values(["ts", "reading_id"]).drop_duplicates("ts").set_index("ts")
    numbers = df[list(REQUIRED)].resample("1h").mean().interpolate(method="time").ffill().bfill()
    kinds = df[["fault_type"]].resample("1h").last().ffill().bfill()
    return pd.concat([numbers, kinds], axis=1)


def test_prepare_and_features_at_default_size(spark):
    """Default windows (168, 720) and label window on 1,500 hours of one asset."""
    raw = raw_readings(1500, 5)
    want = pandas_clean(raw)
    series = prepare(spark.createDataFrame(raw), block_rows=400).cache()
    got = series.orderBy("ts").toPandas()
    assert (got.ts.to_numpy() == want.index.to_numpy()).all()
    assert (got.fault_type.to_numpy() == want.fault_type.to_numpy()).all()
    for col in REQUIRED:
        assert np.abs(got[col].to_numpy() - want[col].to_numpy()).max() < 1e-9

    wide = build_features(series, block_rows=1000)
    assert len(feature_columns(wide)) == 108
    feats = wide.orderBy("ts").toPandas()
    for col in ("H2", "load_kva"):
        for w in (168, 720):
            frame = want[col].rolling(w, min_periods=w // 4)
            for stat in ("mean", "std", "max"):
                expected = getattr(frame, stat)().ffill().bfill().to_numpy()
                assert np.abs(feats[f"{col}_{stat}_{w}h"].to_numpy() - expected).max() < 1e-8
    for p in (1, 24, 168):
        expected = want["CO"].diff(p).ffill().bfill().to_numpy()
        assert np.abs(feats[f"CO_roc_{p}h"].to_numpy() - expected).max() < 1e-9
    overload = (want.load_kva / 1000 - 1).clip(lower=0).cumsum().to_numpy()
    assert np.abs(feats.cumulative_overload.to_numpy() - overload).max() < 1e-9
    aging = np.exp((want.hot_spot_temp - 98) / 6).clip(upper=50).cumsum().to_numpy()
    assert np.abs(feats.cumulative_aging.to_numpy() / aging - 1).max() < 1e-9
    shares = feats[["duval_pct_CH4", "duval_pct_C2H4", "duval_pct_H2"]].sum(axis=1)
    assert (shares - 100).abs().max() < 1e-6
    assert (feats.cumulative_aging.diff().dropna() >= 0).all()
    series.unpersist()


def test_label_at_default_window(series):
    rng = np.random.default_rng(1)
    health = rng.uniform(49.9, 100, 1500)
    want = (pd.Series(health).rolling(720, min_periods=1).min().shift(-720).ffill() < 50).astype(int)
    got = s.failure_label(series({"health_index": [float(h) for h in health]}), block_rows=333)
    assert got.orderBy("ts").toPandas().failure_label.tolist() == want.tolist()
    assert d.health_index().startswith("CASE")


@pytest.mark.parametrize("block", [50, 8192])
def test_features_fill_any_gap_whatever_the_block(series, block):
    """A hole of 12 hours, a sensor that starts after 150 of 200 hours, one that ends early."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({c: rng.uniform(10, 60, 200).round(3) for c in REQUIRED})
    frame.loc[60:71, "H2"] = np.nan
    frame.loc[:149, "CO"] = np.nan
    frame.loc[:9, "load_kva"] = frame.loc[120:, "load_kva"] = np.nan
    cells = {c: [None if np.isnan(v) else float(v) for v in frame[c]] for c in frame}
    wide = build_features(series(cells), (4, 24), (1, 24), block_rows=block)
    got = wide.orderBy("ts").toPandas()
    want = frame.copy()
    for c in ("H2", "CO", "load_kva"):
        for w in (4, 24):
            moving = frame[c].rolling(w, min_periods=w // 4)
            for stat in ("mean", "std", "max"):
                want[f"{c}_{stat}_{w}h"] = getattr(moving, stat)()
    for p in (1, 24):
        want[f"CO_roc_{p}h"] = frame.CO.diff(p)
    want["load_ratio"] = frame.load_kva / 1000
    want["cumulative_overload"] = (frame.load_kva / 1000 - 1).clip(lower=0).cumsum()
    want["cumulative_aging"] = np.exp((frame.hot_spot_temp - 98) / 6).clip(upper=50).cumsum()
    want = want.ffill().bfill()
    assert not got.isna().any().any()
    for c in want:
        assert np.abs(got[c].to_numpy() - want[c].to_numpy()).max() < 1e-8, c


@pytest.mark.parametrize("step, rule", [(2 * 86400, "2D"), (7 * 86400, "7D"), (5 * 3600, "5h"), ("month", "MS"), (6 * 3600, "6h")])
@pytest.mark.parametrize("block", [4, 8192])
def test_any_resample_step(spark, step, rule, block):
    """Means, last kinds, empty buckets and lines over them, on two assets that begin on one day."""
    rng = np.random.default_rng(17)
    parts = []
    for asset, days in ((0, 400), (1, 150)):
        minutes = np.sort(rng.choice(days * 1440, 300, replace=False))
        minutes = minutes[(minutes < days * 400) | (minutes > days * 800)]  # a long pause
        ts = [dt.datetime(2023, 11, 29) + dt.timedelta(minutes=int(x)) for x in [30 + asset, *minutes]]
        x = np.where(rng.random(len(ts)) < 0.2, np.nan, rng.normal(50, 20, len(ts)))
        parts.append(pd.DataFrame({"asset_id": asset, "reading_id": range(len(ts)), "ts": ts, "x": x, "fault_type": rng.choice(["a", "b"], len(ts))}))
    frame = pd.concat(parts, ignore_index=True)
    df = nan_to_null(spark.createDataFrame(frame))
    got = clean(df, step, block).toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True)
    want = []
    for asset, own in frame.groupby("asset_id"):
        laid = own.set_index("ts").resample(rule)
        x = laid["x"].mean().interpolate("time").ffill().bfill()
        kind = laid["fault_type"].last().ffill().bfill()
        want.append(pd.DataFrame({"asset_id": asset, "ts": x.index, "x": x.values, "fault_type": kind.values}))
    want = pd.concat(want, ignore_index=True)
    assert got["ts"].tolist() == want["ts"].tolist() and got["fault_type"].tolist() == want["fault_type"].tolist()
    assert got["x"].to_numpy() == pytest.approx(want["x"].to_numpy())


def test_bad_steps_are_refused(table):
    for step in (0, -5, "week"):
        with pytest.raises(ValueError, match="step"):
            c.resample(table, step)
