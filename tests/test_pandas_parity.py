"""Feature definitions against pandas on gappy series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import aggregate, features, fill

DATES = pd.date_range("2010-01-31", periods=60, freq="ME")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    frames = []
    for c in "ABC":
        x = np.round(rng.normal(10, 4, len(DATES)), 2)
        x[rng.random(len(x)) < 0.25] = np.nan
        if c == "B":
            x[:5] = np.nan
        if c == "C":
            x[10:16] = 3.0
        frames.append(pd.DataFrame({"Country": c, "Date": DATES.date, "x": x, "full": rng.normal(5, 1, len(DATES)) + 5}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf, "Country STRING, Date DATE, x DOUBLE, full DOUBLE")
    return pdf, df.withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).cache()


def compare(pdf, df, name, fn, column="x"):
    got = df.toPandas().sort_values(["Country", "Date"])[name].to_numpy(dtype=float)
    want = pdf.groupby("Country")[column].transform(fn).to_numpy(dtype=float)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span", [3, 12])
def test_ewm(panel, span):
    pdf, df = panel
    compare(pdf, features.ewm(df, ["x"], span), f"x_ewm_{span}", lambda s: s.ewm(span=span, adjust=False).mean().fillna(0))


@pytest.mark.parametrize("alpha", [0.1, 0.7])
def test_ewma(panel, alpha):
    pdf, df = panel
    compare(pdf, features.ewma(df, ["x"], [alpha]), f"x_ewma_{int(alpha * 10)}", lambda s: s.ewm(alpha=alpha).mean())


@pytest.mark.parametrize("stat", ["mean", "std", "min", "max", "median"])
@pytest.mark.parametrize("window", [3, 6])
def test_rolling(panel, stat, window):
    pdf, df = panel
    compare(pdf, features.rolling(df, ["x"], window, [stat]), f"x_rolling_{window}_{stat}", lambda s: getattr(s.rolling(window, min_periods=1), stat)().fillna(0))


@pytest.mark.parametrize("stat, least", [("skew", 3), ("kurt", 4)])
@pytest.mark.parametrize("window", [6, 12])
def test_moments(panel, stat, least, window):
    """Away from constant frames, where the two libraries define different limits."""
    pdf, df = panel
    pdf, df = pdf[pdf.Country != "C"], df.where("Country <> 'C'")
    compare(pdf, features.rolling(df, ["x"], window, [stat]), f"x_rolling_{window}_{stat}", lambda s: getattr(s.rolling(window, min_periods=min(window, least)), stat)().fillna(0))


def test_slope_and_lag(panel):
    pdf, df = panel
    compare(pdf, features.slope(df, ["x"], 3), "x_slope", lambda s: s.pct_change(periods=2, fill_method=None).fillna(0))
    compare(pdf, features.lag(df, ["x"], 3), "x_lag_3", lambda s: s.shift(3).fillna(0))


def test_distance_momentum_volatility(panel):
    pdf, df = panel
    compare(pdf, features.dist_mean(df, ["x"]), "x_dist_mean", lambda s: ((s - s.expanding().mean()) / (s.expanding().std() + 1e-8)).fillna(0))

    def momentum(s):
        ma = s.rolling(3, min_periods=1).mean()
        return ((s - ma) / (ma.abs() + 1e-8)).fillna(0)

    compare(pdf, features.momentum(df, ["x"]), "x_momentum_3", momentum)

    def volatility(s):
        r = s.rolling(3, min_periods=1)
        return (r.std() / (r.mean() + 1e-8)).fillna(0)

    compare(pdf, features.volatility(df, ["x"]), "x_volatility_3", volatility)


def test_exceedance(panel):
    pdf, df = panel

    def exceed(s):
        r = s.rolling(6, min_periods=6)
        return (s > r.max() * 0.9).astype(int) + (s < r.min() * (2 - 0.9)).astype(int)

    compare(pdf, features.exceedance(df, ["full"], 6), "full_exceeds_0.9", exceed, "full")
    compare(pdf, features.exceedance(df, ["x"], 6), "x_exceeds_0.9", exceed)


def decompose(s, model):
    """Classical decomposition, written out for one complete series."""
    x = s.to_numpy()
    weights = np.r_[0.5, np.ones(11), 0.5] / 12
    trend = np.full(len(x), np.nan)
    trend[6:-6] = np.convolve(x, weights, mode="valid")
    detrended = x - trend if model == "additive" else x / trend
    phase = np.array([np.nanmean(detrended[i::12]) for i in range(12)])
    phase = phase - phase.mean() if model == "additive" else phase / phase.mean()
    seasonal = np.tile(phase, len(x) // 12 + 1)[: len(x)]
    resid = detrended - seasonal if model == "additive" else detrended / seasonal
    return np.nan_to_num(trend), np.nan_to_num(resid)


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_seasonal(panel, model):
    pdf, df = panel
    out = features.seasonal(df, ["full", "x"], model)
    compare(pdf, out, "full_seasonal_trend", lambda s: decompose(s, model)[0], "full")
    compare(pdf, out, "full_seasonal_residual", lambda s: decompose(s, model)[1], "full")
    assert out.where("x_seasonal_trend <> 0 OR x_seasonal_residual <> 0").count() == 0


def test_forward_fill(panel):
    pdf, df = panel
    compare(pdf, fill.forward_fill(df, 2, latest_only=False, columns=["x"]), "x", lambda s: s.ffill(limit=2))

    def latest(s):
        last = s.last_valid_index()
        out = s.copy()
        out.loc[last:] = out.loc[last:].ffill(limit=2)
        return out

    tail = df.withColumn("x", F.when(F.col("Date") < "2014-06-30", F.col("x")))
    cut = pdf.assign(x=pdf.x.where(pd.to_datetime(pdf.Date) < "2014-06-30"))
    compare(cut, fill.forward_fill(tail, 2, columns=["x"]), "x", latest)


def test_resample_last_carries_whole_rows(panel):
    pdf, df = panel
    thin_pdf = pdf[(pd.to_datetime(pdf.Date).dt.month % 5) != 0]
    thin = df.where(F.month("Date") % 5 != 0)
    got = aggregate.resample(thin, "M", complete=False).toPandas().sort_values(["Country", "Date"])
    want = (
        thin_pdf.assign(Date=pd.to_datetime(thin_pdf.Date)).set_index("Date").groupby("Country")[["x", "full"]].resample("ME").ffill().reset_index()
    )
    np.testing.assert_allclose(got[["x", "full"]].to_numpy(dtype=float), want[["x", "full"]].to_numpy(dtype=float))
    assert list(got["Date"]) == [d.date() for d in want["Date"]]


def test_resample_stats_in_empty_periods(panel):
    pdf, df = panel
    thin_pdf = pdf[(pd.to_datetime(pdf.Date).dt.year % 2) != 0].reset_index(drop=True)
    thin = df.where(F.year("Date") % 2 != 0)
    got = aggregate.resample(thin, "Q", {"sum": ["x"], "mean": ["full"]}, complete=False).toPandas().sort_values(["Country", "Date"])
    grouped = thin_pdf.assign(Date=pd.to_datetime(thin_pdf.Date)).groupby("Country").resample("QE", on="Date")
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), grouped["x"].sum().to_numpy())
    np.testing.assert_allclose(got["full"].to_numpy(dtype=float), grouped["full"].mean().to_numpy())


def test_resample_rejects_unknown_statistics(panel):
    with pytest.raises(ValueError):
        aggregate.resample(panel[1], "M", {"first": ["x"]})
