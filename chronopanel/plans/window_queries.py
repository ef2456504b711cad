"""Time-series features over the sparse supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import features, split
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import DATE, ENTITY, KEYS, q, to_long

SP = with_views("sp")
Q = ["quantity", "revenue"]
W = "(PARTITION BY Country ORDER BY Date)"


def frame(n: int) -> str:
    return f"(PARTITION BY Country ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _panel(spark, sf):
    return views.sparse(spark, sf)


def per_column(pattern: str, columns=Q) -> str:
    return ", ".join(pattern.replace("@", c) for c in columns)


def _features(df, *names: str):
    return df.select(*KEYS, *[q(n) for n in names])


SLOPE = "coalesce(CASE WHEN lag({x}, {k}) OVER w <> 0 THEN {x} / lag({x}, {k}) OVER w END - 1, 0)"


@query(
    "win1_slope",
    f"{SP} SELECT Country, Date, {per_column(SLOPE.format(x='@', k=2) + ' AS @_slope')} FROM sp WINDOW w AS {W}",
    approx=["quantity_slope", "revenue_slope"],
)
def slope(spark, sf):
    return _features(features.slope(_panel(spark, sf), Q, window=3), "quantity_slope", "revenue_slope")


@query(
    "win2_acceleration",
    f"""{SP}, s AS (SELECT Country, Date, {per_column(SLOPE.format(x='@', k=1) + ' AS @')} FROM sp WINDOW w AS {W})
SELECT Country, Date, {per_column(SLOPE.format(x='@', k=1) + ' AS @_slope_acc')} FROM s WINDOW w AS {W}""",
    approx=["quantity_slope_acc", "revenue_slope_acc"],
    digits=4,
)
def acceleration(spark, sf):
    return _features(features.acceleration(_panel(spark, sf), Q), "quantity_slope_acc", "revenue_slope_acc")


STAT_SQL = {"mean": "avg(@)", "std": "stddev_samp(@)", "min": "min(@)", "max": "max(@)"}
ROLL = [f"{c}_rolling_{n}_{s}" for c in Q for n in (3, 6) for s in STAT_SQL]


@query(
    "win3_rolling",
    f"{SP} SELECT Country, Date, "
    + ", ".join(f"coalesce({e.replace('@', c)} OVER w{n}, 0) AS {c}_rolling_{n}_{s}" for c in Q for n in (3, 6) for s, e in STAT_SQL.items())
    + f" FROM sp WINDOW w3 AS {frame(3)}, w6 AS {frame(6)}",
    approx=ROLL,
    digits=4,
)
def rolling(spark, sf):
    return _features(features.rolling(_panel(spark, sf), Q), *ROLL)


@query(
    "win4_rolling_median",
    f"{SP} SELECT Country, Date, {per_column('coalesce(median(@) OVER w, 0) AS @_rolling_6_median')} FROM sp WINDOW w AS {frame(6)}",
    approx=["quantity_rolling_6_median", "revenue_rolling_6_median"],
)
def rolling_median(spark, sf):
    return _features(features.rolling(_panel(spark, sf), Q, 6, ["median"]), "quantity_rolling_6_median", "revenue_rolling_6_median")


# Moments about the frame mean, from lists, independent of any skewness function.
MOMENTS = """x AS (SELECT Country, Date, list_filter(list(quantity) OVER w, lambda v: v IS NOT NULL) AS v FROM sp WINDOW w AS {w}),
m AS (SELECT Country, Date, len(v) AS n, list_avg(v) AS mu, v FROM x),
d AS (SELECT Country, Date, n, list_sum(list_transform(v, lambda a: pow(a - mu, 2))) / n AS m2, list_sum(list_transform(v, lambda a: pow(a - mu, 3))) / n AS m3,
  list_sum(list_transform(v, lambda a: pow(a - mu, 4))) / n AS m4 FROM m)"""


@query(
    "win5_rolling_skew",
    f"""{SP}, {MOMENTS.format(w=frame(6))} SELECT Country, Date, CASE WHEN n >= 3 AND m2 > 0 THEN m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) ELSE 0 END AS quantity_rolling_6_skew FROM d""",
    approx=["quantity_rolling_6_skew"],
    digits=4,
)
def rolling_skew(spark, sf):
    return _features(features.rolling(_panel(spark, sf), ["quantity"], 6, ["skew"]), "quantity_rolling_6_skew")


@query(
    "win6_rolling_kurt",
    f"""{SP}, {MOMENTS.format(w=frame(12))} SELECT Country, Date, CASE WHEN n >= 4 AND m2 > 0 THEN ((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1.0) / ((n - 2) * (n - 3)) ELSE 0 END AS quantity_rolling_12_kurt FROM d""",
    approx=["quantity_rolling_12_kurt"],
    digits=4,
)
def rolling_kurt(spark, sf):
    return _features(features.rolling(_panel(spark, sf), ["quantity"], 12, ["kurt"]), "quantity_rolling_12_kurt")


EXCEED = """coalesce((count(@) OVER w = 6 AND @ > max(@) OVER w * 0.9)::INT, 0) + coalesce((count(@) OVER w = 6 AND @ < min(@) OVER w * (2 - 0.9::DOUBLE))::INT, 0)"""


@query(
    "win7_exceedance",
    f"""{SP} SELECT Country, Date, {per_column('CAST(' + EXCEED + ' AS DOUBLE) AS "@_exceeds_0.9"', ['revenue', 'lines'])} FROM sp WINDOW w AS {frame(6)}""",
)
def exceedance(spark, sf):
    return _features(features.exceedance(_panel(spark, sf), ["revenue", "lines"], window=6), "revenue_exceeds_0.9", "lines_exceeds_0.9")


# Weighted means as explicit sums over the past of a series, not as a recursion.
# With adjust off the weight of a value is fixed when it is superseded, so the
# recursive form is written as a recursive query.
EWM = """r AS (SELECT Country, Date, quantity AS x, row_number() OVER (PARTITION BY Country ORDER BY Date) AS rn FROM sp),
e AS (SELECT Country, rn, Date, x AS y, CASE WHEN x IS NULL THEN NULL ELSE 1.0::DOUBLE END AS old FROM r WHERE rn = 1
  UNION ALL SELECT r.Country, r.rn, r.Date,
    CASE WHEN e.y IS NULL THEN r.x WHEN r.x IS NULL THEN e.y ELSE (e.old * {keep} * e.y + {new} * r.x) / (e.old * {keep} + {new}) END,
    CASE WHEN e.y IS NULL THEN CASE WHEN r.x IS NULL THEN NULL ELSE 1.0 END WHEN r.x IS NULL THEN e.old * {keep} ELSE {after} END
  FROM e JOIN r ON r.Country = e.Country AND r.rn = e.rn + 1)"""


@query(
    "win8_ewm",
    f"""{SP.replace('WITH ', 'WITH RECURSIVE ', 1)}, {EWM.format(keep='(1 - 2.0::DOUBLE / 7)', new='(2.0::DOUBLE / 7)', after='1.0')}
SELECT Country, Date, coalesce(y, 0) AS quantity_ewm_6 FROM e""",
    approx=["quantity_ewm_6"],
)
def ewm(spark, sf):
    return _features(features.ewm(_panel(spark, sf), ["quantity"], 6), "quantity_ewm_6")


@query(
    "win9_dist_mean",
    f"""{SP} SELECT Country, Date, {per_column('coalesce((@ - avg(@) OVER w) / (stddev_samp(@) OVER w + 1e-8), 0) AS @_dist_mean', ['quantity'])}
FROM sp WINDOW w AS (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    approx=["quantity_dist_mean"],
)
def dist_mean(spark, sf):
    return _features(features.dist_mean(_panel(spark, sf), ["quantity"]), "quantity_dist_mean")


@query(
    "win10_lag",
    f"{SP} SELECT Country, Date, " + ", ".join(f"coalesce(lag({c}, {k}) OVER w, 0) AS {c}_lag_{k}" for c in Q for k in (1, 3, 6)) + f" FROM sp WINDOW w AS {W}",
)
def lag(spark, sf):
    return _features(features.lag(_panel(spark, sf), Q), *[f"{c}_lag_{k}" for c in Q for k in (1, 3, 6)])


@query(
    "win11_momentum",
    f"{SP} SELECT Country, Date, {per_column('coalesce((@ - avg(@) OVER w) / (abs(avg(@) OVER w) + 1e-8), 0) AS @_momentum_3')} FROM sp WINDOW w AS {frame(3)}",
    approx=["quantity_momentum_3", "revenue_momentum_3"],
)
def momentum(spark, sf):
    return _features(features.momentum(_panel(spark, sf), Q), "quantity_momentum_3", "revenue_momentum_3")


@query(
    "win12_volatility",
    f"{SP} SELECT Country, Date, {per_column('coalesce(stddev_samp(@) OVER w / (avg(@) OVER w + 1e-8), 0) AS @_volatility_3')} FROM sp WINDOW w AS {frame(3)}",
    approx=["quantity_volatility_3", "revenue_volatility_3"],
)
def volatility(spark, sf):
    return _features(features.volatility(_panel(spark, sf), Q), "quantity_volatility_3", "revenue_volatility_3")


SEASON = """r AS (SELECT Country, Date, lines AS x, row_number() OVER w - 1 AS i, count(lines) OVER p AS valid, count(*) OVER p AS n, min(lines) OVER p AS lowest,
  0.5 * lag(lines, 6) OVER w + 0.5 * lead(lines, 6) OVER w AS ends, sum(lines) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mid
  FROM sp WINDOW w AS (PARTITION BY Country ORDER BY Date), p AS (PARTITION BY Country)),
t AS (SELECT *, CASE WHEN valid = n AND n >= 24 {ok} THEN (ends + mid) / 12 END AS trend FROM r),
d AS (SELECT *, {detrended} AS d FROM t),
ph AS (SELECT Country, i % 12 AS phase, avg(d) AS m FROM d GROUP BY 1, 2), ce AS (SELECT Country, avg(m) AS c FROM ph GROUP BY 1)
SELECT d.Country, d.Date, coalesce(trend, 0) AS lines_seasonal_trend, coalesce({residual}, 0) AS lines_seasonal_residual
FROM d JOIN ph ON ph.Country = d.Country AND ph.phase = d.i % 12 JOIN ce ON ce.Country = d.Country"""
SEASON_NAMES = ["lines_seasonal_trend", "lines_seasonal_residual"]


@query("win13_win14_seasonal_additive", f"{SP}, {SEASON.format(ok='', detrended='x - trend', residual='d - (m - c)')}", approx=SEASON_NAMES)
def seasonal(spark, sf):
    return _features(features.seasonal(_panel(spark, sf), ["lines"]), *SEASON_NAMES)


@query(
    "win14_seasonal_multiplicative",
    f"{SP}, {SEASON.format(ok='AND lowest > 0', detrended='x / trend', residual='d / (m / c)')}",
    approx=SEASON_NAMES,
)
def seasonal_multiplicative(spark, sf):
    return _features(features.seasonal(_panel(spark, sf), ["lines"], model="multiplicative"), *SEASON_NAMES)


@query(
    "win15_rolling_volatility",
    f"{SP} SELECT Country, Date, {per_column('CASE WHEN count(@) OVER w = 3 THEN stddev_samp(@) OVER w END AS @_3_year_volatility')} FROM sp WINDOW w AS {frame(3)}",
    approx=["quantity_3_year_volatility", "revenue_3_year_volatility"],
    digits=4,
)
def rolling_volatility(spark, sf):
    return _features(features.rolling_volatility(_panel(spark, sf), Q), "quantity_3_year_volatility", "revenue_3_year_volatility")


@query(
    "win16_ma_momentum",
    f"""{SP} SELECT Country, Date, {per_column('CASE WHEN count(@) OVER a = 2 THEN avg(@) OVER a END - CASE WHEN count(@) OVER b = 4 THEN avg(@) OVER b END AS @_momentum')}
FROM sp WINDOW a AS {frame(2)}, b AS {frame(4)}""",
    approx=["quantity_momentum", "revenue_momentum"],
)
def ma_momentum(spark, sf):
    return _features(features.ma_momentum(_panel(spark, sf), Q), "quantity_momentum", "revenue_momentum")


@query(
    "win17_ewma",
    f"""{SP}, r AS (SELECT Country, Date, quantity AS x, row_number() OVER {W} AS rn FROM sp)
SELECT a.Country, a.Date, sum(pow(0.7::DOUBLE, a.rn - b.rn) * b.x) / sum(CASE WHEN b.x IS NOT NULL THEN pow(0.7::DOUBLE, a.rn - b.rn) END) AS quantity_ewma_3
FROM r a JOIN r b ON a.Country = b.Country AND b.rn <= a.rn GROUP BY 1, 2""",
    approx=["quantity_ewma_3"],
)
def ewma(spark, sf):
    return _features(features.ewma(_panel(spark, sf), ["quantity"], [0.3]), "quantity_ewma_3")


@query(
    "win18_global_avg",
    f"{SP} SELECT Country, Date, {per_column('avg(@) OVER (PARTITION BY Date) AS @_global_avg')} FROM sp",
    approx=["quantity_global_avg", "revenue_global_avg"],
)
def global_avg(spark, sf):
    return _features(features.global_average(_panel(spark, sf), Q), "quantity_global_avg", "revenue_global_avg")


@query(
    "win15_18_engineer_features",
    f"""{SP}, r AS (SELECT *, row_number() OVER {W} AS rn FROM sp), e AS (SELECT a.Country, a.Date,
  """
    + ", ".join(
        f"sum(pow({1 - a}::DOUBLE, a.rn - b.rn) * b.lines) / sum(CASE WHEN b.lines IS NOT NULL THEN pow({1 - a}::DOUBLE, a.rn - b.rn) END) AS lines_ewma_{n}"
        for a, n in ((0.1, 1), (0.3, 3), (0.7, 7))
    )
    + f""" FROM r a JOIN r b ON a.Country = b.Country AND b.rn <= a.rn GROUP BY 1, 2),
g AS (SELECT Country, Date, CASE WHEN count(lines) OVER c = 3 THEN stddev_samp(lines) OVER c END AS lines_3_year_volatility,
  CASE WHEN count(lines) OVER a = 2 THEN avg(lines) OVER a END - CASE WHEN count(lines) OVER b = 4 THEN avg(lines) OVER b END AS lines_momentum,
  avg(lines) OVER (PARTITION BY Date) AS lines_global_avg FROM sp WINDOW a AS {frame(2)}, b AS {frame(4)}, c AS {frame(3)})
SELECT g.*, lines_ewma_1, lines_ewma_3, lines_ewma_7 FROM g JOIN e USING (Country, Date)""",
    approx=["lines_3_year_volatility", "lines_momentum", "lines_global_avg", "lines_ewma_1", "lines_ewma_3", "lines_ewma_7"],
)
def engineer(spark, sf):
    return features.engineer_features(_panel(spark, sf).select(*KEYS, "lines"), ["lines"])


BAR_FRAME = "(PARTITION BY ticker ORDER BY Date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(
    "win19_win22_market",
    f"""{with_views('bars')}, c AS (SELECT *, CASE WHEN lag(Close) OVER w <> 0 THEN Close / lag(Close) OVER w - 1 END AS chg FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY Date))
SELECT ticker, Date, Open, High, Low, Close, max(Close) OVER y AS "52WeekHigh", min(Close) OVER y AS "52WeekLow", Close >= max(Close) OVER y AS NewHigh, Close <= min(Close) OVER y AS NewLow,
  High - Low AS HighLowDiff, Close - Open AS CloseOpenDiff, CASE WHEN count(chg) OVER m = 21 THEN stddev_samp(chg) OVER m END * sqrt(252) AS Volatility
FROM c WINDOW y AS {BAR_FRAME.format(251)}, m AS {BAR_FRAME.format(20)}""",
    approx=["HighLowDiff", "CloseOpenDiff", "Volatility"],
)
def market(spark, sf):
    return features.market_features(views.price_bars(spark, sf))


@query(
    "win39_temporal_continuity",
    f"""{SP}, s AS (SELECT Country, Date, coalesce(avg(quantity) OVER {frame(6)}, 0) AS quantity_rolling_6_mean FROM sp)
SELECT Country, Date, quantity_rolling_6_mean FROM s WHERE Date > DATE '1999-06-30'""",
    approx=["quantity_rolling_6_mean"],
)
def continuity(spark, sf):
    """Test features of a temporal split read training rows before the cut."""
    cut = split.split_cutoff(_panel(spark, sf), "1999-06-30")
    out = features.rolling(cut, ["quantity"], 6, ["mean"], by=features.split_keys("temporal"))
    return _features(out.where("split = 'test'"), "quantity_rolling_6_mean")


@query(
    "win39_separate_sets",
    f"""{SP}, s AS (SELECT Country, Date, coalesce(avg(quantity) OVER (PARTITION BY Country, Date > DATE '1999-06-30' ORDER BY Date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS quantity_rolling_6_mean FROM sp)
SELECT Country, Date, quantity_rolling_6_mean FROM s""",
    approx=["quantity_rolling_6_mean"],
)
def separate(spark, sf):
    cut = split.split_cutoff(_panel(spark, sf), "1999-06-30")
    return _features(features.rolling(cut, ["quantity"], 6, ["mean"], by=features.split_keys("geographic")), "quantity_rolling_6_mean")


@query(
    "win_rolling_long_form",
    f"""{SP}, lng AS (SELECT Country, Date, 'quantity' AS variable, quantity AS value FROM sp UNION ALL SELECT Country, Date, 'revenue', revenue FROM sp UNION ALL SELECT Country, Date, 'lines', lines FROM sp)
SELECT Country, Date, variable, coalesce(avg(value) OVER (PARTITION BY Country, variable ORDER BY Date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS value_rolling_3_mean FROM lng""",
    approx=["value_rolling_3_mean"],
)
def rolling_long(spark, sf):
    """The same operator on the long form: one more key, any number of variables."""
    long = to_long(_panel(spark, sf))
    return features.rolling(long, ["value"], 3, ["mean"], by=(ENTITY, "variable")).select(*KEYS, "variable", "value_rolling_3_mean")


@query(
    "win40_detrend_rolling",
    f"{SP} SELECT Country, Date, quantity - avg(quantity) OVER w AS quantity FROM sp WINDOW w AS {frame(12)}",
    approx=["quantity"],
)
def detrend_rolling(spark, sf):
    return features.detrend(_panel(spark, sf).select(*KEYS, "quantity"), ["quantity"], window_size=36)


@query(
    "win41_detrend_differencing",
    f"{SP} SELECT Country, Date, coalesce(quantity - lag(quantity) OVER w, 0) AS quantity FROM sp WINDOW w AS {W}",
)
def detrend_differencing(spark, sf):
    """A window too small for a rolling mean falls back to differences."""
    return features.detrend(_panel(spark, sf).select(*KEYS, "quantity"), ["quantity"], window_size=4)


@query(
    "win42_detrend_linear",
    f"""{SP}, r AS (SELECT Country, Date, quantity, CAST(row_number() OVER {W} - 1 AS DOUBLE) AS x, last_value(quantity IGNORE NULLS) OVER (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM sp),
f AS (SELECT Country, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM r GROUP BY 1) SELECT Country, Date, quantity - (s * x + i) AS quantity FROM r JOIN f USING (Country)""",
    approx=["quantity"],
)
def detrend_linear(spark, sf):
    return features.detrend(_panel(spark, sf).select(*KEYS, "quantity"), ["quantity"], "linear_detrend")


SEASONLESS = """r AS (SELECT Country, Date, {x} AS raw, row_number() OVER (PARTITION BY Country ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY Country) AS n,
  last_value({x} IGNORE NULLS) OVER (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM {src})
SELECT Country, Date, CASE WHEN n >= 24 THEN y - avg(y) OVER (PARTITION BY Country, i % 12) ELSE raw END AS {x} FROM r"""


@query("win43_deseasonalise", f"{SP}, {SEASONLESS.format(x='quantity', src='sp')}", approx=["quantity"])
def deseasonalise(spark, sf):
    return features.deseasonalise(_panel(spark, sf).select(*KEYS, "quantity"), ["quantity"])


@query(
    "win44_prepare_series",
    f"""{SP}, a AS (SELECT Country, Date, coalesce(last_value(quantity IGNORE NULLS) OVER (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS q FROM sp),
b AS (SELECT Country, Date, (q - avg(q) OVER p) / CASE WHEN stddev_pop(q) OVER p > 0 THEN stddev_pop(q) OVER p ELSE 1 END AS q FROM a WINDOW p AS (PARTITION BY Country)),
c AS (SELECT Country, Date, q - avg(q) OVER {frame(12)} AS quantity FROM b), {SEASONLESS.format(x='quantity', src='c')}""",
    approx=["quantity"],
)
def prepare(spark, sf):
    return features.prepare_series(_panel(spark, sf).select(*KEYS, "quantity"), ["quantity"])


SEQ = """f AS (SELECT Country, Date, coalesce(last_value(quantity IGNORE NULLS) OVER u, 0) AS a, coalesce(last_value(revenue IGNORE NULLS) OVER u, 0) AS b FROM sp
  WINDOW u AS (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT Country, Date, list(a) OVER k AS a, list(b) OVER k AS b, list(Date) OVER k AS d FROM f WINDOW k AS (PARTITION BY Country ORDER BY Date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


@query(
    "win35_sequences",
    f"""{SP}, {SEQ} SELECT Country, Date, list_aggregate(list_transform(a, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS xs, list_sum(b) AS total FROM s WHERE len(a) = 6""",
    approx=["total"],
    digits=3,
)
def sequences(spark, sf):
    runs = features.sequences(_panel(spark, sf), Q, length=6, consecutive=False)
    xs = F.transform("sequence", lambda r: r["features"][0].cast("long").cast("string"))
    total = F.aggregate("sequence", F.lit(0.0), lambda s, r: s + r["features"][1])
    return runs.select(*KEYS, F.array_join(xs, ",").alias("xs"), total.alias("total"))


@query(
    "win36_consecutive_dates",
    f"""{SP}, thin AS (SELECT * FROM sp), g AS (SELECT Country, Date, date_diff('day', lag(Date) OVER w, Date) AS gap, row_number() OVER w AS rn FROM thin WINDOW w AS {W}),
p AS (SELECT a.Country, a.Date, b.gap FROM g a JOIN g b ON a.Country = b.Country AND b.rn BETWEEN a.rn - 4 AND a.rn AND a.rn >= 6),
c AS (SELECT Country, Date, gap, count(*) AS n FROM p GROUP BY 1, 2, 3), m AS (SELECT Country, Date, gap AS mode FROM c QUALIFY row_number() OVER (PARTITION BY Country, Date ORDER BY n DESC, gap) = 1),
t AS (SELECT *, CASE WHEN mode = 1 THEN 1 WHEN mode BETWEEN 28 AND 31 THEN 3 WHEN mode BETWEEN 89 AND 92 THEN 3 WHEN mode BETWEEN 365 AND 366 THEN 1 ELSE greatest(1, mode // 10) END AS tol FROM m)
SELECT p.Country, p.Date FROM p JOIN t ON p.Country = t.Country AND p.Date = t.Date GROUP BY 1, 2 HAVING bool_and(abs(p.gap - t.mode) <= t.tol)""",
)
def consecutive(spark, sf):
    """Runs over missing months are not evenly spaced and fall away."""
    thin = _panel(spark, sf)
    return features.sequences(thin, Q, length=6).select(*KEYS)


@query(
    "jn12_sequence_labels",
    f"""{with_views('lnm')}, s AS (SELECT Country, Date, label, row_number() OVER {W} AS rn FROM lnm) SELECT Country, Date, label FROM s WHERE rn >= 12""",
)
def sequence_labels(spark, sf):
    """A sequence carries the label of its last row."""
    rows = views.labelled(spark, sf)
    return features.sequences(rows, ["total", "orders"], 12, label="label", consecutive=False).select(*KEYS, "label")


@query(
    "win38_history_tail",
    f"""{SP}, c AS (SELECT Country, Date, quantity, Date > DATE '1999-06-30' AS late FROM sp) SELECT Country, Date, quantity FROM c WHERE late
UNION ALL (SELECT Country, Date, quantity FROM c WHERE NOT late QUALIFY row_number() OVER (PARTITION BY Country ORDER BY Date DESC) <= 11)""",
)
def history_tail(spark, sf):
    rows = _panel(spark, sf).select(*KEYS, "quantity")
    return features.history_tail(rows.where(F.col(DATE) <= "1999-06-30"), rows.where(F.col(DATE) > "1999-06-30"))
