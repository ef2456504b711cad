"""Imputation without look-ahead over the sparse panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import fill, impute, joins
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import DATE, ENTITY, KEYS, cut_lineage, series

SPN = with_views("spn")
C = ["total", "orders"]

# Brute force: every target against every earlier row, features unpivoted.
KNN = """t AS (SELECT row_number() OVER (ORDER BY Country, Date) AS id, * FROM {source}),
l AS (SELECT id, Country, Date, 't' AS f, total AS v FROM t UNION ALL SELECT id, Country, Date, 'o', orders FROM t UNION ALL SELECT id, Country, Date, 'm', mean_price FROM t),
tg AS (SELECT id, Country, Date FROM t WHERE total IS NULL OR orders IS NULL),
fx AS (SELECT tg.id, tg.Date, l.f, l.v, count(*) OVER (PARTITION BY tg.id) AS nf FROM tg JOIN l ON l.id = tg.id WHERE l.v IS NOT NULL),
pr AS (SELECT fx.id, h.id AS hid, fx.f, fx.v AS tv, h.v AS hv, fx.nf FROM fx JOIN l h ON h.f = fx.f AND h.v IS NOT NULL AND h.Date <= fx.Date AND h.id <> fx.id),
cm AS (SELECT *, count(*) OVER (PARTITION BY id, hid) AS have FROM pr), ok AS (SELECT * FROM cm WHERE have = nf),
sc AS (SELECT id, f, quantile_cont(hv, 0.75) - quantile_cont(hv, 0.25) AS iqr FROM ok GROUP BY 1, 2),
ds AS (SELECT ok.id, ok.hid, {distance} AS d FROM ok JOIN sc ON sc.id = ok.id AND sc.f = ok.f GROUP BY 1, 2),
nn AS (SELECT ds.*, h.total, h.orders FROM ds JOIN t h ON h.id = ds.hid QUALIFY row_number() OVER (PARTITION BY ds.id ORDER BY d, h.Country, h.Date) <= {k}),
im AS (SELECT id, sum(total / (d + 1e-8)) / sum(CASE WHEN total IS NOT NULL THEN 1 / (d + 1e-8) END) AS total, sum(orders / (d + 1e-8)) / sum(CASE WHEN orders IS NOT NULL THEN 1 / (d + 1e-8) END) AS orders FROM nn GROUP BY 1)
SELECT t.Country, t.Date, coalesce(t.total, im.total) AS total, coalesce(t.orders, im.orders) AS orders, t.mean_price FROM t LEFT JOIN im ON im.id = t.id"""
# The same pass for interior gaps only: what it fills before the first or after the last value is taken back.
INTERIOR = """SELECT r.Country, r.Date, CASE WHEN b.total IS NULL AND NOT (r.Date > g.lo AND r.Date < g.hi) THEN NULL ELSE r.total END AS total,
  CASE WHEN b.orders IS NULL AND NOT (r.Date > g.lo2 AND r.Date < g.hi2) THEN NULL ELSE r.orders END AS orders, r.mean_price
FROM (WITH {knn}) r JOIN {source} b ON b.Country = r.Country AND b.Date = r.Date
JOIN (SELECT Country, min(CASE WHEN total IS NOT NULL THEN Date END) AS lo, max(CASE WHEN total IS NOT NULL THEN Date END) AS hi,
  min(CASE WHEN orders IS NOT NULL THEN Date END) AS lo2, max(CASE WHEN orders IS NOT NULL THEN Date END) AS hi2 FROM {source} GROUP BY 1) g ON g.Country = r.Country"""
SPREAD = "CASE WHEN iqr = 0 THEN 1 ELSE iqr END"
EUCLID = f"sqrt(sum(pow((hv - tv) / {SPREAD}, 2)))"
MANHATTAN = f"sum(abs(hv - tv) / {SPREAD})"




def _knn_sql(source="spn", distance=EUCLID, k=5) -> str:
    return KNN.format(source=source, distance=distance, k=k)


@query("jn10_imp1_knn_euclidean", f"{SPN}, {_knn_sql()}", approx=C, digits=3)
def knn(spark, sf):
    return impute.knn_impute(views.sparse_nation(spark, sf), C)


@query("imp1_knn_manhattan", f"{SPN}, {_knn_sql(distance=MANHATTAN)}", approx=C, digits=3)
def knn_manhattan(spark, sf):
    return impute.knn_impute(views.sparse_nation(spark, sf), C, metric="manhattan")


@query("imp1_knn_masked", f"{SPN} {INTERIOR.format(source='spn', knn=_knn_sql())}", approx=C, digits=3)
def knn_masked(spark, sf):
    """Interior gaps only."""
    panel = views.sparse_nation(spark, sf)
    return impute.knn_impute(panel, C, mask=fill.imputation_mask(panel, C))


# The panel that grows with the tables: quantities from the suppliers and months most like them in revenue and lines.
@query(
    "imp1_knn_supplier",
    f"""{with_views('sp')}, t AS (SELECT row_number() OVER (ORDER BY Country, Date) AS id, * FROM sp),
tg AS (SELECT * FROM t WHERE quantity IS NULL AND (revenue IS NOT NULL OR lines IS NOT NULL)),
pr AS (SELECT g.id, h.id AS hid, h.quantity, g.revenue AS r, g.lines AS n, h.revenue AS hr, h.lines AS hn FROM tg g JOIN t h
  ON h.Date <= g.Date AND h.id <> g.id AND (g.revenue IS NULL OR h.revenue IS NOT NULL) AND (g.lines IS NULL OR h.lines IS NOT NULL)),
sc AS (SELECT id, quantile_cont(CASE WHEN r IS NOT NULL THEN hr END, [0.25, 0.75]) AS qr, quantile_cont(CASE WHEN n IS NOT NULL THEN hn END, [0.25, 0.75]) AS qn FROM pr GROUP BY id),
sp2 AS (SELECT id, CASE WHEN qr[2] - qr[1] = 0 THEN 1 ELSE qr[2] - qr[1] END AS sr, CASE WHEN qn[2] - qn[1] = 0 THEN 1 ELSE qn[2] - qn[1] END AS sn FROM sc),
ds AS (SELECT pr.id, pr.hid, pr.quantity, coalesce(abs(hr - r) / sr, 0) + coalesce(abs(hn - n) / sn, 0) AS d FROM pr JOIN sp2 ON sp2.id = pr.id),
nn AS (SELECT ds.* FROM ds JOIN t h ON h.id = ds.hid QUALIFY row_number() OVER (PARTITION BY ds.id ORDER BY d, h.Country, h.Date) <= 5),
im AS (SELECT id, sum(quantity / (d + 1e-8)) / sum(CASE WHEN quantity IS NOT NULL THEN 1 / (d + 1e-8) END) AS quantity FROM nn GROUP BY 1)
SELECT t.Country, t.Date, coalesce(t.quantity, im.quantity) AS quantity, t.revenue, t.lines FROM t LEFT JOIN im ON im.id = t.id""",
    approx=["quantity"],
    digits=3,
)
def knn_supplier(spark, sf):
    return impute.knn_impute(views.sparse(spark, sf), ["quantity"], metric="manhattan")


@query(
    "jn10_history_join",
    f"""{SPN} SELECT a.Country, a.Date, count(*) AS n, sum(h.orders) AS orders, max(h.Date) AS latest
FROM spn a JOIN spn h ON h.Date <= a.Date AND NOT (h.Country = a.Country AND h.Date = a.Date) WHERE a.total IS NULL GROUP BY 1, 2""",
)
def history(spark, sf):
    """What is known of other rows up to the date of every row without a total."""
    panel = views.sparse_nation(spark, sf)
    met = joins.history_join(panel.where("total IS NULL").select(*KEYS), panel.select(*KEYS, "orders"), "quarter")
    return met.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("history.orders").alias("orders"), F.max(f"history.{DATE}").alias("latest"))


# Two passes, the second on what the first has filled.
@query(
    "imp2_knn_two_stages",
    f"{SPN}, one AS ({INTERIOR.format(source='spn', knn=_knn_sql(distance=MANHATTAN))}), {_knn_sql('one', MANHATTAN, 3)}",
    approx=C,
    digits=2,
)
def knn_two_stages(spark, sf):
    return impute.knn_impute_staged(views.sparse_nation(spark, sf), [("interior", 5), ("all", 3)], C, metric="manhattan")


@query("imp2_knn_staged")
def knn_staged(spark, sf):
    """Interior, trailing, leading, then all gaps, with three nations as donors."""
    panel = views.sparse_nation(spark, sf)
    donors = panel.where(F.col(ENTITY).isin("CHINA", "INDIA", "JAPAN"))
    rest = panel.where(~F.col(ENTITY).isin("CHINA", "INDIA", "JAPAN"))
    stages = [("interior", 5), ("trailing", 5), ("leading", 3), ("all", 3)]
    return impute.knn_impute_staged(rest, stages, C, donors=donors, metric="manhattan")


@query("imp3_forecast_fill")
def forecast_fill(spark, sf):
    return impute.forecast_fill(views.sparse(spark, sf), ["quantity", "revenue", "lines"])


# Forecasting changes nothing that was known, and reads no leading gap.
@query(
    "imp3_forecast_keeps_values",
    f"""{with_views('sp')}, f AS (SELECT Country, min(CASE WHEN quantity IS NOT NULL THEN Date END) AS lo FROM sp GROUP BY 1)
SELECT count(*) AS n, count(quantity) AS known, sum(CASE WHEN sp.Date < f.lo OR f.lo IS NULL THEN 1 ELSE 0 END)::BIGINT AS leading FROM sp JOIN f ON f.Country = sp.Country""",
)
def forecast_keeps(spark, sf):
    panel = views.sparse(spark, sf).select(*KEYS, "quantity")
    done = impute.forecast_fill(panel, ["quantity"]).select(*KEYS, F.col("quantity").alias("filled"))
    both = panel.join(done, list(KEYS))
    first = panel.groupBy(ENTITY).agg(F.min(F.when(F.col("quantity").isNotNull(), F.col(DATE))).alias("lo"))
    marked = both.join(first, ENTITY)
    early = (F.col(DATE) < F.col("lo")) | F.col("lo").isNull()
    return marked.agg(
        F.count("*").alias("n"),
        F.sum((F.col("quantity") == F.col("filled")).cast("long")).alias("known"),
        F.sum((early & F.col("filled").isNull()).cast("long")).alias("leading"),
    )


# Cells before the first value stay empty, and a gap after a constant start takes the constant, once six values are known.
@query(
    "imp3_forecast_leading",
    f"""{with_views('sm')}, s AS (SELECT Country, Date, year(Date) * 12 + month(Date) - 1 - 1995 * 12 AS mo, k % 9 + 2 AS lead_in FROM sm),
n AS (SELECT Country, count(*) FILTER (WHERE mo BETWEEN lead_in AND 24) AS known FROM s GROUP BY 1)
SELECT s.Country, s.Date, CASE WHEN mo > 24 AND known >= 6 THEN 5.0::DOUBLE END AS lines FROM s JOIN n ON n.Country = s.Country
WHERE mo < lead_in OR mo BETWEEN 25 AND 27""",
)
def forecast_leading(spark, sf):
    at = F.year(DATE) * 12 + F.month(DATE) - 1 - 1995 * 12
    lead_in = F.col("k") % 9 + 2
    start = F.when((at >= lead_in) & (at <= 24), F.lit(5.0)).when((at > 27) & (at % 5 != 0), F.col("lines"))
    marked = views.supplier_month(spark, sf).select(*KEYS, start.alias("lines"), ((at < lead_in) | at.between(25, 27)).alias("shown"))
    done = impute.forecast_fill(marked.select(*KEYS, "lines"), ["lines"])
    return done.join(marked.where("shown").select(*KEYS), list(KEYS))


# A series that follows an autoregression exactly, of another level and pace per supplier, is continued exactly.
EXACT_SQL = f"""{with_views('sm')}, s AS (SELECT Country, Date, k, row_number() OVER (PARTITION BY Country ORDER BY Date) - 1 AS t FROM sm)
SELECT Country, Date, 100 + k + (40 + k % 7) * pow(0.7 + (k % 5) / 50.0, t) AS v FROM s WHERE t >= 30 AND t < 36"""


@query("imp3_forecast_exact", EXACT_SQL, approx=["v"], digits=2)
def forecast_exact(spark, sf):
    k = F.col("k")
    t = F.row_number().over(series()) - 1
    panel = views.supplier_month(spark, sf).select(*KEYS, "k", t.alias("t"))
    value = 100 + k + (40 + k % 7) * F.pow(0.7 + (k % 5) / 50.0, F.col("t"))
    gaps = panel.select(*KEYS, F.when(F.col("t") < 30, value).alias("v"))
    done = impute.forecast_fill(gaps, ["v"])
    return done.join(panel.where("t >= 30 AND t < 36").select(*KEYS), list(KEYS))


@query("imp4_regression_impute")
def regression_impute(spark, sf):
    return impute.regression_impute(views.sparse(spark, sf), ["quantity", "revenue", "lines"])


@query("imp4_trees")
def trees_impute(spark, sf):
    """Regression trees of all dates, grown together."""
    return impute.regression_impute(views.sparse(spark, sf), ["quantity", "revenue", "lines"], estimator="trees")


# The target is a step of another variable: trees over earlier dates restore it.
@query(
    "imp4_trees_step",
    f"""{with_views('nm')}, b AS (SELECT *, CASE WHEN orders > 8 THEN 10 ELSE 2 END AS y, dense_rank() OVER (ORDER BY Date) AS d FROM nm)
SELECT Country, Date, CAST(y AS DOUBLE) AS y FROM b WHERE d > 24""",
    approx=["y"],
)
def trees_step(spark, sf):
    panel = views.nation_month(spark, sf).select(*KEYS, (F.col("orders") > 8).cast("double").alias("high"))
    first = panel.agg(F.min(DATE)).scalar()
    m = F.year(DATE) * 12 + F.month(DATE)
    known = (m % 3 != 0) | (F.months_between(DATE, first) < 23.5)
    gaps = panel.select(*KEYS, "high", F.when(known, 2 + 8 * F.col("high")).alias("y"))
    done = impute.regression_impute(gaps, ["y"], features=["high"], estimator="trees")
    late = done.select(*KEYS, "y", F.months_between(DATE, first).alias("m")).where("m > 23.5")
    return late.select(*KEYS, "y")


def _kept(before, after, columns):
    """Rows, known cells that stayed as they were, and cells that were filled."""
    renamed = after.select(*KEYS, *[F.col(c).alias(f"{c}_after") for c in columns])
    lost = [F.count(F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_after")), 1)) for c in columns]
    return before.join(renamed, list(KEYS)).agg(
        F.count("*").alias("n"),
        sum(lost[1:], lost[0]).alias("changed"),
        *[F.count(F.when(F.col(c).isNull() & F.col(f"{c}_after").isNotNull(), 1)).alias(f"filled_{c}") for c in columns],
    )


# Every gap with any earlier row of its own date or before, in another row, can be filled.
@query(
    "imp2_knn_staged_keeps_values",
    f"""{SPN} SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM spn WHERE Country NOT IN ('CHINA', 'INDIA', 'JAPAN')""",
)
def knn_staged_keeps(spark, sf):
    panel = views.sparse_nation(spark, sf)
    rest = panel.where(~F.col(ENTITY).isin("CHINA", "INDIA", "JAPAN"))
    return _kept(rest, knn_staged(spark, sf), C).select("n", "changed")


# The target is an exact linear function of another variable: a regression on earlier dates restores it.
@query(
    "imp4_regression_linear",
    f"""{with_views('nm')}, b AS (SELECT *, 3 * orders + 7 AS y, dense_rank() OVER (ORDER BY Date) AS d FROM nm)
SELECT Country, Date, CAST(y AS DOUBLE) AS y FROM b WHERE d > 24""",
    approx=["y"],
    digits=1,
)
def regression_linear(spark, sf):
    panel = views.nation_month(spark, sf).select(*KEYS, "orders", (F.col("orders") * 3 + 7).alias("y"))
    first = panel.agg(F.min(DATE)).scalar()
    m = F.year(DATE) * 12 + F.month(DATE)
    gaps = panel.select(*KEYS, "orders", F.when((m % 3 != 0) | (F.months_between(DATE, first) < 23.5), F.col("y")).alias("y"))
    done = impute.regression_impute(gaps, ["y"], features=["orders"])
    late = done.select(*KEYS, "y", F.months_between(DATE, first).alias("m")).where("m > 23.5")
    return late.select(*KEYS, "y")


@query("imp5_panel_fill_keys", f"""{with_views('sp')} SELECT CAST(1 AS BIGINT) AS copies FROM sp LIMIT 1""")
def panel_fill_keys(spark, sf):
    """Keys of the finished panel are unique."""
    return panel_fill(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("copies")).agg(F.max("copies").alias("copies"))


@query("imp5_panel_fill")
def panel_fill(spark, sf):
    from chronopanel.plans.recipes import run_recipe

    return run_recipe(cut_lineage(views.sparse(spark, sf)), DEVELOPED)[0]  # read by every step that looks at the data


# A recipe in the order of the annual data preparation.
DEVELOPED = [
    ("trim_timeseries", {"completeness": 0.4, "before_year": 2001}),
    ("drop_columns", {"completeness": 0.2}),
    ("drop_static", {}),
    ("resample", {"freq": "M"}),
    ("forward_fill", {"n": 2, "latest_only": False}),
    ("zero_fill", {}),
    ("forecast_fill", {}),
    ("backfill", {"fill": "median"}),
    ("forward_fill", {"n": None}),
]
