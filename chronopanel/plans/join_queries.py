"""Merges, grids, timelines, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import features, joins, labels, select
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import table, with_views
from chronopanel.schema import DATE, ENTITY, KEYS


def _annual(spark, sf):
    return views.nation_year(spark, sf).withColumn("Year", F.year(DATE)).drop(DATE)


@query(
    "jn1_merge_indicators",
    f"""{with_views('ny', 'crises')}, a AS (SELECT Country, year(Date) AS Year, CASE WHEN year(Date) % 2 = 1 THEN total END AS total FROM ny),
b AS (SELECT Country, year(Date) AS Year, CASE WHEN year(Date) > 1997 THEN orders END AS orders FROM ny)
SELECT Country, make_date(CAST(Year AS INT), 1, 1) AS Date, total, orders, Total_crisis
FROM (a FULL JOIN b USING (Country, Year)) FULL JOIN (SELECT Country, Year, Total_crisis FROM crises) c USING (Country, Year)""",
)
def merge_indicators(spark, sf):
    y = _annual(spark, sf)
    frames = [
        y.select(ENTITY, "Year", F.when(F.col("Year") % 2 == 1, F.col("total")).alias("total")),
        y.select(ENTITY, "Year", F.when(F.col("Year") > 1997, F.col("orders")).alias("orders")),
        views.crises(spark, sf).select(ENTITY, "Year", "Total_crisis"),
    ]
    return joins.merge_indicators(frames)


# Every pair of return flag and line status.
SERIES = [f"{flag}.{status}" for flag in "ANR" for status in "FO"]


@query(
    "jn2_assemble_series",
    """WITH lng AS (SELECT n_name AS Country, last_day(CAST(l_shipdate AS DATE)) AS Date, l_returnflag || '.' || l_linestatus AS v, SUM(CAST(l_quantity AS BIGINT)) AS x
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT Country, Date, """
    + ", ".join(f"""CAST(max(CASE WHEN v = '{v}' THEN x END) AS DOUBLE) AS "{v}\"""" for v in SERIES)
    + " FROM lng GROUP BY 1, 2",
)
def assemble_series(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias(ENTITY))
    items = table(spark, sf, "lineitem").groupBy(
        "l_suppkey",
        F.last_day(F.to_date("l_shipdate")).alias("Period"),
        F.concat_ws(".", "l_returnflag", "l_linestatus").alias("variable"),
    ).agg(F.sum(F.col("l_quantity").cast("long")).alias("x"))
    long = (
        items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(ENTITY, "Period", "variable")
        .agg(F.sum("x").cast("double").alias("value"))
    )
    return joins.assemble_series(long, SERIES)


@query(
    "jn3_merge_timeseries",
    f"""{with_views('nm', 'ny')}, w AS (SELECT Date, sum(orders) AS world FROM nm GROUP BY 1),
d AS (SELECT Date FROM nm UNION SELECT Date FROM ny UNION SELECT Date FROM w), k AS (SELECT DISTINCT Country FROM nm UNION SELECT DISTINCT Country FROM ny)
SELECT k.Country, d.Date, nm.orders, ny.total, w.world FROM k CROSS JOIN d LEFT JOIN nm ON nm.Country = k.Country AND nm.Date = d.Date
LEFT JOIN ny ON ny.Country = k.Country AND ny.Date = d.Date LEFT JOIN w ON w.Date = d.Date""",
)
def merge_timeseries(spark, sf):
    m = views.nation_month(spark, sf).select(*KEYS, "orders")
    y = views.nation_year(spark, sf).select(*KEYS, "total", "orders")
    world = m.groupBy(DATE).agg(F.sum("orders").alias("world"))
    return joins.merge_timeseries([m, y, world])


@query(
    "jn3_merge_timeseries_unkeyed",
    f"""{with_views('nm', 'ny')}, a AS (SELECT Date, sum(orders) AS a FROM nm GROUP BY 1), b AS (SELECT Date, max(total) AS b FROM ny GROUP BY 1)
SELECT Date, a, b FROM a FULL JOIN b USING (Date)""",
)
def merge_unkeyed(spark, sf):
    m = views.nation_month(spark, sf)
    a = m.groupBy(DATE).agg(F.sum("orders").alias("a"))
    b = views.nation_year(spark, sf).groupBy(DATE).agg(F.max("total").alias("b"))
    return joins.merge_timeseries([a, b], on=None)


@query("jn4_build_labels", f"{with_views('lnm')} SELECT Country, Date, orders, label FROM lnm")
def build_labels(spark, sf):
    return views.labelled(spark, sf).select(*KEYS, "orders", "label")


@query(
    "jn5_country_master",
    f"""{with_views('crises', 'master')} SELECT c.Country, c.Year, c.Total_crisis, m.region, m."alpha-3" FROM crises c
LEFT JOIN master m ON c.Country = m.name""",
)
def country_master(spark, sf):
    master = views.country_master(spark, sf)
    return joins.join_country_master(views.crises(spark, sf), master).select(ENTITY, "Year", "Total_crisis", "region", "alpha-3")


@query(
    "jn6_left_merge",
    f"""{with_views('nm', 'ny')} SELECT nm.Country, nm.Date, nm.orders, ny.total AS year_total FROM nm LEFT JOIN ny ON nm.Country = ny.Country AND nm.Date = ny.Date""",
)
def left_merge(spark, sf):
    year = views.nation_year(spark, sf).select(*KEYS, F.col("total").alias("year_total"))
    return joins.left_merge(views.nation_month(spark, sf).select(*KEYS, "orders"), year)


@query(
    "jn7_outer_merge",
    f"""{with_views('nm', 'ny')} SELECT Country, Date, nm.orders, ny.total AS year_total FROM nm
FULL JOIN ny USING (Country, Date)""",
)
def outer_merge(spark, sf):
    month = views.nation_month(spark, sf).select(*KEYS, "orders")
    year = views.nation_year(spark, sf).select(*KEYS, F.col("total").alias("year_total"))
    return joins.outer_merge(month, year)


@query(
    "jn8_add_features",
    f"""{with_views('nm')} SELECT Country, Date, orders, coalesce(lag(orders, 1) OVER (PARTITION BY Country ORDER BY Date), 0) AS orders_lag_1 FROM nm""",
)
def add_features(spark, sf):
    panel = views.nation_month(spark, sf).select(*KEYS, "orders")
    return joins.add_features(panel, features.lag(panel, ["orders"], 1))


@query(
    "jn9_lookup_predictions",
    f"""{with_views('lnm')} SELECT Country, Date, CASE WHEN year(Date) < 1999 THEN label ELSE 0 END AS y_pred,
  CASE WHEN year(Date) < 1999 THEN 1 / orders ELSE 0.5 END AS y_pred_proba FROM lnm""",
    approx=["y_pred_proba"],
)
def lookup(spark, sf):
    known = views.labelled(spark, sf).where(F.year(DATE) < 1999)
    stored = known.select(*KEYS, F.col("label").alias("y_pred"), (1 / F.col("orders")).alias("y_pred_proba"))
    return joins.lookup_predictions(views.nation_month(spark, sf).select(*KEYS), stored)


@query("jn11_align_window_labels", f"{with_views('lnm')} SELECT Country, Date, label FROM lnm WHERE Date >= DATE '1997-01-31' AND Date < DATE '1999-01-31'")
def align(spark, sf):
    rows = select.filter_date_range(views.nation_month(spark, sf).select(*KEYS), "1997-01-31", "1999-01-31")
    return joins.align_window_labels(rows, views.labelled(spark, sf))


@query(
    "jn13_enrich_region",
    f"""{with_views('nm', 'master')} SELECT nm.Country, nm.Date, nm.orders, m.region FROM nm LEFT JOIN master m ON nm.Country = m.name""",
)
def enrich(spark, sf):
    return joins.enrich_region(views.nation_month(spark, sf).select(*KEYS, "orders"), views.country_master(spark, sf))


@query(
    "jn14_countries_in_both",
    f"""{with_views('lab')} SELECT DISTINCT Country FROM lab WHERE Country IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
)
def both(spark, sf):
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    here = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias(ENTITY))
    return joins.countries_in_both(views.crisis_labels(spark, sf), here)


INTERVALS = """ext AS (SELECT min(Date) - 180 AS lo, max(Date) + 180 AS hi FROM rows_),
iv AS (SELECT Country, Year, greatest(make_date(CAST(Year AS INT), 1, 1), lo) AS start_date, least(make_date(CAST(Year AS INT), 12, 31), hi) AS end_date
  FROM lab, ext WHERE make_date(CAST(Year AS INT), 12, 31) >= lo AND make_date(CAST(Year AS INT), 1, 1) <= hi)"""


@query(
    "jn15_overlay_crises",
    f"""{with_views('nm', 'lab')}, rows_ AS (SELECT * FROM nm), {INTERVALS}
SELECT iv.Year, r.Country, r.Date, r.orders, CAST(iv.start_date AS DATE) AS start_date, CAST(iv.end_date AS DATE) AS end_date FROM rows_ r JOIN iv
ON r.Country = iv.Country AND r.Date BETWEEN iv.start_date AND iv.end_date""",
)
def overlay(spark, sf):
    rows = views.nation_month(spark, sf).select(*KEYS, "orders")
    return joins.overlay_crises(rows, views.crisis_labels(spark, sf))


@query(
    "jn15_crisis_intervals",
    f"""{with_views('nm', 'lab')}, rows_ AS (SELECT * FROM nm), {INTERVALS}
SELECT Country, Year, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM iv""",
)
def intervals(spark, sf):
    rows = views.nation_month(spark, sf)
    return joins.crisis_intervals(views.crisis_labels(spark, sf), rows)


@query(
    "jn16_flag_crisis_points",
    f"""{with_views('nm', 'lab')} SELECT Country, Date, total, orders FROM nm WHERE EXISTS (SELECT 1 FROM lab WHERE lab.Country = nm.Country AND lab.Year = year(nm.Date))""",
)
def points(spark, sf):
    return joins.flag_crisis_points(views.nation_month(spark, sf), views.crisis_labels(spark, sf), ["total", "orders"])


@query(
    "set1_union_panels",
    f"""{with_views('nm', 'ny')} SELECT Country, Date, total, orders, mean_price FROM nm UNION ALL SELECT Country, Date, total, orders, NULL FROM ny""",
)
def union_panels(spark, sf):
    return joins.union_panels(views.nation_month(spark, sf), views.nation_year(spark, sf))


@query("set2_union_labels", f"{with_views('lab')} SELECT Country, CAST(Year AS INT) AS Year FROM lab UNION SELECT n_name, 1996 FROM nation")
def union_labels(spark, sf):
    more = table(spark, sf, "nation").select(F.col("n_name").alias(ENTITY), F.lit(1996).alias("Year"))
    return labels.union_labels(views.crisis_labels(spark, sf), more)


@query("set3_union_dates", f"{with_views('nm', 'bars')} SELECT Date FROM nm UNION SELECT Date FROM bars")
def union_dates(spark, sf):
    return joins.union_dates([views.nation_month(spark, sf), views.price_bars(spark, sf)])


@query("set3_union_keys", f"{with_views('nm', 'ny')} SELECT Country, Date FROM nm UNION SELECT Country, Date FROM ny")
def union_keys(spark, sf):
    return joins.union_keys([views.nation_month(spark, sf), views.nation_year(spark, sf)])


@query(
    "set4_except_countries",
    f"""{with_views('nm', 'master')} SELECT DISTINCT Country FROM nm EXCEPT SELECT name FROM master WHERE region IN ('ASIA', 'EUROPE')""",
)
def except_countries(spark, sf):
    train = views.country_master(spark, sf).where("region IN ('ASIA', 'EUROPE')").select(F.col("name").alias(ENTITY))
    return joins.except_countries(views.nation_month(spark, sf), train)


@query(
    "set5_join_timelines",
    f"""{with_views('nm', 'ny')}, e AS (SELECT least((SELECT min(Date) FROM nm), (SELECT min(Date) FROM ny)) AS lo, greatest((SELECT max(Date) FROM nm), (SELECT max(Date) FROM ny)) AS hi)
SELECT last_day(CAST(d AS DATE)) AS Date FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS d, hi FROM e) WHERE last_day(CAST(d AS DATE)) <= hi""",
)
def timelines(spark, sf):
    """Monthly against annual dates: month ends from the first to the last date."""
    months = views.nation_month(spark, sf).select(DATE).distinct()
    return joins.join_timelines(spark, months, views.nation_year(spark, sf).select(DATE).distinct())


@query(
    "set5_join_timelines_starts",
    f"""{with_views('ny')}, e AS (SELECT make_date(min(year(Date)), 1, 1) AS lo, make_date(max(year(Date)), 1, 1) AS hi FROM ny)
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 YEAR)) AS DATE) AS Date FROM e""",
)
def timelines_starts(spark, sf):
    starts = views.nation_year(spark, sf).select(F.make_date(F.year(DATE), F.lit(1), F.lit(1)).alias(DATE)).distinct()
    return joins.join_timelines(spark, starts)


@query(
    "set5_join_timelines_daily",
    f"""{with_views('bars', 'ny')}, e AS (SELECT least((SELECT min(Date) FROM bars), (SELECT min(Date) FROM ny)) AS lo, greatest((SELECT max(Date) FROM bars), (SELECT max(Date) FROM ny)) AS hi)
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS Date FROM e""",
)
def timelines_daily(spark, sf):
    days = views.price_bars(spark, sf).select(DATE).distinct()
    return joins.join_timelines(spark, days, views.nation_year(spark, sf).select(DATE).distinct())
