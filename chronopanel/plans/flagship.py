"""The end-to-end recipe: grid, bounded fill, features, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronopanel.operators import aggregate, features, fill, labels
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import KEYS

COLUMNS = ["total", "orders"]


@query(
    "flagship_features",
    f"""{with_views("nm", "lab")},
ext AS (SELECT min(Date) AS lo, max(Date) AS hi FROM nm),
grid AS (SELECT c.Country, last_day(CAST(g.d AS DATE)) AS Date FROM (SELECT DISTINCT Country FROM nm) c
  CROSS JOIN (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS d FROM ext) g),
full_panel AS (SELECT g.Country, g.Date, nm.total, nm.orders, row_number() OVER (PARTITION BY g.Country ORDER BY g.Date) AS rn
  FROM grid g LEFT JOIN nm ON nm.Country = g.Country AND nm.Date = g.Date),
f AS (SELECT Country, Date,
  CASE WHEN total IS NULL AND rn - max(CASE WHEN total IS NOT NULL THEN rn END) OVER w <= 2 THEN last_value(total IGNORE NULLS) OVER w ELSE total END AS total,
  CASE WHEN orders IS NULL AND rn - max(CASE WHEN orders IS NOT NULL THEN rn END) OVER w <= 2 THEN last_value(orders IGNORE NULLS) OVER w ELSE orders END AS orders
  FROM full_panel WINDOW w AS (PARTITION BY Country ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT Country, Date, total, orders,
  coalesce(avg(total) OVER w3, 0) AS total_rolling_3_mean, coalesce(stddev_samp(total) OVER w3, 0) AS total_rolling_3_std,
  coalesce(avg(orders) OVER w3, 0) AS orders_rolling_3_mean, coalesce(stddev_samp(orders) OVER w3, 0) AS orders_rolling_3_std,
  coalesce((total - avg(total) OVER w3) / (abs(avg(total) OVER w3) + 1e-8), 0) AS total_momentum_3,
  coalesce((orders - avg(orders) OVER w3) / (abs(avg(orders) OVER w3) + 1e-8), 0) AS orders_momentum_3,
  CASE WHEN EXISTS (SELECT 1 FROM lab WHERE lab.Country = f.Country AND lab.Year = year(f.Date)) THEN 1 ELSE 0 END AS label
FROM f WINDOW w3 AS (PARTITION BY Country ORDER BY Date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    approx=[
        "total_rolling_3_mean", "total_rolling_3_std", "orders_rolling_3_mean", "orders_rolling_3_std",
        "total_momentum_3", "orders_momentum_3",
    ],
    digits=5,
)
def flagship(spark, sf) -> DataFrame:
    panel = views.nation_month(spark, sf).select(*KEYS, *COLUMNS)
    filled = fill.forward_fill(aggregate.complete_grid(panel, "M"), n=2, latest_only=False)
    rolled = features.rolling(filled, COLUMNS, windows=3, stats=["mean", "std"])
    return labels.build_labels(features.momentum(rolled, COLUMNS), views.crisis_labels(spark, sf))
