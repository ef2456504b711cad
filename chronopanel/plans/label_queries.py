"""Crisis labels, recovery periods and runs of positives."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import labels
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import with_views
from chronopanel.schema import KEYS

FLAGGED = """m AS (SELECT *, (Total_crisis = 1 OR Order_crises = 1) AS is_crisis FROM crises),
f AS (SELECT *, CASE WHEN NOT is_crisis AND coalesce(bool_or(is_crisis) OVER (PARTITION BY Country ORDER BY Year ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) THEN 1 ELSE 0 END AS label,
  coalesce(bool_or(is_crisis) OVER (PARTITION BY Country ORDER BY Year ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS "drop" FROM m)"""


@query("win30_mark_crises", f"{with_views('crises')} SELECT *, (Total_crisis = 1 OR Order_crises = 1) AS is_crisis FROM crises")
def mark(spark, sf):
    return labels.mark_crises(views.crises(spark, sf))


@query("win31_win32_lookback", f'{with_views("crises")}, {FLAGGED} SELECT * FROM f')
def lookback(spark, sf):
    return labels.label_lookback(labels.mark_crises(views.crises(spark, sf)), 2, 2)


@query("win33_create_labels", f'{with_views("crises")}, {FLAGGED} SELECT Country, CAST(Year AS INT) AS Year FROM f WHERE label = 1 AND NOT "drop"')
def create(spark, sf):
    return labels.create_labels(views.crises(spark, sf), 2, 2)


@query(
    "win34_drop_recovery",
    f"""{with_views('lnm')} SELECT Country, Date, orders, label FROM lnm a WHERE label = 1 OR NOT EXISTS
  (SELECT 1 FROM lnm b WHERE b.Country = a.Country AND b.label = 1 AND b.Date < a.Date AND a.Date < CAST(b.Date + INTERVAL 2 YEAR AS DATE)
   AND NOT EXISTS (SELECT 1 FROM lnm c WHERE c.Country = a.Country AND c.label = 1 AND c.Date > b.Date AND c.Date <= a.Date))""",
)
def drop_recovery(spark, sf):
    return labels.drop_recovery(views.labelled(spark, sf), 2).select(*KEYS, "orders", "label")


@query(
    "win37_positive_periods",
    f"""{with_views('lnm')}, p AS (SELECT Country, Date, coalesce(date_diff('day', lag(Date) OVER w, Date) > 32, true) AS o FROM lnm WHERE label = 1 OR orders > 10 WINDOW w AS (PARTITION BY Country ORDER BY Date)),
i AS (SELECT *, CAST(sum(o::INT) OVER (PARTITION BY Country ORDER BY Date) AS BIGINT) AS period FROM p) SELECT Country, period, min(Date) AS start_date, max(Date) AS end_date FROM i GROUP BY 1, 2""",
)
def periods(spark, sf):
    hit = ((F.col("label") == 1) | (F.col("orders") > 10)).cast("int")
    return labels.positive_periods(views.labelled(spark, sf).withColumn("y_pred", hit))
