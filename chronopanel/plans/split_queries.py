"""Splits, samples, windows, encodings and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import encode, split
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import table, with_views
from chronopanel.schema import DATE, ENTITY, KEYS


@query("spl1_split_cutoff", f"{with_views('nm')} SELECT Country, Date, orders, CASE WHEN Date <= DATE '1999-06-30' THEN 'train' ELSE 'test' END AS split FROM nm")
def cutoff(spark, sf):
    return split.split_cutoff(views.nation_month(spark, sf).select(*KEYS, "orders"), "1999-06-30")


BALANCE = """d AS (SELECT Date, count(*) AS n, sum(label) AS pos FROM lnm GROUP BY 1),
c AS (SELECT Date, row_number() OVER w - 1 AS i, count(*) OVER () AS dates, sum(n) OVER w AS na, sum(pos) OVER w AS pa, sum(n) OVER () AS n, sum(pos) OVER () AS p FROM d WINDOW w AS (ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM c WHERE i >= dates // 2 AND i <= floor(dates * 0.95)),
s AS (SELECT Date, 0.8::DOUBLE * (pow(pa / na - p / n, 2) + pow((p - pa) / (n - na) - p / n, 2)) + (1 - 0.8::DOUBLE) * (pow(na / n - 0.8::DOUBLE, 2) + pow((n - na) / n - (1 - 0.8::DOUBLE), 2)) AS score
  FROM k WHERE na >= 0.05 * dates AND n - na >= 0.05 * dates AND pa > 0 AND p - pa > 0),
cut AS (SELECT coalesce((SELECT Date FROM s WHERE score <= 1 ORDER BY score, Date DESC LIMIT 1), (SELECT min(Date) FROM k)) AS cutoff)"""


@query("spl2_balanced_cutoff", f"{with_views('lnm')}, {BALANCE} SELECT cutoff FROM cut")
def balanced_cutoff(spark, sf):
    return split.balanced_cutoff(views.labelled(spark, sf))


@query("spl2_split_balanced", f"{with_views('lnm')}, {BALANCE} SELECT Country, Date, label, CASE WHEN Date <= (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split FROM lnm")
def balanced(spark, sf):
    return split.split_balanced(views.labelled(spark, sf).select(*KEYS, "label"))


@query("spl3_split_geographic")
def geographic(spark, sf):
    """Rows per set; which countries fall where follows a seeded search."""
    return split.split_geographic(views.supplier_month(spark, sf).select(*KEYS)).groupBy("split").agg(F.count("*").alias("n"))


@query(
    "spl3_geographic_disjoint",
    f"{with_views('sm')} SELECT count(DISTINCT Country) AS countries, count(*) AS n, true AS near, CAST(1 AS BIGINT) AS most_sets FROM sm",
)
def geographic_properties(spark, sf):
    """No country is in two sets, and the training share is within 2 points of its target."""
    rows = split.split_geographic(views.supplier_month(spark, sf).select(*KEYS))
    per = rows.groupBy(ENTITY).agg(F.count_distinct("split").alias("sets"), F.count("*").alias("n"), F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"))
    return per.agg(
        F.count("*").alias("countries"),
        F.sum("n").alias("n"),
        (F.abs(F.sum("t") / F.sum("n") - 0.8) < 0.02).alias("near"),
        F.max("sets").alias("most_sets"),
    )


@query("spl4_split_date", f"{with_views('nm')} SELECT max(Date) AS split_date FROM nm WHERE Date <= DATE '1999-07-15'")
def split_date(spark, sf):
    return split.split_date(split.split_cutoff(views.nation_month(spark, sf), "1999-07-15"))


@query(
    "spl5_apply_stored_split",
    f"""{with_views('nm', 'sp')}, c AS (SELECT max(Date) AS d FROM nm WHERE Date <= DATE '1999-07-15') SELECT Country, Date, lines, CASE WHEN Date <= (SELECT d FROM c) THEN 'train' ELSE 'test' END AS split FROM sp""",
)
def stored(spark, sf):
    known = split.split_date(split.split_cutoff(views.nation_month(spark, sf), "1999-07-15")).scalar()
    return split.apply_stored_split(views.sparse(spark, sf).select(*KEYS, "lines"), known)


@query("spl6_downsample_majority", f"{with_views('lnm')} SELECT label, (SELECT sum(label) FROM lnm)::BIGINT AS n FROM (SELECT DISTINCT label FROM lnm)")
def downsample(spark, sf):
    return split.downsample_majority(views.labelled(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "spl7_stratified_holdout",
    """WITH n AS (SELECT quality AS y_true, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
SELECT y_true, 'test' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM n UNION ALL SELECT y_true, 'train', CAST(n - round(n * 0.2) AS BIGINT) FROM n""",
)
def holdout(spark, sf):
    held = split.stratified_holdout(views.scores(spark, sf), label="y_true", keys=["doc_id"])
    return held.groupBy("y_true", "split").agg(F.count("*").alias("n"))


@query(
    "spl8_stratified_kfold",
    """WITH n AS (SELECT quality AS y_true, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)
SELECT y_true, CAST(f AS INT) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f)""",
)
def kfold(spark, sf):
    folds = split.stratified_kfold(views.scores(spark, sf), label="y_true", keys=["doc_id"])
    return folds.groupBy("y_true", "fold").agg(F.count("*").alias("n"))


@query(
    "spl9_random_holdout",
    f"""WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT 'test', CAST(n - floor(n * 0.8) AS BIGINT) FROM n""",
)
def random_holdout(spark, sf):
    held = split.random_holdout(table(spark, sf, "orders").select("o_orderkey"), keys=["o_orderkey"])
    return held.groupBy("split").agg(F.count("*").alias("n"))


WINDOWS = """e AS (SELECT min(Date) AS lo, max(Date) AS hi FROM nm WHERE Date > DATE '1999-06-30'),
s AS (SELECT lo, hi, i, CAST(lo + to_months(CAST(3 * i AS INT)) AS DATE) AS s FROM e CROSS JOIN (SELECT unnest(generate_series(0, 400)) AS i)),
wd AS (SELECT CAST(i + 1 AS INT) AS "window", s AS start_date, least(CAST(s + INTERVAL 12 MONTH AS DATE), hi) AS end_date FROM s WHERE s < hi)"""


def _test(spark, sf):
    return views.nation_month(spark, sf).where(F.col(DATE) > "1999-06-30")


@query("spl10_rolling_windows", f"{with_views('nm')}, {WINDOWS} SELECT * FROM wd")
def rolling_windows(spark, sf):
    return split.rolling_windows(_test(spark, sf))


@query(
    "spl10_window_rows",
    f"""{with_views('nm')}, {WINDOWS} SELECT wd."window", count(*) AS n, sum(orders) AS orders FROM wd JOIN nm ON nm.Date >= start_date AND nm.Date < end_date GROUP BY 1""",
)
def window_rows(spark, sf):
    """Rows per window; overlapping windows share rows."""
    windows = split.rolling_windows(_test(spark, sf))
    days = windows.select("window", F.explode(F.sequence("start_date", F.date_sub("end_date", 1))).alias(DATE))
    return _test(spark, sf).join(days, DATE).groupBy("window").agg(F.count("*").alias("n"), F.sum("orders").alias("orders"))


@query(
    "spl11_expanding_train",
    f"""{with_views('nm')}, tr AS (SELECT Country, Date, orders FROM nm WHERE Date <= DATE '1999-09-30'), te AS (SELECT Country, Date, -orders AS orders FROM nm WHERE Date > DATE '1999-06-30' AND Date < DATE '2000-03-31')
SELECT * FROM te UNION ALL SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.Country = tr.Country AND te.Date = tr.Date)""",
)
def expanding(spark, sf):
    """Sets that overlap by a quarter: test rows win."""
    nm = views.nation_month(spark, sf).select(*KEYS, "orders")
    test = nm.where(F.col(DATE) > "1999-06-30").withColumn("orders", -F.col("orders"))
    return split.expanding_train(nm.where(F.col(DATE) <= "1999-09-30"), test, "2000-03-31")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "enc1_dummy_fit",
    "SELECT c_custkey, c_mktsegment, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer",
)
def dummy_fit(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.dummy_fit(rows, "c_mktsegment")[0]


@query(
    "enc2_dummy_transform",
    "SELECT s_suppkey, c, " + ", ".join(f"CAST(c = '{s}' AS INT) AS \"c_{s}\"" for s in ("ASIA", "EUROPE")) + " FROM (SELECT s_suppkey, r_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
)
def dummy_transform(spark, sf):
    """Categories known from two regions only; the others are all 0."""
    master = views.country_master(spark, sf)
    known = encode.fit_categories(master.where("region IN ('ASIA', 'EUROPE')").select(F.col("region").alias("c")), "c")
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(master, F.col("n_name") == master["name"])
    return encode.dummy_transform(rows.select("s_suppkey", F.col("region").alias("c")), "c", known)


@query("enc3_label_encode", f"{with_views('sm')} SELECT Country, Date, CAST(dense_rank() OVER (ORDER BY Country) - 1 AS BIGINT) AS code FROM sm")
def label_encode(spark, sf):
    return encode.label_encode(views.supplier_month(spark, sf).select(*KEYS), ENTITY, "code")


C = ["quantity", "revenue", "lines"]


def scaled(center: str, spread: str) -> str:
    parts = ", ".join(f"(sp.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END AS {c}" for c in C)
    stats = ", ".join(f"{center.replace('@', c)} AS m_{c}, {spread.replace('@', c)} AS s_{c}" for c in C)
    return f"{with_views('sp')}, s AS (SELECT {stats} FROM sp WHERE Date <= DATE '1999-06-30') SELECT Country, Date, {parts} FROM sp, s"


def _train(df):
    return df.where(F.col(DATE) <= "1999-06-30")


@query("enc4_standard_scale", scaled("avg(@)", "stddev_pop(@)"), approx=C)
def standard(spark, sf):
    panel = views.sparse(spark, sf)
    return encode.standard_scale(panel, C, _train(panel))


@query("enc5_robust_scale", scaled("quantile_cont(@, 0.5)", "quantile_cont(@, 0.75) - quantile_cont(@, 0.25)"), approx=C)
def robust(spark, sf):
    panel = views.sparse(spark, sf)
    return encode.robust_scale(panel, C, _train(panel))


@query("enc6_minmax_scale", scaled("min(@)", "max(@) - min(@)"), approx=C)
def minmax(spark, sf):
    panel = views.sparse(spark, sf)
    return encode.minmax_scale(panel, C, _train(panel))


@query("enc6_minmax_inverse", f"{with_views('sp')} SELECT Country, Date, quantity, revenue, lines FROM sp", approx=C, digits=4)
def minmax_inverse(spark, sf):
    panel = views.sparse(spark, sf)
    fitted = encode.fit_minmax(panel, C)
    return encode.unscale(encode.scale(panel, fitted), fitted)


@query(
    "enc7_temporal_features",
    f"""{with_views('nm')} SELECT Country, Date, orders, CAST(dense_rank() OVER (ORDER BY Country) - 1 AS BIGINT) AS country_code,
  date_diff('day', (SELECT min(Date) FROM nm), Date) AS days_since_baseline, year(Date) AS "year", month(Date) AS "month" FROM nm""",
)
def temporal(spark, sf):
    return encode.temporal_features(views.nation_month(spark, sf).select(*KEYS, "orders"))
