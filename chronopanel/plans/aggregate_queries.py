"""Aggregations, resampling, deduplication and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import aggregate, classify
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.select_queries import BUCKET_SQL, NAME_SQL
from chronopanel.plans.views import PART_RULES, table, with_views
from chronopanel.schema import DATE, ENTITY, KEYS, to_long

LONG = """lng AS (SELECT Country, Date, 'quantity' AS variable, quantity AS value FROM sp
  UNION ALL SELECT Country, Date, 'revenue', revenue FROM sp UNION ALL SELECT Country, Date, 'lines', lines FROM sp)"""


@query(
    "agg1_completeness",
    f"""{with_views('sp')}, {LONG}, a AS (SELECT variable AS "column", count(value) * 1.0 / count(*) AS completeness FROM lng GROUP BY 1
  UNION ALL SELECT 'Country', 1 UNION ALL SELECT 'Date', 1)
SELECT "column", CAST(completeness AS DOUBLE) AS completeness, CAST(1 - completeness AS DOUBLE) AS missing_percent FROM a""",
    approx=["completeness", "missing_percent"],
)
def completeness(spark, sf):
    return aggregate.completeness(views.sparse(spark, sf))


@query(
    "agg1_completeness_long",
    f"""{with_views('sp')}, {LONG} SELECT variable AS "column", count(value) * 1.0 / count(*) AS completeness, 1 - count(value) * 1.0 / count(*) AS missing_percent FROM lng GROUP BY 1""",
    approx=["completeness", "missing_percent"],
)
def completeness_long(spark, sf):
    return aggregate.completeness_long(to_long(views.sparse(spark, sf)))


@query(
    "agg2_data_quality",
    f"""{with_views('sp')} SELECT 'suppliers' AS data_set, count(DISTINCT Country) AS countries, min(year(Date)) || '-' || max(year(Date)) AS years,
  100 * (count(quantity) + count(revenue) + count(lines)) / (3.0 * count(*)) AS completeness FROM sp""",
    approx=["completeness"],
)
def data_quality(spark, sf):
    return aggregate.data_quality(views.sparse(spark, sf), tag="suppliers")


# As-of rows per quarter: the grid of each country, the last row up to each quarter end.
RESAMPLE = """q AS (SELECT Country, year(Date) * 4 + quarter(Date) - 1 AS p, * EXCLUDE (Country) FROM sp),
span AS (SELECT Country, min(p) AS lo, max(p) AS hi FROM q GROUP BY 1),
grid AS (SELECT Country, unnest(generate_series(lo, hi)) AS p FROM span)"""
QEND = "last_day(make_date(CAST(g.p // 4 AS INT), CAST(g.p % 4 * 3 + 3 AS INT), 1))"


@query(
    "agg3_resample",
    f"""{with_views('sp')}, {RESAMPLE}, st AS (SELECT Country, p, sum(quantity) AS s, min(revenue) AS mn, max(lines) AS mx FROM q GROUP BY 1, 2),
al AS (SELECT k.Country, m.p FROM (SELECT DISTINCT Country FROM sp) k CROSS JOIN (SELECT unnest(generate_series(min(p), max(p))) AS p FROM q) m)
SELECT g.Country, {QEND} AS Date, CASE WHEN i.p IS NOT NULL THEN coalesce(st.s, 0) END AS quantity, st.mn AS revenue, st.mx AS lines
FROM al g LEFT JOIN grid i ON i.Country = g.Country AND i.p = g.p LEFT JOIN st ON st.Country = g.Country AND st.p = g.p""",
)
def resample(spark, sf):
    mapping = {"sum": ["quantity"], "min": ["revenue"], "max": ["lines"]}
    return aggregate.resample(views.sparse(spark, sf), "Q", mapping)


@query(
    "agg3_resample_mean_median",
    f"""{with_views('sp')}, {RESAMPLE} SELECT g.Country, {QEND} AS Date, avg(quantity) AS quantity, median(revenue) AS revenue, avg(lines) AS lines
FROM grid g LEFT JOIN q ON q.Country = g.Country AND q.p = g.p GROUP BY g.Country, g.p""",
    approx=["quantity", "revenue", "lines"],
)
def resample_mean(spark, sf):
    mapping = {"mean": ["quantity", "lines"], "median": ["revenue"]}
    return aggregate.resample(views.sparse(spark, sf), "Q", mapping, complete=False)


@query(
    "agg4_resample_last",
    f"""{with_views('sp')}, thin AS (SELECT * FROM sp),
q AS (SELECT Country, year(Date) * 12 + month(Date) - 1 AS p, quantity, revenue, lines FROM thin),
span AS (SELECT Country, min(p) AS lo, max(p) AS hi FROM q GROUP BY 1), grid AS (SELECT Country, unnest(generate_series(lo, hi)) AS p FROM span)
SELECT g.Country, last_day(make_date(CAST(g.p // 12 AS INT), CAST(g.p % 12 + 1 AS INT), 1)) AS Date, q.quantity, q.revenue, q.lines
FROM grid g ASOF LEFT JOIN q ON q.Country = g.Country AND g.p >= q.p""",
)
def resample_last(spark, sf):
    """Whole as-of rows, NULLs included, are carried over the months a supplier has no row in."""
    return aggregate.resample(views.sparse(spark, sf), "M", complete=False)


@query(
    "agg5_complete_grid",
    f"""{with_views('bars', 'sp')}, e AS (SELECT min(year(Date) * 12 + month(Date) - 1) AS lo, max(year(Date) * 12 + month(Date) - 1) AS hi FROM sp),
g AS (SELECT k.Country, last_day(make_date(CAST(p // 12 AS INT), CAST(p % 12 + 1 AS INT), 1)) AS Date FROM (SELECT DISTINCT Country FROM sp) k CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS p FROM e))
SELECT g.Country, g.Date, sp.quantity, sp.revenue, sp.lines FROM g LEFT JOIN sp ON sp.Country = g.Country AND sp.Date = g.Date""",
)
def complete_grid(spark, sf):
    return aggregate.complete_grid(views.sparse(spark, sf), "M")


@query(
    "agg5_complete_grid_partial",
    f"""{with_views('nm')}, e AS (SELECT min(year(Date)) AS lo, max(year(Date)) - CAST(max(Date) < make_date(CAST(max(year(Date)) AS INT), 12, 31) AS INT) AS hi FROM nm),
g AS (SELECT k.Country, make_date(CAST(p AS INT), 12, 31) AS Date FROM (SELECT DISTINCT Country FROM nm) k CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS p FROM e))
SELECT g.Country, g.Date, nm.orders FROM g LEFT JOIN nm ON nm.Country = g.Country AND nm.Date = g.Date""",
)
def complete_grid_partial(spark, sf):
    """The last date is in the middle of a year, whose end is then not on the grid."""
    return aggregate.complete_grid(views.nation_month(spark, sf).select(*KEYS, "orders"), "Y")


WORLD = "w AS (SELECT Date, sum(orders) AS orders FROM nm GROUP BY 1)"


def _world(spark, sf):
    return views.nation_month(spark, sf).groupBy(DATE).agg(F.sum("orders").alias("orders"))


@query(
    "agg5_complete_grid_unkeyed",
    f"""{with_views('nm')}, {WORLD}, e AS (SELECT min(year(Date) * 4 + quarter(Date) - 1) AS lo, max(year(Date) * 4 + quarter(Date) - 1) AS p, max(Date) AS d FROM w),
g AS (SELECT last_day(make_date(CAST(p // 4 AS INT), CAST(p % 4 * 3 + 3 AS INT), 1)) AS Date, d FROM (SELECT unnest(generate_series(lo, p)) AS p, d FROM e))
SELECT g.Date, w.orders FROM g LEFT JOIN w ON w.Date = g.Date WHERE g.Date <= g.d""",
)
def complete_grid_unkeyed(spark, sf):
    return aggregate.complete_grid(_world(spark, sf), "Q")


@query(
    "agg3_resample_unkeyed",
    f"""{with_views('nm')}, {WORLD} SELECT last_day(make_date(CAST(year(Date) AS INT), CAST(quarter(Date) * 3 AS INT), 1)) AS Date, sum(orders) AS orders FROM w GROUP BY 1""",
)
def resample_unkeyed(spark, sf):
    return aggregate.resample(_world(spark, sf), "Q", {"sum": ["orders"]})


@query(
    "agg6_gap_kinds",
    f"""{with_views('sp')}, {LONG}, v AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN Date END) OVER w AS lo, max(CASE WHEN value IS NOT NULL THEN Date END) OVER w AS hi
  FROM lng WINDOW w AS (PARTITION BY Country, variable))
SELECT variable, coalesce(bool_or(value IS NULL AND Date < lo), false) AS gap_before, coalesce(bool_or(value IS NULL AND Date > hi), false) AS gap_after,
  coalesce(bool_or(value IS NULL AND Date > lo AND Date < hi), false) AS gap_between FROM v GROUP BY 1""",
)
def gap_kinds(spark, sf):
    return aggregate.gap_kinds(views.sparse(spark, sf))


@query("agg7_bucket_counts", f"{with_views('cat')}, b AS ({BUCKET_SQL}) SELECT {NAME_SQL} AS bucket_name, count(*) AS n FROM b GROUP BY 1")
def bucket_counts(spark, sf):
    return aggregate.bucket_counts(classify.classify(views.catalogue(spark, sf), PART_RULES))


@query("agg8_concurrent_crises", f"{with_views('lab')} SELECT CAST(Year AS INT) AS Year, count(DISTINCT Country) AS countries FROM lab GROUP BY 1 HAVING count(DISTINCT Country) >= 3")
def concurrent(spark, sf):
    return aggregate.concurrent_crises(views.crisis_labels(spark, sf), 3)


@query(
    "agg9_crisis_years",
    f"""{with_views('lab', 'master')} SELECT region, Country, string_agg(CAST(Year AS VARCHAR), ',' ORDER BY Year) AS years
FROM lab JOIN master ON lab.Country = master.name GROUP BY 1, 2""",
)
def crisis_years(spark, sf):
    regions = views.country_master(spark, sf).select(F.col("name").alias(ENTITY), "region")
    found = aggregate.crisis_years_by_country(views.crisis_labels(spark, sf).join(regions, ENTITY))
    return found.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@query(
    "agg10_consolidate_catalogue",
    f"""{with_views('sc')} SELECT SUBJECT || '.' || MEASURE || '.' || FREQUENCY AS series_code, arg_min(split_part(series_name, ' –', 1), position) AS series_name,
  arg_min('{{''SUBJECT'': ''' || SUBJECT || ''', ''MEASURE'': ''' || MEASURE || ''', ''FREQUENCY'': ''' || FREQUENCY || '''}}', position) AS dimensions,
  CAST(arg_min(position, position) AS BIGINT) AS bucket, arg_min(LOCATION, position) AS bucket_name FROM sc GROUP BY 1""",
)
def consolidate(spark, sf):
    d = F.col("dimensions")
    literal = F.concat(
        F.lit("{'LOCATION': '"), d["LOCATION"], F.lit("', 'SUBJECT': '"), d["SUBJECT"], F.lit("', 'MEASURE': '"), d["MEASURE"],
        F.lit("', 'FREQUENCY': '"), d["FREQUENCY"], F.lit("'}"),
    )
    rows = views.series_catalogue(spark, sf).select(
        "position", "series_code", "series_name", literal.alias("dimensions"), F.col("position").alias("bucket"), d["LOCATION"].alias("bucket_name")
    )
    return aggregate.consolidate_catalogue(rows)


@query(
    "agg10_consolidate_apostrophes",
    f"""{with_views('sc')} SELECT SUBJECT || '.' || MEASURE || '''s.' || FREQUENCY AS series_code, arg_min(split_part(series_name, ' –', 1), position) AS series_name,
  arg_min('{{''SUBJECT'': ''' || SUBJECT || ''', ''MEASURE'': "' || MEASURE || '''s", ''FREQUENCY'': ''' || FREQUENCY || '''}}', position) AS dimensions,
  CAST(arg_min(position, position) AS BIGINT) AS bucket, arg_min(LOCATION, position) AS bucket_name FROM sc GROUP BY 1""",
)
def consolidate_apostrophes(spark, sf):
    """Values with an apostrophe stand in double quotes."""
    d = F.col("dimensions")
    literal = F.concat(
        F.lit("{'LOCATION': \"d'"), d["LOCATION"], F.lit("\", 'SUBJECT': '"), d["SUBJECT"], F.lit("', 'MEASURE': \""), d["MEASURE"],
        F.lit("'s\", 'FREQUENCY': '"), d["FREQUENCY"], F.lit("'}"),
    )
    rows = views.series_catalogue(spark, sf).select(
        "position", "series_code", "series_name", literal.alias("dimensions"), F.col("position").alias("bucket"), d["LOCATION"].alias("bucket_name")
    )
    return aggregate.consolidate_catalogue(rows)


@query(
    "agg11_global_by_date",
    f"""{with_views('sp')}, {LONG} SELECT Date, variable, avg(value) AS stat FROM lng WHERE value IS NOT NULL GROUP BY 1, 2""",
    approx=["stat"],
)
def global_mean(spark, sf):
    return aggregate.global_by_date(to_long(views.sparse(spark, sf)), "mean")


@query(
    "agg11_global_median",
    f"""{with_views('sp')}, {LONG} SELECT Date, variable, median(value) AS stat FROM lng WHERE value IS NOT NULL GROUP BY 1, 2""",
    approx=["stat"],
)
def global_median(spark, sf):
    return aggregate.global_by_date(to_long(views.sparse(spark, sf)), "median")


@query(
    "agg11_global_mode",
    f"""{with_views('sp')}, {LONG}, c AS (SELECT Date, variable, value, count(*) AS n FROM lng WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT Date, variable, value AS stat FROM c QUALIFY row_number() OVER (PARTITION BY Date, variable ORDER BY n DESC, value) = 1""",
)
def global_mode(spark, sf):
    return aggregate.global_by_date(to_long(views.sparse(spark, sf)), "mode")


@query(
    "agg12_best_frequency",
    f"""{with_views('sc')} SELECT position, series_code, FREQUENCY AS frequency FROM sc QUALIFY row_number() OVER (PARTITION BY LOCATION, SUBJECT, MEASURE
  ORDER BY CASE FREQUENCY WHEN 'M' THEN 0 WHEN 'Q' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, position) = 1""",
)
def best_frequency(spark, sf):
    return aggregate.best_frequency(views.series_catalogue(spark, sf)).select("position", "series_code", F.col("dimensions.FREQUENCY").alias("frequency"))


# Each customer's row and a poorer, later copy of it.
STACKED = """st AS (SELECT n_name AS Country, DATE '2000-01-31' AS Date, c_custkey AS rid, c_acctbal AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1.0::DOUBLE END AS b,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _stacked(spark, sf):
    k = F.col("c_custkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias(ENTITY))
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            ENTITY,
            F.lit("2000-01-31").cast("date").alias(DATE),
            k.alias("rid"),
            F.col("c_acctbal").alias("a"),
            F.when(k % 3 != 0, 1.0).alias("b"),
            F.when(k % 2 != 0, F.col("c_mktsegment")).alias("c"),
        )
    )


@query(
    "agg13_most_complete_row",
    f"""WITH {STACKED} SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY Country, Date ORDER BY (b IS NULL)::INT + (c IS NULL)::INT, rid) = 1""",
)
def most_complete(spark, sf):
    return aggregate.most_complete_row(_stacked(spark, sf), ["rid"])


@query("agg14_dedupe_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def dedupe_rows(spark, sf):
    return aggregate.dedupe(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "agg14_dedupe_last",
    "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def dedupe_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return aggregate.dedupe(rows, ["o_custkey"], "last", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "agg14_dedupe_first",
    "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1",
)
def dedupe_first(spark, sf):
    return aggregate.dedupe(table(spark, sf, "part").select("p_name", "p_partkey"), ["p_name"], "first", ["p_partkey"])


@query(
    "agg15_split_info",
    f"""{with_views('lnm')}, s AS (SELECT *, CASE WHEN Date <= DATE '1999-06-30' THEN 'train' ELSE 'test' END AS split FROM lnm)
SELECT split, min(Date) AS start, max(Date) AS "end", count(*) AS count, avg(label) AS label_proportion, CAST(sum(count(*)) OVER () AS BIGINT) AS total_periods,
  count(*) / sum(count(*)) OVER () AS proportion FROM s GROUP BY split""",
    approx=["label_proportion", "proportion"],
)
def split_info(spark, sf):
    from chronopanel.operators.split import split_cutoff

    return aggregate.split_info(split_cutoff(views.labelled(spark, sf), "1999-06-30"))


@query("agg16_min_rows", f"{with_views('sp')} SELECT min(n) AS min_rows FROM (SELECT count(*) AS n FROM sp GROUP BY Country)")
def min_rows(spark, sf):
    return aggregate.min_rows_per_country(aggregate.require_rows_per_country(views.sparse(spark, sf), 12))


@query(
    "agg17_describe",
    f"""{with_views('sp')}, {LONG} SELECT variable, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM lng GROUP BY 1""",
    approx=["mean", "std", "q25", "q50", "q75"],
    digits=4,
)
def describe(spark, sf):
    return aggregate.describe(views.sparse(spark, sf))


@query(
    "agg18_series_frequency",
    f"""{with_views('nm', 'ny', 'bars')}, s AS (SELECT Country AS s, Date FROM nm UNION ALL SELECT 'Y-' || Country, Date FROM ny UNION ALL SELECT 'D-' || ticker, Date FROM bars),
g AS (SELECT s, date_diff('day', lag(Date) OVER (PARTITION BY s ORDER BY Date), Date) AS gap FROM s),
m AS (SELECT s, gap FROM (SELECT s, gap, count(*) AS n FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY gap IS NULL, n DESC, gap DESC) = 1)
SELECT s AS Country, CASE WHEN gap = 1 THEN 'D' WHEN gap BETWEEN 28 AND 31 THEN 'M' WHEN gap BETWEEN 89 AND 92 THEN 'Q' WHEN gap BETWEEN 365 AND 366 THEN 'Y' ELSE 'Unknown' END AS frequency FROM m""",
)
def frequency(spark, sf):
    months = views.nation_month(spark, sf).select(*KEYS)
    years = views.nation_year(spark, sf).select(F.concat(F.lit("Y-"), ENTITY).alias(ENTITY), DATE)
    days = views.price_bars(spark, sf).select(F.concat(F.lit("D-"), "ticker").alias(ENTITY), DATE)
    return aggregate.series_frequency(months.unionByName(years).unionByName(days))


@query(
    "agg19_shape_report",
    f"""{with_views('lnm')} SELECT 'early' AS "set", count(*) AS "rows", count(DISTINCT Country) AS countries, avg(label) * 100 AS positive_percent FROM lnm WHERE year(Date) < 1998
UNION ALL SELECT 'late', count(*), count(DISTINCT Country), avg(label) * 100 FROM lnm WHERE year(Date) >= 1998""",
    approx=["positive_percent"],
)
def shape(spark, sf):
    rows = views.labelled(spark, sf)
    return aggregate.shape_report({"early": rows.where(F.year(DATE) < 1998), "late": rows.where(F.year(DATE) >= 1998)})
