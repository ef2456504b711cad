"""Projections, filters, predicates and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import scalars
from chronopanel.operators import classify, select
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import PART_RULES, table, with_views
from chronopanel.schema import DATE, ENTITY, KEYS, q, to_long, to_wide, validate_panel

# Two made-up renames for nation names.
RENAMES = {"CHINA": "China", "VIETNAM": "Viet Nam"}


@query(
    "prj1_rename_values",
    f"""{with_views('nm')} SELECT CASE Country WHEN 'CHINA' THEN 'China' WHEN 'VIETNAM' THEN 'Viet Nam' ELSE Country END AS Country,
  Date, orders FROM nm""",
)
def rename_values(spark, sf):
    return select.rename_values(views.nation_month(spark, sf), ENTITY, RENAMES).select(*KEYS, "orders")


@query(
    "prj1_rename_values_by_table",
    f"""{with_views('nm', 'master')} SELECT m."alpha-3" AS Country, nm.Date, nm.orders FROM nm JOIN master m ON nm.Country = m.name""",
)
def rename_by_table(spark, sf):
    names = views.country_master(spark, sf).select(F.col("name").alias("from"), q("alpha-3").alias("to"))
    return select.rename_values(views.nation_month(spark, sf), ENTITY, names).select(*KEYS, "orders")


@query("prj2_drop_columns", f"{with_views('sp')} SELECT Country, Date, lines FROM sp")
def drop_columns(spark, sf):
    """Revenue is filled three quarters, quantity less: both fall under 80 percent."""
    return select.drop_columns(views.sparse(spark, sf).withColumn("extra", F.lit(1.0)), ["extra", "absent"], 0.8)


@query(
    "prj2_drop_variables_long",
    f"""{with_views('sp')}, lng AS (SELECT Country, Date, 'quantity' AS variable, quantity AS value FROM sp
  UNION ALL SELECT Country, Date, 'revenue', revenue FROM sp UNION ALL SELECT Country, Date, 'lines', lines FROM sp)
SELECT Country, Date, variable, value FROM lng WHERE variable IN
  (SELECT variable FROM lng GROUP BY 1 HAVING count(value) * 1.0 / count(*) >= 0.74)""",
)
def drop_variables(spark, sf):
    return select.drop_variables(to_long(views.sparse(spark, sf)), 0.74)


@query("prj3_select_columns", f"{with_views('sp')} SELECT Country, Date, quantity, lines FROM sp")
def select_columns(spark, sf):
    """Variables whose mean stays under 10000."""
    return select.select_columns(views.sparse(spark, sf), max_abs_mean=10_000)


@query("prj3_select_by_name", f"{with_views('sp')} SELECT Country, Date, revenue FROM sp")
def select_by_name(spark, sf):
    return select.select_columns(views.sparse(spark, sf), prefix="re", suffix="ue")


@query("prj4_common_columns", f"{with_views('nm')} SELECT Country, Date, orders, total FROM nm")
def common_columns(spark, sf):
    return select.common_columns(views.nation_month(spark, sf), views.nation_year(spark, sf))[0]


@query("prj5_validate_panel", f"{with_views('nm')} SELECT Country, Date, total, orders, mean_price FROM nm")
def validate(spark, sf):
    return validate_panel(views.nation_month(spark, sf), ["total"], min_rows=24, check_keys=True)


BARS = ["Open", "High", "Low", "Close"]
TICKERS = ["click", "error", "purchase", "signup", "view"]


@query(
    "prj6_price_pivot",
    f"""{with_views('bars')} SELECT Date, """
    + ", ".join(
        f"max(CASE WHEN ticker = '{t}' THEN \"{f}\" END) AS \"{t}.{f}\"" for t in TICKERS for f in BARS
    )
    + " FROM bars GROUP BY Date",
)
def price_pivot(spark, sf):
    return select.price_pivot(views.price_bars(spark, sf), BARS, TICKERS)


@query(
    "prj_long_and_wide",
    f"{with_views('sp')} SELECT Country, Date, quantity, revenue, lines FROM sp",
)
def long_and_wide(spark, sf):
    """The long form and back."""
    return to_wide(to_long(views.sparse(spark, sf)), ["quantity", "revenue", "lines"])


@query("flt1_filter_countries", f"{with_views('nm')} SELECT Country, Date, orders FROM nm WHERE Country IN ('CHINA', 'FRANCE', 'PERU')")
def include(spark, sf):
    return select.filter_countries(views.nation_month(spark, sf), include=["CHINA", "FRANCE", "PERU"]).select(*KEYS, "orders")


@query(
    "flt1_filter_countries_by_table",
    f"{with_views('nm', 'master')} SELECT Country, Date, orders FROM nm WHERE Country NOT IN (SELECT name FROM master WHERE region = 'ASIA')",
)
def exclude(spark, sf):
    asia = views.country_master(spark, sf).where("region = 'ASIA'").select(F.col("name").alias(ENTITY))
    return select.filter_countries(views.nation_month(spark, sf), exclude=asia).select(*KEYS, "orders")


@query("flt2_filter_date_range", f"{with_views('nm')} SELECT Country, Date, orders FROM nm WHERE Date >= DATE '1997-01-31' AND Date < DATE '1998-01-31'")
def date_range(spark, sf):
    return select.filter_date_range(views.nation_month(spark, sf), "1997-01-31", "1998-01-31").select(*KEYS, "orders")


@query("flt3_clip_period", f"{with_views('nm')} SELECT Country, Date, orders FROM nm WHERE Date BETWEEN DATE '1997-01-31' AND DATE '1998-01-31'")
def clip(spark, sf):
    return select.clip_period(views.nation_month(spark, sf), "1997-01-31", "1998-01-31").select(*KEYS, "orders")


@query(
    "flt4_trim_timeseries",
    f"""{with_views('sp')}, q AS (SELECT Date, Country FROM sp
  WHERE (quantity IS NULL)::INT + (revenue IS NULL)::INT + (lines IS NULL)::INT < 0.2 * 5 ORDER BY Date, Country LIMIT 1)
SELECT sp.* FROM sp, q WHERE (sp.Date > q.Date OR (sp.Date = q.Date AND sp.Country >= q.Country)) AND year(sp.Date) < 2000""",
)
def trim(spark, sf):
    return select.trim_timeseries(views.sparse(spark, sf), 0.8, before_year=2000)


@query("flt5_drop_static_columns", f"{with_views('sp')} SELECT Country, Date, quantity, revenue, lines FROM sp")
def drop_static_columns(spark, sf):
    """Constant, empty, two-valued and one-value-plus-NULL columns go."""
    panel = views.sparse(spark, sf)
    return select.drop_static_columns(
        panel.withColumns(
            {
                "constant": F.lit(1.0),
                "empty": F.lit(None).cast("double"),
                "two": (F.month(DATE) > 6).cast("double"),
                "one_and_null": F.when(F.month(DATE) > 6, 1.0),
            }
        )
    )


@query(
    "flt6_drop_static_rows",
    f"""{with_views('sp')} SELECT * FROM sp WHERE len(list_distinct(list_filter([quantity, revenue, lines], lambda x: x IS NOT NULL))) > 1""",
)
def drop_static_rows(spark, sf):
    return select.drop_static_rows(views.sparse(spark, sf))


@query("flt7_filter_topics", f"{with_views('cat')} SELECT id, topics FROM cat WHERE contains(topics, 'Brand#1') OR contains(topics, '#24')")
def topics(spark, sf):
    return select.filter_topics(views.catalogue(spark, sf), ["Brand#1", "#24"]).select("id", "topics")


@query("flt7_filter_topics_none", f"{with_views('cat')} SELECT id, '' AS topics FROM cat")
def topics_none(spark, sf):
    """No indicator has topics, so all stay."""
    return select.filter_topics(views.catalogue(spark, sf).withColumn("topics", F.lit("")), ["Trade"]).select("id", "topics")


@query("flt8_market_subset", f"""{with_views('nm', 'master')} SELECT nm.Country, nm.Date, nm.orders, m."alpha-3" FROM nm JOIN master m ON nm.Country = m.name
  WHERE m."alpha-3" IN ('CAN', 'JPN', 'USA', 'AUS', 'BEL', 'CHE', 'DEU', 'DNK', 'ESP', 'FIN', 'FRA', 'GBR', 'ITA', 'NLD', 'NOR', 'PRT', 'SWE')""")
def developed(spark, sf):
    master = views.country_master(spark, sf).select(F.col("name").alias(ENTITY), q("alpha-3"))
    return select.market_subset(views.nation_month(spark, sf).join(master, ENTITY), "developed").select(*KEYS, "orders", q("alpha-3"))


@query(
    "flt9_clean_nonfinite",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN l_quantity END AS x FROM lineitem",
)
def nonfinite(spark, sf):
    value = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return select.clean_nonfinite(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value.alias("x")))


BUCKET_SQL = r"""SELECT id, CASE
    WHEN topics = 'Brand#13' THEN -1
    WHEN regexp_matches(text, '\bhot\b') THEN -1
    WHEN regexp_matches(text, '\bring\b|\bbolt\b') THEN 1
    WHEN regexp_matches(text, '\bgizmo\b') THEN 2
    WHEN regexp_matches(text, '\bwidget\b|anvil') THEN 3
    WHEN topics = 'Brand#2' THEN 4 ELSE -1 END AS bucket
  FROM (SELECT *, lower(name) || ' ' || lower(note) AS text FROM cat)"""
NAME_SQL = "CASE bucket WHEN 1 THEN 'Fasteners' WHEN 2 THEN 'Gadgets' WHEN 3 THEN 'Goods' WHEN 4 THEN 'Branded' ELSE 'Others' END"


@query("cls1_classify", f"{with_views('cat')}, b AS ({BUCKET_SQL}) SELECT id, bucket, {NAME_SQL} AS bucket_name FROM b")
def classified(spark, sf):
    return classify.classify(views.catalogue(spark, sf), PART_RULES).select("id", "bucket", "bucket_name")


@query(
    "cls2_add_rules",
    f"{with_views('cat')}, b AS ({BUCKET_SQL.replace('anvil', 'anvil|small').replace('WHEN topics', 'WHEN topics', 1)}) SELECT id, CASE WHEN bucket = -1 AND x THEN 7 ELSE bucket END AS bucket FROM (SELECT b.*, cat.topics = 'Brand#5' AND NOT regexp_matches(lower(cat.name), '\\bhot\\b') AS x FROM b JOIN cat USING (id))",
)
def added_rules(spark, sf):
    rules = classify.add_rules(PART_RULES, 3, ["small"], {"Brand#5": 7})
    return classify.classify(views.catalogue(spark, sf), rules).select("id", "bucket")


@query("cls3_column_mapping", f"{with_views('cat')}, b AS ({BUCKET_SQL.replace('WHEN topics = ', 'WHEN NULL = ').replace('lower(note)', 'lower(topics)')}) SELECT id, bucket FROM b")
def mapped(spark, sf):
    """Another source: its title and dimension columns, no topics."""
    other = views.catalogue(spark, sf).select("id", F.col("name").alias("series_name"), F.col("topics").alias("dimensions"))
    ready = classify.set_column_mapping(other, {"name": "series_name", "note": "dimensions"})
    return classify.classify(ready, PART_RULES).select("id", "bucket")


@query("cls_default_rules", f"""{with_views('cat')} SELECT id, -1 AS bucket FROM cat""")
def default_rules(spark, sf):
    """Part names mention no economic term, so the default rules leave all as others."""
    return classify.classify(views.catalogue(spark, sf)).select("id", "bucket")


@query("flt10_drop_others", f"{with_views('cat')}, b AS ({BUCKET_SQL}), n AS (SELECT id, CASE bucket WHEN 4 THEN NULL ELSE {NAME_SQL} END AS bucket_name FROM b) SELECT * FROM n WHERE bucket_name IS NULL OR bucket_name <> 'Others'")
def drop_others(spark, sf):
    """Rows without a bucket name stay."""
    found = classify.classify(views.catalogue(spark, sf), PART_RULES)
    unnamed = found.withColumn("bucket_name", F.when(F.col("bucket") != 4, F.col("bucket_name")))
    return select.drop_others(unnamed).select("id", "bucket_name")


@query(
    "fn_calendar",
    """SELECT o_orderkey, year(d) AS y, month(d) AS m, make_date(year(d), 12, 31) AS year_end, last_day(d) AS month_end,
  last_day(make_date(year(d), quarter(d) * 3, 1)) AS quarter_end, CAST(d + INTERVAL 4 YEAR AS DATE) AS later,
  date_diff('day', DATE '1995-01-01', d) AS days, make_date(year(d), 1, 1) AS year_start
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def calendar(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        scalars.year_end(d).alias("year_end"),
        scalars.period_end(scalars.period_index(d, "M"), "M").alias("month_end"),
        scalars.period_end(scalars.period_index(d, "Q"), "Q").alias("quarter_end"),
        scalars.add_years(d, 4).alias("later"),
        scalars.days_between(d, F.lit("1995-01-01").cast("date")).alias("days"),
        scalars.year_to_date(F.year(d)).alias("year_start"),
    )


@query(
    "fn8_frequency_alias",
    """SELECT p_partkey, CASE upper(substr(p_name, 1, 1)) WHEN 'D' THEN 'D' WHEN 'M' THEN 'M' WHEN 'Q' THEN 'Q' WHEN 'Y' THEN 'Y'
  WHEN 'A' THEN 'Y' ELSE 'Unknown' END AS frequency FROM part""",
)
def alias(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.normalise_alias(F.col("p_name")).alias("frequency"))


@query(
    "fn1_fn3_text",
    f"""{with_views('sc')} SELECT position, SUBJECT || '.' || MEASURE || '.' || FREQUENCY AS from_dims,
  SUBJECT || '.' || MEASURE || '.' || FREQUENCY AS from_code, split_part(series_name, ' –', 1) AS short_name,
  '{{''SUBJECT'': ''' || SUBJECT || ''', ''MEASURE'': ''' || MEASURE || ''', ''FREQUENCY'': ''' || FREQUENCY || '''}}' AS cleaned FROM sc""",
)
def text(spark, sf):
    d = F.col("dimensions")
    literal = F.concat(
        F.lit("{'LOCATION': '"), d["LOCATION"], F.lit("', 'SUBJECT': '"), d["SUBJECT"], F.lit("', 'MEASURE': '"), d["MEASURE"],
        F.lit("', 'FREQUENCY': '"), d["FREQUENCY"], F.lit("'}"),
    )
    parsed = scalars.parse_dimensions(literal)
    return views.series_catalogue(spark, sf).select(
        "position",
        scalars.generic_series_code(F.col("series_code"), literal).alias("from_dims"),
        scalars.generic_series_code(F.col("series_code"), F.lit("none")).alias("from_code"),
        scalars.name_before_dash(F.col("series_name")).alias("short_name"),
        scalars.dimensions_text(scalars.without_key(parsed, "LOCATION")).alias("cleaned"),
    )


@query("top1_order_panel", f"{with_views('sp')} SELECT Country, Date, quantity FROM sp ORDER BY Country, Date")
def ordered(spark, sf):
    return select.order_panel(views.sparse(spark, sf).select(*KEYS, "quantity"))
