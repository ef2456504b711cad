"""Readers and writers on files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import scratch, table, with_views
from chronopanel.schema import DATE, ENTITY
from chronopanel.sources import readers, writers


@query("src1_read_panel", f"{with_views('sp')} SELECT Country, Date, quantity, revenue, lines FROM sp")
def read_panel(spark, sf):
    """Text dates, an index leftover and an empty column are tidied away on read."""
    path = scratch(spark, "panel")
    raw = views.sparse(spark, sf).select(
        ENTITY,
        F.date_format(DATE, "yyyy-MM-dd").alias(DATE),
        F.coalesce("quantity", F.lit(float("nan"))).alias("quantity"),
        "revenue",
        "lines",
        F.lit(None).cast("double").alias("never"),
        F.lit(1).alias("__index_level_0__"),
    )
    raw.write.parquet(path)
    return readers.read_panel(spark, path)


@query("src2_catalogue", f"{with_views('cat')} SELECT CAST(id AS VARCHAR) AS id, name, note AS sourceNote, topics, 'parts, \"all\"' AS source_id FROM cat")
def catalogue(spark, sf):
    path = scratch(spark, "catalogue")
    rows = views.catalogue(spark, sf).select(
        F.col("id").cast("string").alias("id"), "name", F.col("note").alias("sourceNote"), "topics", F.lit('parts, "all"').alias("source_id")
    )
    writers.write_catalogue(rows, path)
    return readers.read_catalogue(spark, path)


@query(
    "src3_observations",
    f"""{with_views('ny')} SELECT Country, year(Date) AS Year, 'ORDERS' AS Series,
  CASE WHEN year(Date) % 3 = 0 THEN NULL WHEN year(Date) % 3 = 1 THEN NULL ELSE orders END AS value FROM ny""",
)
def observations(spark, sf):
    """Nested records with null and empty values."""
    path = scratch(spark, "observations")
    year = F.year(DATE)
    text = F.when(year % 3 == 1, "").when(year % 3 == 2, F.col("orders").cast("string"))
    views.nation_year(spark, sf).select(
        F.struct(F.col(ENTITY).alias("value")).alias("country"),
        year.cast("string").alias("date"),
        F.struct(F.lit("ORDERS").alias("id")).alias("indicator"),
        text.alias("value"),
    ).write.option("ignoreNullFields", "false").json(path)
    return readers.read_observations(spark, path)


@query(
    "src4_series",
    f"""{with_views('nm')} SELECT Country, Date AS Period, upper(substr(Country, 1, 3)) || '.VALUE.M' AS variable, orders AS value FROM nm""",
)
def series_docs(spark, sf):
    """One document per nation with parallel date and value arrays."""
    path = scratch(spark, "series")
    packed = views.nation_month(spark, sf).groupBy(ENTITY).agg(F.array_sort(F.collect_list(F.struct(DATE, "orders"))).alias("o"))
    code = F.upper(F.substring(ENTITY, 1, 3))
    packed.select(
        F.create_map(code, F.col(ENTITY)).alias("labels"),
        code.alias("series_code"),
        F.col(ENTITY).alias("series_name"),
        F.struct(code.alias("LOCATION"), code.alias("SUBJECT"), F.lit("VALUE").alias("MEASURE"), F.lit("M").alias("FREQUENCY")).alias("dimensions"),
        F.transform("o", lambda x: x[DATE].cast("string")).alias("period_start_day"),
        F.transform("o", lambda x: x["orders"]).alias("value"),
    ).write.json(path)
    return readers.read_series(spark, path)


@query(
    "src5_macro_history",
    f"""{with_views('ny')} SELECT CASE Country WHEN (SELECT min(n_name) FROM nation) THEN 'United States' ELSE Country END AS Country,
  make_date(year(Date), 1, 1) AS Date, orders AS gdp FROM ny""",
)
def macro_history(spark, sf):
    path = scratch(spark, "macro")
    first = table(spark, sf, "nation").agg(F.min("n_name")).scalar()
    views.nation_year(spark, sf).select(
        F.year(DATE).alias("year"),
        F.when(F.col(ENTITY) == first, "USA").otherwise(F.col(ENTITY)).alias("country"),
        F.col("orders").alias("gdp"),
        F.lit(0).alias("crisisJST"),
        F.lit(1).alias("crisisJST_old"),
    ).write.csv(path, header=True)
    return readers.read_macro_history(spark, path)


@query(
    "src6_crises",
    f"""{with_views('crises')} SELECT Country, Year, Total_crisis, Order_crises, (Total_crisis = 1 OR Order_crises = 1) AS is_crisis FROM crises""",
)
def crises(spark, sf):
    path = scratch(spark, "crises")
    views.crises(spark, sf).write.csv(path, header=True)
    return readers.read_crises(spark, path)


@query("src7_country_master", f"{with_views('master')} SELECT * FROM master")
def master(spark, sf):
    path = scratch(spark, "master")
    views.country_master(spark, sf).write.csv(path, header=True)
    return readers.read_country_master(spark, path)


@query(
    "snk1_null_tokens",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN NULL
  WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS priority FROM orders""",
)
def null_tokens(spark, sf):
    p = F.col("o_orderpriority")
    text = F.when(p == "1-URGENT", "NA").when(p == "2-HIGH", "").when(p == "3-MEDIUM", "nan").otherwise(p)
    return readers.normalise_null_tokens(table(spark, sf, "orders").select("o_orderkey", text.alias("priority")))


@query("snk2_write_panel", f"{with_views('nm')} SELECT Country, Date, total, orders, mean_price FROM nm WHERE year(Date) >= 2000")
def write_panel(spark, sf):
    """Two splits written together; reading one back touches only its partition."""
    path = scratch(spark, "stored")
    panel = views.nation_month(spark, sf)
    parts = {"train": panel.where(F.year(DATE) < 2000), "test": panel.where(F.year(DATE) >= 2000)}
    writers.write_panel(parts, path, "monthly")
    return readers.read_panel(spark, path, "monthly", "test")


@query("snk3_write_labels", f"{with_views('lab')} SELECT Country, CAST(Year AS INTEGER) AS Year FROM lab")
def write_labels(spark, sf):
    path = scratch(spark, "labels")
    writers.write_labels(views.crisis_labels(spark, sf), path)
    return spark.read.csv(path, header=True, schema="Country STRING, Year INT")
