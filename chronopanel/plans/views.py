"""Panels derived from the star-schema tables, each as Spark code and as SQL text.

Money is summed as DECIMAL so that both engines start from identical values.
The source tables hold no NULLs, so ``sparse`` blanks cells (never rows) by a
fixed rule to give the gap operators something to do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators.classify import Rules
from chronopanel.operators.labels import create_labels, mark_crises
from chronopanel.schema import DATE, ENTITY, KEYS, PanelError


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise PanelError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        base = tempfile.gettempdir()
    return f"{base}/chronopanel/{name}-{uuid.uuid4().hex}"


MONEY = "decimal(18,2)"


def nation_month(spark, sf) -> DataFrame:
    """Orders per nation and month end.

    One wide shuffle, for the join on the customer; adaptive execution splits
    it where one customer has very many orders. The sums per nation and month
    are merged before they are shuffled.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.last_day(F.to_date("o_orderdate")).alias(DATE), F.col("o_totalprice").cast(MONEY).alias("v")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias(ENTITY))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    cells = joined.groupBy(*KEYS).agg(
        F.sum("v").cast("double").alias("total"), F.count("*").cast("double").alias("orders")
    )
    return cells.withColumn("mean_price", F.col("total") / F.col("orders"))


def nation_year(spark, sf) -> DataFrame:
    months = nation_month(spark, sf).select(
        ENTITY, F.make_date(F.year(DATE), F.lit(12), F.lit(31)).alias(DATE), F.col("total").cast(MONEY).alias("total"), "orders"
    )
    return months.groupBy(*KEYS).agg(F.sum("total").cast("double").alias("total"), F.sum("orders").alias("orders"))


def crises(spark, sf) -> DataFrame:
    """Annual flags: totals, or order counts, fell by more than a tenth."""
    from chronopanel.schema import series

    w = series()
    fell = lambda c: F.coalesce((F.col(c) < F.lag(c).over(w) * 0.9).cast("int"), F.lit(0))
    return nation_year(spark, sf).select(
        ENTITY, F.year(DATE).alias("Year"), fell("total").alias("Total_crisis"), fell("orders").alias("Order_crises")
    )


def crisis_labels(spark, sf) -> DataFrame:
    return create_labels(mark_crises(crises(spark, sf)), 1, 0)


def labelled(spark, sf) -> DataFrame:
    from chronopanel.operators.labels import build_labels

    return build_labels(nation_month(spark, sf), crisis_labels(spark, sf))


def country_master(spark, sf) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("alpha-3"), F.col("r_name").alias("region")
    )


def supplier_month(spark, sf) -> DataFrame:
    """Line items per supplier and month end: grows with the tables in rows and in entities."""
    items = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.last_day(F.to_date("l_shipdate")).alias(DATE),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("v"),
    )
    return items.groupBy("l_suppkey", DATE).agg(
        F.sum("qty").cast("double").alias("quantity"),
        F.sum("v").cast("double").alias("revenue"),
        F.count("*").cast("double").alias("lines"),
    ).select(F.concat(F.lit("S"), F.col("l_suppkey")).alias(ENTITY), DATE, "quantity", "revenue", "lines", F.col("l_suppkey").alias("k"))


def _month_number():
    return F.year(DATE) * 12 + F.month(DATE) - 1


def sparse(spark, sf) -> DataFrame:
    """``supplier_month`` with interior, leading and trailing gaps, empty and all-zero series."""
    k, m = F.col("k"), _month_number()
    at = m - 1995 * 12
    ends = (at < k % 9) | (at > 78 - k % 5)
    return supplier_month(spark, sf).select(
        *KEYS,
        F.when(~(ends | ((k * 7 + m * 3) % 5 == 0)), F.col("quantity")).alias("quantity"),
        F.when((k + m) % 4 != 0, F.col("revenue")).alias("revenue"),
        F.when(k % 10 == 4, F.lit(0.0)).when(k % 10 != 3, F.col("lines")).alias("lines"),
    )


def sparse_nation(spark, sf) -> DataFrame:
    """``nation_month`` with gaps, small enough for brute-force comparison of neighbour searches."""
    m = _month_number()
    n = F.length(ENTITY)
    return nation_month(spark, sf).select(
        *KEYS,
        F.when((n * 7 + m) % 9 != 0, F.col("total")).alias("total"),
        F.when((n + m) % 11 != 0, F.col("orders")).alias("orders"),
        "mean_price",
    )


def price_bars(spark, sf) -> DataFrame:
    """Daily open, high, low and close of event values per event type."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias(DATE))
        .agg(
            F.min_by("value", at).alias("Open"),
            F.max("value").alias("High"),
            F.min("value").alias("Low"),
            F.max_by("value", at).alias("Close"),
        )
    )


def catalogue(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("note"), F.col("p_brand").alias("topics")
    )


def series_catalogue(spark, sf) -> DataFrame:
    """Parts as coded series: LOCATION brand, SUBJECT type, MEASURE first word, FREQUENCY from size."""
    freq = F.element_at(F.array(*map(F.lit, ["M", "Q", "A", "D"])), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"),
        F.regexp_replace("p_brand", "#", "").alias("loc"),
        F.col("p_type").alias("subj"),
        F.element_at(F.split("p_name", " "), 1).alias("meas"),
        freq.alias("freq"),
        "p_name",
    )
    return p.select(
        "position",
        F.concat_ws(".", "subj", "loc", "meas", "freq").alias("series_code"),
        F.concat(F.col("p_name"), F.lit(" – "), F.col("loc")).alias("series_name"),
        F.struct(
            F.col("loc").alias("LOCATION"), F.col("subj").alias("SUBJECT"), F.col("meas").alias("MEASURE"), F.col("freq").alias("FREQUENCY")
        ).alias("dimensions"),
    )


def scores(spark, sf) -> DataFrame:
    """Prediction table: quality as truth, document length as score."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    n = F.col("n_chars").cast("double")
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "lang",
            "source",
            F.col("quality").alias("y_true"),
            (n / (n + 500)).alias("y_pred_proba"),
            (n / (n + 500) >= 0.5).cast("int").alias("y_pred"),
            ((n - 500) / 500).alias("logit"),
            (1 / (1 + F.abs(n - 800))).alias("other_score"),
        )
    )


DIMENSIONS = 64


def components(spark, sf) -> DataFrame:
    """Embeddings, one column per component."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").alias("category"),
        (F.col("vec_id") % 2).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(DIMENSIONS)],
    )


def vectors(spark, sf) -> DataFrame:
    """Embeddings summed over each quarter of their components: four variables that read all of them."""
    step = DIMENSIONS // 4
    total = lambda i: F.aggregate(
        F.slice("embedding", i * step + 1, step), F.lit(0.0), lambda s, x: s + x.cast("double")
    )
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").alias("category"),
        (F.col("vec_id") % 2).cast("int").alias("label"),
        *[total(i).alias(f"e{i + 1}") for i in range(4)],
    )


PART_RULES = Rules(
    patterns={1: [r"\bring\b", r"\bbolt\b"], 2: [r"\bgizmo\b"], 3: [r"\bwidget\b", "anvil"]},
    names={1: "Fasteners", 2: "Gadgets", 3: "Goods", 4: "Branded", -1: "Others"},
    excluded_patterns=[r"\bhot\b"],
    excluded_topics=["Brand#13"],
    topic_buckets={"Brand#2": 4},
)

MARKETS = "substr(Country, 1, 1)"

# SQL text of the same views, with what each builds on.
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "nm": (
        (),
        """SELECT Country, Date, total, orders, total / orders AS mean_price FROM (
  SELECT n.n_name AS Country, last_day(CAST(o.o_orderdate AS DATE)) AS Date,
    CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(COUNT(*) AS DOUBLE) AS orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)""",
    ),
    "ny": (
        ("nm",),
        """SELECT Country, make_date(year(Date), 12, 31) AS Date,
  CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total, SUM(orders) AS orders FROM nm GROUP BY 1, 2""",
    ),
    "crises": (
        ("ny",),
        """SELECT Country, year(Date) AS Year,
  CASE WHEN total < lag(total) OVER w * 0.9 THEN 1 ELSE 0 END AS Total_crisis,
  CASE WHEN orders < lag(orders) OVER w * 0.9 THEN 1 ELSE 0 END AS Order_crises
FROM ny WINDOW w AS (PARTITION BY Country ORDER BY Date)""",
    ),
    "lab": (
        ("crises",),
        """SELECT c.Country, c.Year FROM crises c JOIN crises n ON n.Country = c.Country AND n.Year = c.Year + 1
WHERE (n.Total_crisis = 1 OR n.Order_crises = 1) AND NOT (c.Total_crisis = 1 OR c.Order_crises = 1)""",
    ),
    "lnm": (
        ("nm", "lab"),
        """SELECT nm.*, CASE WHEN EXISTS (SELECT 1 FROM lab WHERE lab.Country = nm.Country AND lab.Year = year(nm.Date))
  THEN 1 ELSE 0 END AS label FROM nm""",
    ),
    "master": (
        (),
        """SELECT n_name AS name, upper(substr(n_name, 1, 3)) AS "alpha-3", r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "sm": (
        (),
        """SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS Country, last_day(CAST(l_shipdate AS DATE)) AS Date,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(COUNT(*) AS DOUBLE) AS lines,
  l_suppkey AS k FROM lineitem GROUP BY l_suppkey, 1, 2""",
    ),
    "sp": (
        ("sm",),
        """SELECT Country, Date,
  CASE WHEN NOT ((m - 23940 < k % 9) OR (m - 23940 > 78 - k % 5) OR (k * 7 + m * 3) % 5 = 0) THEN quantity END AS quantity,
  CASE WHEN (k + m) % 4 <> 0 THEN revenue END AS revenue,
  CASE WHEN k % 10 = 4 THEN 0.0::DOUBLE WHEN k % 10 <> 3 THEN lines END AS lines
FROM (SELECT *, year(Date) * 12 + month(Date) - 1 AS m FROM sm)""",
    ),
    "spn": (
        ("nm",),
        """SELECT Country, Date,
  CASE WHEN (length(Country) * 7 + m) % 9 <> 0 THEN total END AS total,
  CASE WHEN (length(Country) + m) % 11 <> 0 THEN orders END AS orders, mean_price
FROM (SELECT *, year(Date) * 12 + month(Date) - 1 AS m FROM nm)""",
    ),
    "bars": (
        (),
        """SELECT event_type AS ticker, CAST(ts AS DATE) AS Date, arg_min(value, (ts, event_id)) AS Open, max(value) AS High,
  min(value) AS Low, arg_max(value, (ts, event_id)) AS Close FROM events GROUP BY 1, 2""",
    ),
    "cat": ((), "SELECT p_partkey AS id, p_name AS name, p_type AS note, p_brand AS topics FROM part"),
    "sc": (
        (),
        """SELECT p_partkey AS position, p_type || '.' || loc || '.' || meas || '.' || freq AS series_code,
  p_name || ' – ' || loc AS series_name, loc AS LOCATION, p_type AS SUBJECT, meas AS MEASURE, freq AS FREQUENCY
FROM (SELECT *, replace(p_brand, '#', '') AS loc, split_part(p_name, ' ', 1) AS meas,
  CASE p_size % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'Q' WHEN 2 THEN 'A' ELSE 'D' END AS freq FROM part)""",
    ),
    "scores": (
        (),
        """SELECT doc_id, lang, source, quality AS y_true, n / (n + 500) AS y_pred_proba,
  CASE WHEN n / (n + 500) >= 0.5 THEN 1 ELSE 0 END AS y_pred, (n - 500) / 500 AS logit, 1 / (1 + abs(n - 800)) AS other_score
FROM (SELECT l.doc_id, d.lang, d.source, l.quality, CAST(d.n_chars AS DOUBLE) AS n
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    ),
    "vec": (
        (),
        """SELECT vec_id, label AS category, CAST(vec_id % 2 AS INTEGER) AS label, list_sum(x[1:16]) AS e1, list_sum(x[17:32]) AS e2,
  list_sum(x[33:48]) AS e3, list_sum(x[49:64]) AS e4 FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""",
    ),
}


def with_views(*names: str) -> str:
    """WITH clause of the named views and everything they build on."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in _SQL[name][0]:
            add(parent)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in needed)
