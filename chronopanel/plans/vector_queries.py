"""Principal components, separation measures and neighbour graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import features, neighbours, vectors
from chronopanel.plans import views
from chronopanel.plans.registry import query
from chronopanel.plans.views import table, with_views
from chronopanel.schema import DATE, ENTITY, KEYS, cut_lineage, q

E4 = ["e1", "e2", "e3", "e4"]
VEC = with_views("vec")


def _wide(spark, sf):
    return views.components(spark, sf)


def _names():
    return [f"e{i + 1}" for i in range(views.DIMENSIONS)]


@query("vec1_pca_transform")
def pca(spark, sf):
    rows = _wide(spark, sf)
    return vectors.pca_transform(rows, vectors.pca_fit(rows, _names(), 0.8), ["vec_id"])


# Two standardised variables: their sum and difference over root two, the stronger first, up to sign.
STORED = f"""{VEC}, s AS (SELECT vec_id, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS a, (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS b FROM vec),
r AS (SELECT corr(e1, e2) AS r FROM vec)
SELECT vec_id, abs(a + CASE WHEN r < 0 THEN -b ELSE b END) / sqrt(2) AS first, abs(a - CASE WHEN r < 0 THEN -b ELSE b END) / sqrt(2) AS second FROM s, r"""


@query("vec1_mod8_stored_components", STORED, approx=["first", "second"])
def stored_components(spark, sf):
    """Components fitted and stored, read again, and applied as read."""
    rows = views.vectors(spark, sf)
    folder = views.scratch(spark, "components")
    vectors.pca_train_or_load(rows, folder, ["e1", "e2"], 2)
    read = vectors.pca_train_or_load(rows.limit(0), folder, ["e1", "e2"], 2)  # nothing to fit: it has to be the stored one
    scored = vectors.pca_transform(rows, read, ["vec_id"])
    return scored.select("vec_id", F.abs("PC1").alias("first"), F.abs("PC2").alias("second"))


# Scores are centred, uncorrelated, and their variances sum to the number of
# standardised features when all components are kept.
@query("vec1_pca_properties", "SELECT count(*) AS n, true AS centred, true AS uncorrelated, 4.0::DOUBLE AS total_variance FROM embeddings", approx=["total_variance"])
def pca_properties(spark, sf):
    rows = views.vectors(spark, sf)
    scored = vectors.pca_transform(rows, vectors.pca_fit(rows, E4, 4), ["vec_id"])
    pcs = [f"PC{i}" for i in range(1, 5)]
    cov = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(pcs) for b in pcs[i + 1 :]]
    return scored.agg(
        F.count("*").alias("n"),
        (F.greatest(*[F.abs(F.avg(p)) for p in pcs]) < 1e-8).alias("centred"),
        (F.greatest(*cov) < 1e-6).alias("uncorrelated"),
        sum([F.var_pop(p) for p in pcs[1:]], F.var_pop(pcs[0])).alias("total_variance"),
    )


@query("vec2_explained_variance")
def explained(spark, sf):
    return vectors.explained_variance(spark, vectors.pca_fit(_wide(spark, sf), _names(), views.DIMENSIONS))


# Two standardised variables have components with shares (1 +- |r|) / 2.
@query(
    "vec2_explained_variance_pair",
    f"{VEC}, r AS (SELECT abs(corr(e1, e2)) AS r FROM vec) SELECT 1 AS component, (1 + r) / 2 AS ratio FROM r UNION ALL SELECT 2, (1 - r) / 2 FROM r",
    approx=["ratio"],
)
def explained_pair(spark, sf):
    fitted = vectors.pca_fit(views.vectors(spark, sf), ["e1", "e2"], 2)
    return vectors.explained_variance(spark, fitted).select("component", "ratio")


def _class_fit(spark, sf):
    return vectors.class_pca_fit(_wide(spark, sf), "label", _names(), 5)


@query("vec3_class_pca")
def class_pca(spark, sf):
    return vectors.class_pca_transform(_wide(spark, sf), _class_fit(spark, sf), ["vec_id", "label"])


@query("vec4_loadings_table")
def loadings(spark, sf):
    return vectors.loadings_table(vectors.loadings_rows(spark, *_class_fit(spark, sf)), 10)


@query("top2_top_components")
def top_components(spark, sf):
    fitted = vectors.pca_fit(_wide(spark, sf), _names(), 3)
    return vectors.top_components(vectors.loadings_rows(spark, fitted), 1, 10)


@query("top3_top_rank_components")
def top_rank(spark, sf):
    return vectors.top_rank_components(vectors.loadings_rows(spark, *_class_fit(spark, sf)), 10)


PANEL = ["quantity", "revenue", "lines"]


def _panel(spark, sf):
    return views.supplier_month(spark, sf).select(*KEYS, *PANEL)


def _eigen(spark, sf):
    return vectors.sliding_pca(_panel(spark, sf), PANEL, window=36, step=12)


def _latest(spark, sf):
    """One small row per country, read several times below."""
    return cut_lineage(vectors.latest_components(_eigen(spark, sf)))


@query("vec5_sliding_pca")
def sliding(spark, sf):
    return _eigen(spark, sf).select(*KEYS, "n_rows", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i + 1}") for i in range(3)])


# Window ends, and that eigenvalues add up to the total variance: for two
# unprepared variables the sum and product are the trace and determinant.
@query(
    "vec5_sliding_pca_pair",
    f"""{with_views('sm')}, r AS (SELECT Country, Date, quantity, lines, row_number() OVER (PARTITION BY Country ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY Country) AS n FROM sm),
w AS (SELECT Country, i AS s, n FROM r WHERE i % 12 = 0 AND i + 36 <= n),
z AS (SELECT w.Country, w.s, max(r.Date) AS Date, stddev_pop(quantity) AS sq, stddev_pop(lines) AS sl, corr(quantity, lines) AS c FROM w JOIN r ON r.Country = w.Country AND r.i >= w.s AND r.i < w.s + 36 GROUP BY 1, 2)
SELECT Country, Date, 36.0 / 35 * (1 + abs(c)) AS eigenvalue_1, 36.0 / 35 * (1 - abs(c)) AS eigenvalue_2 FROM z""",
    approx=["eigenvalue_1", "eigenvalue_2"],
)
def sliding_pair(spark, sf):
    plain = {"trend": None, "period": None}
    found = vectors.sliding_pca(_panel(spark, sf), ["quantity", "lines"], 36, 12, plain)
    return found.select(*KEYS, F.col("eigenvalues")[0].alias("eigenvalue_1"), F.col("eigenvalues")[1].alias("eigenvalue_2"))


@query("vec6_dynamic_pca")
def dynamic(spark, sf):
    found = vectors.dynamic_pca(_panel(spark, sf), PANEL, every=6)
    return found.select(*KEYS, "n_rows", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i + 1}") for i in range(3)])


# The recursion itself, row by row, for two variables as they are.
@query(
    "vec6_dynamic_pair",
    f"""WITH RECURSIVE {with_views('sm').removeprefix('WITH ')}, r AS (SELECT Country, Date, quantity AS x, lines AS y, row_number() OVER (PARTITION BY Country ORDER BY Date) AS i FROM sm),
d AS (SELECT Country, Date, i, x AS mx, y AS my, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM r WHERE i = 1
  UNION ALL SELECT r.Country, r.Date, r.i, 0.9 * d.mx + 0.1 * x, 0.9 * d.my + 0.1 * y,
  0.9 * d.a + 0.1 * (x - d.mx) * (x - (0.9 * d.mx + 0.1 * x)), 0.9 * d.b + 0.1 * (y - d.my) * (y - (0.9 * d.my + 0.1 * y)),
  0.9 * d.c + 0.1 * (x - d.mx) * (y - (0.9 * d.my + 0.1 * y)) FROM d JOIN r ON r.Country = d.Country AND r.i = d.i + 1)
SELECT Country, Date, CAST(i AS INTEGER) AS n_rows, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS eigenvalue_1,
  (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS eigenvalue_2 FROM d WHERE i >= 10 AND i % 5 = 0""",
    approx=["eigenvalue_1", "eigenvalue_2"],
    digits=4,
)
def dynamic_pair(spark, sf):
    plain = {"standardise": False, "trend": None, "period": None}
    found = vectors.dynamic_pca(_panel(spark, sf), ["quantity", "lines"], 0.9, 10, 5, plain)
    return found.select(*KEYS, "n_rows", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i + 1}") for i in range(2)])


@query("vec7_global_components")
def global_components(spark, sf):
    found = vectors.global_components(_latest(spark, sf))
    return found.select("component", "ratio", "cumulative", *[F.col("loadings")[i].alias(f"loading_{i + 1}") for i in range(3)])


@query("vec7_project_components")
def project(spark, sf):
    latest = _latest(spark, sf)
    chosen = vectors.select_components(vectors.global_components(latest), 2)
    ready = features.prepare_series(_panel(spark, sf), PANEL)
    scored = vectors.project_components(ready, PANEL, latest, chosen)
    return scored.select(*KEYS, "own", *[F.col("scores")[i].alias(f"score_{i + 1}") for i in range(2)])


def _separation_sql(names: list[str]) -> str:
    """Squared distance d' S^-1 d per category by elimination: each variable in turn is taken out of those after it."""
    n = len(names)
    cov = [f"covar_samp({a}, {b}) AS s{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    gap = [f"avg(CASE WHEN label = 1 THEN {a} END) - avg(CASE WHEN label = 0 THEN {a} END) AS d{i}" for i, a in enumerate(names)]
    steps = [f"z0 AS (SELECT category, 0.0::DOUBLE AS q, {', '.join(cov + gap)} FROM vec GROUP BY 1)"]
    for k in range(n):
        left = [f"s{i}_{j} - s{k}_{i} * s{k}_{j} / s{k}_{k} AS s{i}_{j}" for i in range(k + 1, n) for j in range(i, n)]
        left += [f"d{i} - s{k}_{i} * d{k} / s{k}_{k} AS d{i}" for i in range(k + 1, n)]
        steps.append(f"z{k + 1} AS (SELECT {', '.join(['category', f'q + d{k} * d{k} / s{k}_{k} AS q', *left])} FROM z{k})")
    return f"{VEC}, {', '.join(steps)} SELECT category, sqrt(q) AS distance FROM z{n}"


@query("vec8_class_separation", _separation_sql(E4), approx=["distance"])
def separation(spark, sf):
    return vectors.class_separation(views.vectors(spark, sf), "category", E4)


@query("top5_top_categories")
def top_categories(spark, sf):
    found = vectors.class_separation(_wide(spark, sf), "category", _names())
    return vectors.top_categories(found, "category")


@query("top5_top_categories_four", f"{_separation_sql(E4)} ORDER BY distance DESC, category LIMIT 3", approx=["distance"])
def top_categories_four(spark, sf):
    return vectors.top_categories(vectors.class_separation(views.vectors(spark, sf), "category", E4), "category")


# Of e1, a linear function of it and e2 the first component follows from the correlation r of e1 and e2: with the first two
# as one variable of variance 2, the matrix is [[2, sqrt(2) r], [sqrt(2) r, 1]].
@query(
    "top2_top_components_three",
    f"""{VEC}, r AS (SELECT corr(e1, e2) AS r FROM vec), l AS (SELECT r, (3 + sqrt(1 + 8 * r * r)) / 2 AS l FROM r),
v AS (SELECT (l - 1) / sqrt((l - 1) * (l - 1) + 2 * r * r) AS u, sqrt(2) * abs(r) / sqrt((l - 1) * (l - 1) + 2 * r * r) AS w FROM l)
SELECT 'PC' AS prefix, 'e1' AS feature, u / sqrt(2) AS abs_loading FROM v UNION ALL SELECT 'PC', 'line', u / sqrt(2) FROM v UNION ALL SELECT 'PC', 'e2', w FROM v""",
    approx=["abs_loading"],
)
def top_components_three(spark, sf):
    rows = views.vectors(spark, sf).select("e1", (F.col("e1") * 2 + 1).alias("line"), "e2")
    return vectors.top_components(vectors.loadings_rows(spark, vectors.pca_fit(rows, ["e1", "line", "e2"], 3)), 1, 10)


# Two variables under one scaling, per class: covariances [[a, c], [c, b]], larger root l, first component (l - b, c).
CLASS_SQL = f"""{VEC}, z AS (SELECT vec_id, label, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS x, (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS y FROM vec),
k AS (SELECT label, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM z GROUP BY 1),
l AS (SELECT *, (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS l FROM k),
u AS (SELECT label, CASE WHEN label = 1 THEN 'Minority_PC' ELSE 'Majority_PC' END AS prefix, (l - b) / sqrt((l - b) * (l - b) + c * c) AS p, c / sqrt((l - b) * (l - b) + c * c) AS q FROM l)"""


def _class_pair(spark, sf, n):
    return vectors.class_pca_fit(views.vectors(spark, sf), "label", ["e1", "e2"], n)


@query(
    "top3_top_rank_components_pair",
    f"""{CLASS_SQL} SELECT 'e1' AS feature, CAST(sum(CASE WHEN abs(p) > abs(q) THEN 2 ELSE 1 END) AS BIGINT) AS score FROM u
UNION ALL SELECT 'e2', CAST(sum(CASE WHEN abs(p) > abs(q) THEN 1 ELSE 2 END) AS BIGINT) FROM u""",
)
def top_rank_pair(spark, sf):
    """By the first components of both classes."""
    return vectors.top_rank_components(vectors.loadings_rows(spark, *_class_pair(spark, sf, 1)), 10)


@query(
    "vec4_loadings_table_pair",
    f"""{CLASS_SQL}, w AS (SELECT *, least(abs(p), abs(q)) / greatest(abs(p), abs(q)) * 100 AS small FROM u)
SELECT prefix, 1 AS component, 'e1' AS feature, CASE WHEN abs(p) >= abs(q) THEN 100.0 ELSE small END AS percent FROM w
UNION ALL SELECT prefix, 1, 'e2', CASE WHEN abs(p) >= abs(q) THEN small ELSE 100.0 END FROM w
UNION ALL SELECT prefix, 2, 'e1', CASE WHEN abs(p) >= abs(q) THEN small ELSE 100.0 END FROM w
UNION ALL SELECT prefix, 2, 'e2', CASE WHEN abs(p) >= abs(q) THEN 100.0 ELSE small END FROM w""",
    approx=["percent"],
)
def loadings_pair(spark, sf):
    return vectors.loadings_table(vectors.loadings_rows(spark, *_class_pair(spark, sf, 2)), 10, 2).select("prefix", "component", "feature", "percent")


@query(
    "vec3_class_pca_pair",
    f"""{CLASS_SQL} SELECT vec_id, abs(x * p + y * q) AS first, abs(y * p - x * q) AS second FROM z JOIN u ON u.label = z.label""",
    approx=["first", "second"],
)
def class_pca_pair(spark, sf):
    """Scores on the components of a row's own class, up to sign."""
    rows = views.vectors(spark, sf)
    scored = vectors.class_pca_transform(rows, _class_pair(spark, sf, 2), ["vec_id", "label"])
    own = lambda i: F.abs(F.when(F.col("label") == 1, F.col(f"Minority_PC{i}")).otherwise(F.col(f"Majority_PC{i}")))
    return scored.select("vec_id", own(1).alias("first"), own(2).alias("second"))


# Countries weigh by the share w of their first component, and two standardised variables have shares (1 +- |c|) / 2.
@query(
    "vec7_global_components_pair",
    f"""{with_views('sm')}, r AS (SELECT Country, Date, quantity, lines, row_number() OVER (PARTITION BY Country ORDER BY Date) - 1 AS i, count(*) OVER (PARTITION BY Country) AS n FROM sm),
w AS (SELECT Country, max(i) AS s FROM r WHERE i % 12 = 0 AND i + 36 <= n GROUP BY 1),
c AS (SELECT w.Country, (1 + abs(corr(quantity, lines))) / 2 AS w FROM w JOIN r ON r.Country = w.Country AND r.i >= w.s AND r.i < w.s + 36 GROUP BY 1)
SELECT 1 AS component, sum(w * w) / sum(w) AS ratio, sum(w * w) / sum(w) AS cumulative FROM c
UNION ALL SELECT 2, sum(w * (1 - w)) / sum(w), 1.0 FROM c""",
    approx=["ratio", "cumulative"],
)
def global_components_pair(spark, sf):
    plain = {"trend": None, "period": None}
    latest = vectors.latest_components(vectors.sliding_pca(_panel(spark, sf), ["quantity", "lines"], 36, 12, plain))
    return vectors.global_components(latest).select("component", "ratio", "cumulative")


# A variable and a linear function of it have one component, the standardised variable times the root of two.
@query(
    "vec3_class_pca_line",
    f"""{VEC}, m AS (SELECT avg(e1) AS m, stddev_pop(e1) AS s FROM vec) SELECT vec_id, abs(sqrt(2) * (e1 - m) / s) AS score FROM vec, m""",
    approx=["score"],
    digits=5,
)
def class_pca_line(spark, sf):
    rows = views.vectors(spark, sf).select("vec_id", "label", "e1", (F.col("e1") * 2 + 1).alias("e2"))
    fits = vectors.class_pca_fit(rows, "label", ["e1", "e2"], 1)
    scored = vectors.class_pca_transform(rows, fits, ["vec_id", "label"])
    return scored.select("vec_id", F.abs(F.when(F.col("label") == 1, F.col("Minority_PC1")).otherwise(F.col("Majority_PC1"))).alias("score"))


@query(
    "top5_top_categories_pair",
    f"""{VEC}, s AS (SELECT category, avg(CASE WHEN label = 1 THEN e1 END) - avg(CASE WHEN label = 0 THEN e1 END) AS d1, avg(CASE WHEN label = 1 THEN e2 END) - avg(CASE WHEN label = 0 THEN e2 END) AS d2,
  var_samp(e1) AS a, var_samp(e2) AS b, covar_samp(e1, e2) AS c FROM vec GROUP BY 1)
SELECT category, sqrt((b * d1 * d1 - 2 * c * d1 * d2 + a * d2 * d2) / (a * b - c * c)) AS distance FROM s ORDER BY distance DESC, category LIMIT 3""",
    approx=["distance"],
)
def top_categories_pair(spark, sf):
    return vectors.top_categories(vectors.class_separation(views.vectors(spark, sf), "category", ["e1", "e2"]), "category")


# Two standardised variables load with equal weight on either component.
@query(
    "top2_top_components_pair",
    "SELECT 'PC' AS prefix, unnest(['e1', 'e2']) AS feature, sqrt(0.5)::DOUBLE AS abs_loading",
    approx=["abs_loading"],
)
def top_components_pair(spark, sf):
    fitted = vectors.pca_fit(views.vectors(spark, sf), ["e1", "e2"], 2)
    return vectors.top_components(vectors.loadings_rows(spark, fitted), 1, 10)


@query(
    "vec4_loadings_table_line",
    "SELECT unnest(['Majority_PC', 'Majority_PC', 'Minority_PC', 'Minority_PC']) AS prefix, unnest(['e1', 'e2', 'e1', 'e2']) AS feature, 100.0::DOUBLE AS percent",
    approx=["percent"],
)
def loadings_line(spark, sf):
    rows = views.vectors(spark, sf).select("label", "e1", (F.col("e1") * 2 + 1).alias("e2"))
    fits = vectors.class_pca_fit(rows, "label", ["e1", "e2"], 1)
    return vectors.loadings_table(vectors.loadings_rows(spark, *fits), 10, 1).select("prefix", "feature", "percent")


PAIRS = [(a, b) for i, a in enumerate(E4) for b in E4[i + 1 :]]


def spread_sql(value: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS \"first\", '{b}' AS \"second\", {value.replace('@a', a).replace('@b', b)} AS spread FROM vec" for a, b in PAIRS)
    return f"{VEC}, p AS ({parts}) SELECT * FROM p ORDER BY spread DESC LIMIT 1"


SPREAD_SQL = {
    "determinant": "var_samp(@a) * var_samp(@b) - pow(covar_samp(@a, @b), 2)",
    "trace": "var_pop(@a) + var_pop(@b)",
    "frobenius": "sqrt(pow(var_samp(@a), 2) + pow(var_samp(@b), 2) + 2 * pow(covar_samp(@a, @b), 2))",
    "range": "(max(@a) - min(@a)) * (max(@b) - min(@b))",
}


def _register_spread(method: str, value: str) -> None:
    @query(f"vec9_choose_components_{method}", spread_sql(value), approx=["spread"])
    def choose(spark, sf):
        return vectors.choose_components(views.vectors(spark, sf), E4, method)


for _method, _value in SPREAD_SQL.items():
    _register_spread(_method, _value)


# Eigenvalue lists as data: the sorted squares of four coordinates.
EIGEN_SQL = """lst AS (SELECT vec_id, category, list_reverse_sort([e1 * e1, e2 * e2, e3 * e3, e4 * e4]) AS ev FROM vec), ev AS (SELECT *, list_sum(ev) AS t FROM lst)"""


def _eigen_lists(spark, sf):
    values = F.sort_array(F.array(*[q(c) * q(c) for c in E4]), asc=False)
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x)
    rows = views.vectors(spark, sf).select(
        F.col("category").cast("string").alias(ENTITY), F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias(DATE), values.alias("eigenvalues")
    )
    shares = rows.withColumn("ratios", F.transform("eigenvalues", lambda x: x / total))
    running = F.transform("ratios", lambda x, i: F.aggregate(F.slice("ratios", 1, i + 1), F.lit(0.0), lambda s, y: s + y))
    return shares.withColumn("cumulative", running)


@query(
    "vec10_spectral_features",
    f"""{VEC}, {EIGEN_SQL} SELECT CAST(category AS VARCHAR) AS Country, CAST(DATE '2000-01-01' + CAST(vec_id AS INT) AS DATE) AS Date,
  1 + CAST((ev[1] / t < 0.95) AS INT) + CAST(((ev[1] + ev[2]) / t < 0.95) AS INT) + CAST(((ev[1] + ev[2] + ev[3]) / t < 0.95) AS INT) AS n_eigenvalues_95,
  ev[1] / t AS eigenvalue_ratio, -list_sum(list_transform(ev, lambda x: x / t * log2(x / t + 1e-10))) AS spectral_entropy, ev[1] / t AS pc1_ratio, (ev[1] + ev[2] + ev[3]) / t AS first3_ratio FROM ev""",
    approx=["eigenvalue_ratio", "spectral_entropy", "pc1_ratio", "first3_ratio"],
)
def spectral(spark, sf):
    return vectors.spectral_features(_eigen_lists(spark, sf))


@query(
    "vec11_aggregate_eigen",
    f"""{VEC}, {EIGEN_SQL}, c AS (SELECT category, i AS component, ev[i] AS x, list_sum(ev[1:i]) / t AS y FROM ev CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i))
SELECT CAST(category AS VARCHAR) AS Country, component, avg(x) AS eigenvalue, avg(y) AS cumulative FROM c GROUP BY 1, 2""",
    approx=["eigenvalue", "cumulative"],
)
def aggregate_mean(spark, sf):
    return vectors.aggregate_eigen(_eigen_lists(spark, sf), "mean")


@query(
    "vec11_aggregate_eigen_last",
    f"""{VEC}, {EIGEN_SQL}, c AS (SELECT category, vec_id, i AS component, ev[i] AS x, list_sum(ev[1:i]) / t AS y FROM ev CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i))
SELECT CAST(category AS VARCHAR) AS Country, component, arg_max(x, vec_id) AS eigenvalue, arg_max(y, vec_id) AS cumulative FROM c GROUP BY 1, 2""",
    approx=["eigenvalue", "cumulative"],
)
def aggregate_last(spark, sf):
    return vectors.aggregate_eigen(_eigen_lists(spark, sf), "last")


def knn_sql(distance: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.id, b.id AS neighbour, {distance} AS distance, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {distance}, b.id) AS INT) AS rank
FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 5"""


def _edges(spark, sf, metric):
    return neighbours.knn_edges(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, metric)


@query("vec12_knn_graph", knn_sql("list_distance(a.x, b.x)"), approx=["distance"])
def knn_graph(spark, sf):
    return _edges(spark, sf, "euclidean")


@query("vec12_knn_graph_cosine", knn_sql("1 - list_cosine_similarity(a.x, b.x)"), approx=["distance"])
def knn_cosine(spark, sf):
    return _edges(spark, sf, "cosine")


@query("vec12_knn_graph_manhattan", knn_sql("list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))"), approx=["distance"])
def knn_manhattan(spark, sf):
    return _edges(spark, sf, "manhattan")


@query(
    "vec12_graph_properties",
    f"""WITH k AS ({knn_sql("list_distance(a.x, b.x)")}), e AS (SELECT id, neighbour FROM k UNION SELECT neighbour, id FROM k), n AS (SELECT count(*) AS v FROM embeddings)
SELECT v AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e) / (v * v) AS edge_density FROM n""",
    approx=["edge_density"],
    digits=9,
)
def graph(spark, sf):
    return neighbours.graph_properties(_edges(spark, sf, "euclidean"), table(spark, sf, "embeddings"))
