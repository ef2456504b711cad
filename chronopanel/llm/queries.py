"""Registered queries of the operators, one per operator, with SQL texts where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel import ship
from chronopanel.llm import collocations, divergence, language, line_dedup, mixing, ngram_join, packing, pii, quality, secrets, simhash, spotsigs, topk_search
from chronopanel.llm.common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_language_id")
def op1(spark, sf):
    """Language of every document; learned from the rows that are not held out."""
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(docs, F.when(~held, F.col("lang")))
    found = language.identify(docs.select("doc_id", "text", held.alias("held")), model)
    return found.select("doc.doc_id", F.col("doc.held").alias("held_out"), "lang_pred", "score")


LINES_SQL = """
WITH lines AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), E'\\n') AS ls FROM documents))),
shared AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN s.k IS NULL THEN line END, E'\\n' ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN shared s ON lines.k = s.k GROUP BY rid, doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark, sf):
    """Documents without the lines that ten or more of them share."""
    done = line_dedup.dedup_lines(documents(spark, sf).select("doc_id", "text"))
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_mixing")
def op8(spark, sf):
    """How many words the mix takes of every document."""
    done = mixing.mix(documents(spark, sf).select("doc_id", "text", "source")).taken()
    return done.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SEARCH_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op10_topk_search", SEARCH_SQL)
def op10(spark, sf):
    """The ten best other vectors of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    best = topk_search.top_k(vectors, F.col("vec_id") % 100 == 0, apart="row")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op4_packing")
def op4(spark, sf):
    """Pieces of all documents with their sequences."""
    cut = packing.pieces(documents(spark, sf).select("doc_id", "text"))
    placed = packing.pack(cut.select(F.struct("doc.doc_id").alias("doc"), "piece", "start", "length", "ids_crc32"))
    return placed.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_simhash")
def op9(spark, sf):
    """Fingerprint and group of every document."""
    grouped = simhash.group(documents(spark, sf).select("doc_id", "text"))
    return grouped.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op7_spotsigs")
def op7(spark, sf):
    """Fingerprint of every document and of its edited text, which ends like the next document begins."""
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = spotsigs.fingerprints(docs).select("doc.doc_id", "doc.text", "sigs")
    met = spotsigs.with_next(own, "doc_id")
    n = F.length("doc.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("doc.text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    done = met.select("doc", "next.sigs", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn(
        "edited_sigs", spotsigs.signatures(F.col("edited"))
    )
    return done.select(
        "doc.doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("doc.sigs")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("doc.sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("doc.sigs"), F.col("sigs")).alias("near_next"),
    )


def _joined(spans):
    """kind:start:end of spans, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


@query("op6_secrets")
def op6(spark, sf):
    """Secrets in every document: the base findings and those the network adds."""
    docs = documents(spark, sf).select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    base = F.filter("findings", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("findings", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )


@query("op3_pii")
def op3(spark, sf):
    """Personal data in every document: the base spans and those the trees add."""
    docs = documents(spark, sf).select("doc_id", "text")
    found = pii.scan(docs, pii.fit(docs), keep=["doc_id"]).select("doc.doc_id", "base", "added")
    named = lambda spans: F.transform(
        spans,
        lambda s: F.struct(
            F.element_at(F.array(*map(F.lit, pii.KINDS)), s["no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{k}") for no, k in enumerate(pii.KINDS)],
        F.sha2(_joined(named(F.col("base"))), 256).alias("base_sha256"),
        _joined(named(F.array_sort(F.concat("base", "added")))).alias("spans"),
    )


@query("op2_quality")
def op2(spark, sf):
    """Quality of every document, from its text, its source and its source's language section."""
    docs = documents(spark, sf).select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    done = quality.score(docs, labels, F.col("source"), F.col("lang"))
    return done.select(
        "doc.doc_id", "quality", (F.col("quality") >= 0.5).alias("keep"), "doc_quality", "host_quality", "path_quality"
    )


DIVERGENCE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
ls AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
gt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
gs AS (
  SELECT g.lang, g.source, coalesce(ls.v, 0) AS v, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN ls ON g.lang = ls.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM gt GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source),
p AS (
  SELECT gs.lang, gs.source, k.term, coalesce(gt.n, 0) AS n,
    CAST(1 + 1000000000::HUGEINT * (coalesce(gt.n, 0) + 1) // (gs.total + gs.v) AS HUGEINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (ls.total + ls.v) AS HUGEINT) AS all_p
  FROM gs JOIN k ON gs.lang = k.lang JOIN ls ON ls.lang = gs.lang
  LEFT JOIN gt ON gt.lang = gs.lang AND gt.source = gs.source AND gt.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - all_p) * (p - all_p) // all_p AS value FROM p WHERE n > 0 AND p > all_p),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_divergence", DIVERGENCE_SQL)
def op11(spark, sf):
    """How far the sources of each language differ, and the terms each overuses."""
    return divergence.audit(documents(spark, sf).select("text", "lang", "source"))


@query("op13_ngram_join")
def op13(spark, sf):
    """Documents linked by the likeness of their five-word shingles."""
    done = ngram_join.join(documents(spark, sf).select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


COLLOCATIONS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) CROSS JOIN (VALUES (1), (2), (3)) AS ks(k)
  WHERE i + k - 1 <= len(ws)),
f AS (
  SELECT lang, k, phrase, any_value(w1) AS w1, CASE WHEN k > 1 THEN any_value(w2) END AS w2,
    CASE WHEN k > 2 THEN any_value(w3) END AS w3, count(*) AS n FROM g GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, 1 AS cut, x.n AS l, y.n AS r
  FROM c JOIN f x ON x.lang = c.lang AND x.k = 1 AND x.phrase = c.w1
  JOIN f y ON y.lang = c.lang AND y.k = c.k - 1 AND y.phrase = concat_ws(' ', c.w2, c.w3)
  UNION ALL
  SELECT c.lang, c.phrase, c.n, 2, x.n, y.n
  FROM c JOIN f x ON c.k = 3 AND x.lang = c.lang AND x.k = 2 AND x.phrase = c.w1 || ' ' || c.w2
  JOIN f y ON y.lang = c.lang AND y.k = 1 AND y.phrase = c.w3),
s AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
gone AS (
  SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.k = 2 AND y.k = 3 AND x.lang = y.lang
    AND (x.phrase = y.w1 || ' ' || y.w2 OR x.phrase = y.w2 || ' ' || y.w3) AND 100 * y.n >= 50 * x.n),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b ANTI JOIN gone USING (lang, phrase))
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def op12(spark, sf):
    """The phrases of two and three words that go together best, by language."""
    return collocations.collocations(documents(spark, sf).select("text", "lang"))
