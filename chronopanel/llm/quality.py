"""Document quality by hierarchical empirical Bayes: a classifier's evidence, corrected by what host and path are like.

*Document.* A logistic regression on features of the text (shares of kinds of characters, word lengths, repetition) gives
each document a probability of being good. It is fitted on at most ``max_rows`` labelled rows, expected, chosen by hash
(a documented bound). With fewer than two labels to tell apart, the probability is the labelled share, or one half.
*Sites.* Probabilities are summed per path of a host and per host. The expected quality of a host is shrunk to the global
mean, that of a path to its host's: a site of n documents keeps n / (n + k) of its own mean. k is the variance within
sites over the variance between them, estimated from all sites by moments, so sparse sites lean on their parents and hosts
that differ little lean on the whole. A document's own evidence is left out of its sites' sums.
*Both.* The document's log odds move by the distance in log odds from the global mean to its path's expectation.

Null texts count as empty. Null hosts or paths are sites of their own. Labels that repeat a document count by their mean,
rows that repeat an id each stay a row. Rows without an id are scored and never learned from. Empty tables give empty
results. Input columns come back inside the struct ``doc``, so their names cannot clash.

Scale: text is read once and features, not texts, are checkpointed. Site sums merge before their shuffle. A site that
holds a third of all rows meets its rows in a join of two checkpointed tables, whose partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import WORD, kept

FEATURES = ("size", "letters", "capitals", "digits", "blanks", "signs", "word_length", "distinct_words", "distinct_lines")
_EDGE = 1e-6


def _features(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    without = lambda p: F.length(F.regexp_replace(text, p, ""))
    words, lines = F.split(F.lower(text), r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    return {
        "size": F.log1p(F.length(text)),
        "letters": 1 - without(r"\p{L}+") / n,
        "capitals": 1 - without(r"\p{Lu}+") / n,
        "digits": 1 - without("[0-9]+") / n,
        "blanks": 1 - without(r"[\x20\x09-\x0D]+") / n,
        "signs": 1 - without(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'-]+") / n,
        "word_length": F.log1p(n / (F.regexp_count(text, F.lit(WORD)) + 1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def _evidence(rows: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``rows`` with the probability p of the document's own text."""
    labelled = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.avg("label").alias("label"))
    sample = rows.join(labelled, "id").select((F.col("label") >= 0.5).cast("double").alias("label"), *FEATURES, F.xxhash64("id").alias("place"))
    n = sample.count()
    share = F.pmod("place", F.lit(1 << 20)) < F.lit(int(min(1.0, max_rows / max(n, 1)) * (1 << 20)))
    drawn = kept(sample.where(share))
    mean = drawn.agg(F.avg("label")).first()[0]
    if mean is None or mean in (0.0, 1.0):
        return rows.withColumn("p", F.lit(0.5 if mean is None else float(mean)))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="raw")
    train = assemble.transform(drawn)
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(maxIter=50, regParam=0.001).fit(scale.transform(train))
    scored = model.transform(scale.transform(assemble.transform(rows)))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def _strength(groups: DataFrame, mean: str | float) -> float:
    """k: variance within groups over variance between their means and ``mean``, by moments; groups have n, s, ss."""
    m = F.lit(mean) if isinstance(mean, float) else F.col(mean)
    r = groups.agg(
        F.sum("n").alias("all"),
        F.count("*").alias("groups"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - m) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not r["groups"] or r["all"] <= r["groups"]:
        return 1.0
    within = max(r["within"] / (r["all"] - r["groups"]), 1e-9)
    spread = max(r["all"] - r["squares"] / r["all"], 1.0)
    between = (r["between"] - (r["groups"] - 1) * within) / spread
    return within / max(between, within * 1e-6)


def score(
    df: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    max_rows: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, doc_quality, host_quality, path_quality, quality); ``labels`` has (id, label), label from 0 to 1."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [c for c in df.columns if c != text_col]
    rows = kept(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
            F.col(id_col).alias("id"),
            F.struct(host.cast("string").alias("host")).alias("h"),
            F.struct(host.cast("string").alias("host"), path.cast("string").alias("path")).alias("hp"),
            *[v.alias(c) for c, v in _features(text).items()],
        )
    )
    rows = kept(_evidence(rows, labels, max_rows).select("doc", F.xxhash64("h.host", F.col("h.host").isNull()).alias("host"), F.xxhash64("hp", F.lit(1)).alias("path"), "p"))
    sums = (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = kept(rows.groupBy("path", "host").agg(*sums))
    hosts = kept(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    if total is None:
        total = 0.5
    m = float(total)
    k_host = _strength(hosts, m)
    of_host = hosts.select("host", (F.col("s") / F.col("n")).alias("host_mean"))
    k_path = _strength(paths.join(of_host, "host"), "host_mean")
    sites = kept(
        paths.select("host", "path", F.col("n").alias("n_path"), F.col("s").alias("s_path")).join(
            hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), "host"
        ).drop("host")
    )
    met = rows.join(sites, "path")
    others = lambda n: F.col(n) - 1
    host_quality = (F.col("s_host") - F.col("p") + k_host * m) / (others("n_host") + k_host)
    with_host = met.withColumn("host_quality", host_quality)
    path_quality = (F.col("s_path") - F.col("p") + k_path * F.col("host_quality")) / (others("n_path") + k_path)
    odds = lambda x: F.log(F.greatest(F.least(x, F.lit(1 - _EDGE)), F.lit(_EDGE)) / (1 - F.greatest(F.least(x, F.lit(1 - _EDGE)), F.lit(_EDGE))))
    both = odds(F.col("p")) + odds(F.col("path_quality")) - odds(F.lit(m))
    return with_host.withColumn("path_quality", path_quality).select(
        "doc", F.col("p").alias("doc_quality"), "host_quality", "path_quality", (1 / (1 + F.exp(-both))).alias("quality")
    )
