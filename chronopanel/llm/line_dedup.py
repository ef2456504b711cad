"""Drop lines that many documents share: explode normalised lines, hash, count documents, drop, reassemble by position.

A line's key is the line with blanks stripped at both ends and A-Z lower-cased. Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines. Each row of the input is a document of its own,
also where ids or whole rows repeat. A null or empty text is one empty line, which has no key and stays. Rows with a
null id are treated like any other. An empty table gives an empty table. Input columns come back inside the struct
``doc``, so that no name of theirs can clash with the results.

Scale: keys travel as 128 bits of hash, never as text; counting merges before its shuffle. A key that holds more than
one part in ``HOT_PARTS`` of all lines is matched map-side (there are at most ``HOT_PARTS`` such keys, so that broadcast
has a bound whatever the corpus); all other keys are spread by a join in which none is larger than that share. Lines
are put together again inside the row from the positions to drop, in time linear in the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import BLANKS, ascii_lower, kept

HOT_PARTS = 2000

_KEY = ("h1", "h2")
_DOC = ("d1", "d2")


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of (id, text): equal keys have equal texts and so lose the same lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("string")
    return df.select(
        F.xxhash64(key, text).alias("d1"),
        F.xxhash64(text, F.lit("|"), key).alias("d2"),
        text.alias("whole"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
    )


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per keyed line: document, position, hash of the key, and 1 at the document's first line of that key."""
    keys = F.transform(F.split("whole", "\n", -1), line_key)
    hashed = F.transform(
        keys,
        lambda key, i: F.when(
            F.length(key) >= max(min_chars, 1),
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("k"), key).alias("h2"), i.alias("pos")),
        ),
    )
    ordered = docs.select(*_DOC, F.array_sort(F.array_compact(hashed)).alias("sorted"))
    marked = F.transform(
        "sorted",
        lambda x, i: F.struct(
            x["h1"].alias("h1"),
            x["h2"].alias("h2"),
            x["pos"].alias("pos"),
            F.when(i == 0, F.lit(1))
            .when(
                (F.get("sorted", i - 1)["h1"] == x["h1"]) & (F.get("sorted", i - 1)["h2"] == x["h2"]), F.lit(0)
            )
            .otherwise(F.lit(1))
            .alias("first"),
        ),
    )
    return ordered.select(*_DOC, F.inline(marked))


def dedup_lines(
    df: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text); ``n_lines`` counts the lines before dropping."""
    docs = _keyed(df, id_col, text_col)
    lines = _lines(docs, min_chars)
    per_key = lines.groupBy(*_KEY).agg(F.sum("first").alias("docs"), F.count("*").alias("rows"))
    shared = kept(per_key.where(F.col("docs") >= min_docs))
    total = shared.agg(F.sum("rows")).first()[0] or 0
    hot_rows = max(total // HOT_PARTS, 1000)
    hot = shared.where(F.col("rows") > hot_rows).select(*_KEY)
    rest = shared.where(F.col("rows") <= hot_rows).select(*_KEY)
    places = lines.select(*_DOC, *_KEY, "pos")
    dropped = (
        places.join(F.broadcast(hot), list(_KEY), "left_semi")
        .unionByName(places.join(F.broadcast(hot), list(_KEY), "left_anti").join(rest, list(_KEY), "left_semi"))
        .groupBy(*_DOC)
        .agg(F.collect_set("pos").alias("gone"))
    )
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    return (
        docs.join(dropped, list(_DOC), "left")
        .select("doc", "whole", "gone", F.split("whole", "\n", -1).alias("lines"))
        .select("doc", "whole", "gone", "lines", n.cast("long").alias("n_lines"))
        .select(
            "doc",
            "n_lines",
            F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.col("whole"))
            .otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
            .alias("kept_text"),
        )
    )
