"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased and cut into words of letters and digits. Common words (``STOP``) are not content. Wherever content
follows an anchor (a frequent common word, with other common words between or not), the next ``chain`` content words,
common words in between skipped, form one signature, hashed to 64 bits; a chain at the end of a text may be shorter. The
fingerprint is the set of signatures. A text without any signature has one of its whole word sequence, and one without
words one of the text itself, so equal texts always have equal fingerprints. Likeness is the Jaccard index of the sets.

``near_pairs`` finds all pairs of distinct sets with likeness of at least ``threshold``. Sets are partitioned by length:
only sets whose lengths are within the threshold of each other can match, so a set meets its own partition and the next.
Within partitions sets meet by their rarest signatures: of a set of n only the first n - ceil(threshold * n) + 1 in
order of rarity can be the first it shares with a match. Candidates are then compared in full. Equal sets are one class
before anything is paired.

All on DataFrame functions. Null texts count as empty, repeated rows are documents of their own, empty tables give empty
results, and input columns come back inside the struct ``doc``. A very long text is one row's work, read whole.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept, let

#: Anchors, and common words that are never content (English, German, French, Spanish).
ANCHORS = "the of to and is der die und das le la de et el que en".split()
STOP = ANCHORS + (
    "a an in on at by for from with as it that this was are be or he she they his her not but have had has which you we "
    "den dem des ein eine einer einen zu von mit ist im auf für als auch es an bei nach nicht sich "
    "les un une du au aux il elle ce qui dans pour par sur pas ne est sont avec plus "
    "los las lo una al del y se su sus por para con no es son como más"
).split()

_MARK = "\u0001"
_GAP = r"[^\p{L}\p{N}]+"


def _any_of(words) -> str:
    return "|".join(sorted(set(words)))


def signatures(text: Column, chain: int = 2) -> Column:
    """Sorted distinct signatures of a text as 64-bit numbers; ``text`` must not be null."""
    # one blank between words, each with a blank before and after
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _GAP, " "), F.lit(" "))
    # common words go; a run of anchors becomes a mark on the content word that follows
    fewer = F.regexp_replace(plain, f"(?<= )(?:(?:{_any_of(set(STOP) - set(ANCHORS))}) )++", "")
    content = F.regexp_replace(fewer, f"(?<= )(?:(?:{_any_of(ANCHORS)}) )++", _MARK)
    words = F.filter(F.split(content, " "), lambda w: ~w.isin("", _MARK))

    def chains(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i))
        chain_at = lambda i: F.xxhash64(F.translate(F.array_join(F.slice(words, i + 1, chain), " "), _MARK, ""))
        return F.sort_array(F.array_distinct(F.transform(F.filter(marked, lambda i: i.isNotNull()), chain_at)))

    whole = let(F.trim(plain), lambda p: F.xxhash64(F.lit("whole"), F.when(p == "", text).otherwise(p)))
    return let(let(words, chains), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(whole)))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def as_text(sigs: Column) -> Column:
    """Signatures as hexadecimal digits, 16 each, joined."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def fingerprints(df: DataFrame, chain: int = 2, text_col: str = "text") -> DataFrame:
    """(doc, sigs) for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), signatures(text, chain).alias("sigs"))


def near_pairs(df: DataFrame, threshold: float = 0.8, chain: int = 2, id_col: str = "doc_id", text_col: str = "text"):
    """(classes, pairs): (id, class) of every row, and (a, b, likeness) of classes at least ``threshold`` alike.

    A class is a set of signatures, told apart by 128 bits of hash (``key``) and named by the smallest id with that set:
    null if no row of it has an id, and the same for two classes that share a repeated id. ``a`` is the smaller name,
    nulls first. Null and empty texts have the signature of an empty text.
    """
    rows = kept(fingerprints(df.select(id_col, text_col), chain, text_col).select(F.col(f"doc.{id_col}").alias("id"), "sigs"))
    key = F.concat(F.hex(F.xxhash64("sigs")), F.lit("-"), F.hex(F.xxhash64(F.lit("set"), "sigs")))
    named = rows.select("id", "sigs", key.alias("key"))
    sets = kept(named.groupBy("key").agg(F.min("id").alias("class"), F.first("sigs").alias("sigs")))
    classes = named.select("id", "key").join(sets.select("key", "class"), "key").select("id", "class", "key")
    each = sets.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    rare = kept(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    ranked = each.join(rare, "s", "left").select("key", "n", "s", F.coalesce("df", F.lit(1).cast("long")).alias("df"))
    order = Window.partitionBy("key").orderBy("df", "s")
    reach = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = ranked.withColumn("r", F.row_number().over(order)).where((F.col("r") <= reach) & (F.col("df") > 1))
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9) if threshold < 1 else F.col("n")
    left = prefix.select(F.col("key").alias("a_key"), F.col("n").alias("na"), "s", part.alias("part"))
    right = prefix.select(
        F.col("key").alias("b_key"), F.col("n").alias("nb"), "s", F.explode(F.array(part, part + 1, part - 1)).alias("part")
    )
    fits = (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(threshold) * F.col("na") - 1e-9)
    met = left.join(right, ["s", "part"]).where((F.col("a_key") < F.col("b_key")) & fits).select("a_key", "b_key").distinct()
    own = lambda name: sets.select(
        F.col("key").alias(f"{name}_key"), F.col("class").alias(name), F.col("sigs").alias(f"sigs_{name}")
    )
    scored = met.join(own("a"), "a_key").join(own("b"), "b_key")
    scored = scored.withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b"))).where(F.col("likeness") >= threshold)
    turned = F.col("b").isNull() | (F.col("a") > F.col("b"))
    end = lambda one, other, name: F.when(turned, F.col(other)).otherwise(F.col(one)).alias(name)
    pairs = scored.select(end("a", "b", "a"), end("b", "a", "b"), "likeness", end("a_key", "b_key", "a_key"), end("b_key", "a_key", "b_key"))
    return classes, pairs


def with_next(df: DataFrame, order_col: str, rows_per_range: int = 1000, most_ranges: int = 10_000) -> DataFrame:
    """(doc, next): every row with the next one in ascending order of a number, the last with the first.

    Rows are cut into ranges at approximate quantiles and ordered within each; a copy of the first row of a range stands
    at the end of the range before it, so that no row has to look beyond its range. Rows without a number come first, rows
    of equal number are ordered by a hash of the row. The number of ranges sets their size and no result.
    """
    cells = [F.col(f"`{c}`") for c in df.columns]
    by = F.col(f"`{order_col}`")
    n = df.select(by).count()
    ranges = min(most_ranges, max(1, n // rows_per_range))
    numbers = df.select(F.coalesce(by.cast("double"), F.lit(-1.7e308)).alias("number"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(numbers.approxQuantile("number", shares, 1 / (4 * ranges)))) if shares else []
    ends = [-float("inf"), *(cuts or [0.0]), float("inf")]
    placed = Bucketizer(splits=ends, inputCol="number", outputCol="range").transform(
        df.select(
            F.struct(*cells).alias("doc"),
            F.coalesce(by.cast("double"), F.lit(-1.7e308)).alias("number"),
            F.struct(by.alias("by"), F.xxhash64(*cells).alias("tie")).alias("place"),
            F.lit(0).alias("extra"),
        )
    ).select("doc", F.col("range").cast("int").alias("range"), "place", "extra")
    firsts = placed.groupBy("range").agg(F.min("place").alias("place"))  # most_ranges rows at most
    along = Window.orderBy("range")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select(
        F.col("range").alias("own"),
        F.col("place").alias("head"),
        F.coalesce(F.lag("range").over(along), F.max("range").over(whole)).alias("before"),
    )
    copies = placed.join(
        F.broadcast(heads), (F.col("range") == F.col("own")) & F.col("place").eqNullSafe(F.col("head"))
    ).select("doc", F.col("before").alias("range"), "place", F.lit(1).alias("extra"))
    order = Window.partitionBy("range").orderBy("extra", "place")
    rows = placed.unionByName(copies).select("doc", "extra", F.lead("doc").over(order).alias("next"))
    return rows.where("extra = 0").select("doc", "next")
