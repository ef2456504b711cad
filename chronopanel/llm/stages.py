"""The operators as steps of a corpus pipeline: documents in, documents out, with every other column kept.

Rows may repeat ids, hold nulls in any column or no text at all, and tables may be empty; each step says what becomes of
such rows. Steps that rewrite ``text`` set ``n_chars`` to its new length in code points, if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import language, line_dedup, mixing, packing, simhash
from chronopanel.llm.common import let


def _with_text(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """The input rows with another text."""
    fields = df.schema[doc].dataType
    new = {"text": text}
    if "n_chars" in fields.names:
        new["n_chars"] = F.length(text).cast(fields["n_chars"].dataType)
    return df.select(*[new[c].alias(c) if c in new else F.col(doc)[c].alias(c) for c in fields.names])


def keep_identified(docs: DataFrame, least_score: float = 0.5, least_likeness: float = 0.6) -> DataFrame:
    """Documents whose language is known; those without a letter (null texts too) or in no learned language go.

    The answer has to be likely among the learned languages, and the text's average gram not too far from what is typical
    of that language towards what it never has: other languages and junk lie below. A null ``lang`` becomes the answer.
    """
    found = language.identify(docs, language.fit(docs, F.col("lang")))
    sure = (F.col("lang_pred") != language.UND) & (F.col("score") >= least_score) & (F.col("likeness") >= least_likeness)
    named = {"lang": F.coalesce("doc.lang", "lang_pred")}
    return found.where(sure).select(*[named.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_shared_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Documents without the lines that ``min_docs`` of them share; a document that loses all lines stays, empty."""
    done = line_dedup.dedup_lines(docs, min_docs)
    text = F.when((F.col("n_dropped") == 0) & F.col("doc.text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    return _with_text(done, "doc", text)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id; of rows that repeat an id, one by hash."""
    d1, d2 = mixing.row_key(docs)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), d1.alias("d1"), d2.alias("d2"))
    named = keyed.select(F.struct("doc.doc_id", "d1", "d2").alias("id"), F.col("doc.text").alias("text"))
    groups = simhash.group(named, id_col="id")
    ours = groups.where(F.col("id") == F.col("component")).select("id.d1", "id.d2").distinct()
    return (
        keyed.join(ours, ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.first("doc").alias("doc")).select("doc.*")
    )


def take_mixture(docs: DataFrame, block_words: int = 512) -> DataFrame:
    """The words that the mix takes: copy r of a document holds those of its words that are taken r times or more.

    Documents taken whole keep their text as it is; of others, words stay with the blanks that follow them. Documents of
    which nothing is taken, those without words among them, go.
    """
    mixture = mixing.mix(docs, block_words)
    row = list(mixing.ROW)
    pieces = mixture.runs().select(
        *row,
        F.inline(
            F.array(
                F.struct(F.col("low").alias("a"), F.col("part").alias("b"), (F.col("times") + 1).alias("n")),
                F.struct(F.col("part").alias("a"), F.col("high").alias("b"), F.col("times").alias("n")),
            )
        ),
    ).where("a < b AND n > 0")
    copies = (
        pieces.select(*row, "a", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        .groupBy(*row, "copy")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("words"))
        .select("d1", "d2", F.when(F.col("words") < F.col("size"), F.col("spans")).alias("spans"))
    )
    d1, d2 = mixing.row_key(docs)
    # equal rows have equal texts: any of them stands for its key
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), d1.alias("d1"), d2.alias("d2"))
    met = texts.groupBy("d1", "d2").agg(F.first("doc").alias("doc")).join(copies, ["d1", "d2"])
    lead = r"^[\x20\x09-\x0D]+"
    words = F.split(F.regexp_replace("doc.text", lead, ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = lambda own, s: F.slice(own, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))
    cut = let(words, lambda own: F.array_join(F.flatten(F.transform("spans", lambda s: part(own, s))), ""))
    return _with_text(met, "doc", F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(cut))


def pack_sequences(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids and sequences; documents that repeat an id are told apart by ``doc_key``."""
    d1, d2 = mixing.row_key(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64(d1, d2).alias("doc_key"))
    cut = packing.pieces(keyed, capacity, tokenizer)
    slim = cut.select(F.struct("doc.doc_id", "doc.doc_key").alias("doc"), "piece", "start", "length", "ids_crc32")
    return packing.pack(slim, capacity).select(
        "doc.doc_id", "doc.doc_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
