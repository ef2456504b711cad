"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.schema import PanelError, cut_lineage

#: Characters that separate words and are stripped from lines, fixed by the contracts.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the fast built-in serves wherever the text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that what follows reads them and never recomputes them."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise PanelError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        base = tempfile.gettempdir()
    return f"{base}/chronopanel-{name}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own on whatever file system it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
