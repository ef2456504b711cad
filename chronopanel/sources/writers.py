"""Writers and stored results."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.sources.readers import normalise_null_tokens


def write_catalogue(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_labels(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_panel(data: DataFrame | Mapping[str, DataFrame], path: str, subset: str) -> None:
    """Parquet partitioned by subset and split, so later reads prune to one of them."""
    frames = {"train": data} if isinstance(data, DataFrame) else dict(data)
    stacked = None
    for split, df in frames.items():
        part = normalise_null_tokens(df).withColumns({"subset": F.lit(subset), "split": F.lit(split)})
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    writer = stacked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("subset", "split").parquet(path)


def write_results(
    model: Transformer, train: DataFrame, test: DataFrame, folder: str, name: str, run_ts: str, params: Mapping
) -> None:
    """Transformed train and test rows plus a one-row parameter table, under (model, run)."""
    for split, df in (("train", train), ("test", test)):
        model.transform(df).withColumns(
            {"model": F.lit(name), "run_ts": F.lit(run_ts), "split": F.lit(split)}
        ).write.mode("append").partitionBy("model", "run_ts", "split").parquet(f"{folder}/rows")
    spark = train.sparkSession
    row = [(name, run_ts, json.dumps(dict(params), sort_keys=True))]
    spark.createDataFrame(row, "model STRING, run_ts STRING, params STRING").write.mode("append").parquet(
        f"{folder}/params"
    )


def read_results(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """Rows of the named run, or of the newest one; both filters prune partitions."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{folder}/rows").where(F.col("model") == name)
    if run is None:
        params = spark.read.parquet(f"{folder}/params").where(F.col("model") == name)
        run = params.agg(F.max("run_ts")).first()[0]
    return rows.where(F.col("run_ts").cast("string") == run)


def artefact_name(kind: str, params: Mapping) -> str:
    """Deterministic folder name: the kind, then its parameters in key order."""
    parts = [kind, *[f"{k}-{params[k]}" for k in sorted(params)]]
    return "_".join(str(p).replace("/", "-").replace(" ", "") for p in parts)


def _exists(path: str) -> bool:
    """Whether the path's own file system has it."""
    # A thread that has not used the session yet has no active one; this gives the one there is.
    sc = SparkSession.builder.getOrCreate().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def train_or_load(kind: str, params: Mapping, folder: str, fit) -> PipelineModel:
    """Load the model stored under this kind and parameters, or fit and store it."""
    path = f"{folder}/{artefact_name(kind, params)}"
    if _exists(path):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model
