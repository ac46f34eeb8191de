"""Acoustic models as a folder: a Parquet table of states and a JSON file with a version."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.aligner import Model

KIND, VERSION = "sonoweft-monophone", 1


class ModelError(ValueError):
    """A folder that holds no model that this version can read."""


def save(spark: SparkSession, model: Model, folder: str) -> None:
    rows = [(i, model.phones[i // (len(model.mean) // len(model.phones))], m.tolist(), v.tolist()) for i, (m, v) in enumerate(zip(model.mean, model.var, strict=True))]
    spark.createDataFrame(rows, "pdf int, phone string, mean array<double>, var array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/states")
    meta = spark.createDataFrame([(KIND, VERSION, list(model.phones), len(rows))], "kind string, version int, phones array<string>, states int")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Model:
    """The model of a folder; kind and version are checked before the states are read."""
    meta = spark.read.schema("kind string, version int, phones array<string>, states int").json(f"{folder}/meta").first()
    if meta is None or meta.kind != KIND:
        raise ModelError("not a model folder")
    if meta.version != VERSION:
        raise ModelError(f"model version {meta.version}; this version reads {VERSION}")
    rows = spark.read.parquet(f"{folder}/states").orderBy("pdf").collect()
    if [r.pdf for r in rows] != list(range(meta.states)):
        raise ModelError("the table of states is incomplete")
    return Model(tuple(meta.phones), np.array([r["mean"] for r in rows]), np.array([r["var"] for r in rows]))


def describe(spark: SparkSession, folder: str):
    """One row: kind, version, number of phones and states, feature dimension."""
    meta = spark.read.schema("kind string, version int, phones array<string>, states int").json(f"{folder}/meta")
    dim = spark.read.parquet(f"{folder}/states").agg(F.max(F.size("mean")).alias("dim"))
    return meta.select("kind", "version", F.size("phones").alias("phones"), "states").join(dim, F.lit(True))
