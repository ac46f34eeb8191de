"""A pipeline over documents: toxicity, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoweft.llm import decontam, packing, similar, toxicity
from sonoweft.llm.queries import vocabulary
from sonoweft.llm.shared import fresh, materialize
from sonoweft.session import ship

#: Texts with at least this score are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "score")
    return toxicity.score(docs, net, score).where(F.col(score) < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar.one_of_each(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    pieces = packing.cut(docs, vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and a packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
