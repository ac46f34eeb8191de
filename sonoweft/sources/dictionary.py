"""Pronunciation dictionaries of plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMBER = r"^[0-9]+\.[0-9]+$"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Entries of (line, value): word, pron_idx, phones, prob, sil_after, sil_before, nonsil_before.

    Blank lines and those that begin with ``;`` or ``#`` are left out. Up to four
    numbers may follow the word: none, one (prob), two, or four; of three the
    last is a phone. A line needs a phone. Of equal pronunciations of a word the
    first line stays.
    """
    parts = lines.select("line", F.filter(F.split(F.trim("value"), "[ \t\r]+"), lambda x: x != "").alias("p"))
    parts = parts.where(F.size("p") > 1).where(~F.col("p")[0].rlike("^[;#]"))
    is_number = [F.coalesce(F.get("p", F.lit(i)).rlike(_NUMBER), F.lit(False)) for i in range(1, 5)]
    run = F.when(~is_number[0], 0).when(~is_number[1], 1).when(~is_number[2], 2).when(~is_number[3], 2).otherwise(4)
    e = parts.withColumn("k", run).withColumn("phones", F.slice("p", F.col("k") + 2, F.size("p"))).where(F.size("phones") > 0)
    at = lambda i: F.when(F.col("k") >= i, F.get("p", F.lit(i)).cast("double"))
    e = e.select("line", F.col("p")[0].alias("word"), "phones", at(1).alias("prob"), at(2).alias("sil_after"), F.when(F.col("k") == 4, at(3)).alias("sil_before"), F.when(F.col("k") == 4, at(4)).alias("nonsil_before"))
    first = F.row_number().over(Window.partitionBy("word", "phones").orderBy("line")) == 1
    e = e.withColumn("_first", first).where("_first")
    return e.withColumn("pron_idx", F.row_number().over(Window.partitionBy("word").orderBy("line")) - 1).drop("_first", "line")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a dictionary file; lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parsed_lines(lines)
