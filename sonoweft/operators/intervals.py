"""Interval tables: filling, clamping, pairing, peaks and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_filled(spans: DataFrame, utt: str = "utt", begin: str = "xmin", end: str = "xmax", label: str = "label") -> DataFrame:
    """The spans and an empty one wherever time passes before the next (in utterances from 0 on): utt, xmin, xmax, label."""
    w = Window.partitionBy(utt).orderBy(begin, end)
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(spans.schema[end].dataType))
    marked = spans.withColumn("_from", before)
    gaps = marked.where(F.col(begin) > F.col("_from")).select(utt, F.col("_from").alias("xmin"), F.col(begin).alias("xmax"), F.lit("").alias("label"))
    return marked.select(utt, F.col(begin).alias("xmin"), F.col(end).alias("xmax"), F.col(label).alias("label")).union(gaps)


def clamped(spans: DataFrame, duration: Column, snap: float, utt: str = "utt") -> DataFrame:
    """Spans that start no earlier than the one before ends and end within the duration; empty ones go.

    The last span ends at the duration if it ends within ``snap`` of it. Equal to
    the sequential rule, since what has ended so far is a running maximum.
    """
    w = Window.partitionBy(utt).orderBy("xmin", "xmax")
    so_far = F.coalesce(F.max("xmax").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = spans.withColumn("_d", duration).withColumn("_a", F.greatest("xmin", so_far)).withColumn("_b", F.least("xmax", "_d"))
    out = out.where("_b > _a")
    last = F.row_number().over(Window.partitionBy(utt).orderBy(F.desc("_b"), F.desc("_a"))) == 1
    out = out.withColumn("_last", last)
    snapped = F.when(F.col("_last") & (F.col("_d") - F.col("_b") < snap), F.col("_d")).otherwise(F.col("_b"))
    return out.select(utt, F.round("_a", 6).alias("xmin"), F.round(snapped, 6).alias("xmax"), "label")


def inside_by_midpoint(parts: DataFrame, wholes: DataFrame, utt: str, width: float) -> DataFrame:
    """Parts joined to the wholes that hold their midpoint; both have xmin, xmax.

    Time is cut into cells of ``width``: a whole is sent to each cell it touches,
    a part to the cell of its midpoint, so the join is on (utt, cell).
    """
    mid = (F.col("xmin") + F.col("xmax")) / 2
    p = parts.withColumn("_mid", mid).withColumn("_cell", F.floor(mid / width)).alias("p")
    w = wholes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("xmin") / width), F.floor(F.col("xmax") / width)))).alias("w")
    same = (F.col(f"p.{utt}") == F.col(f"w.{utt}")) & (F.col("p._cell") == F.col("w._cell"))
    return p.join(w, same & (F.col("p._mid") >= F.col("w.xmin")) & (F.col("p._mid") < F.col("w.xmax")))


def outside(spans: DataFrame, wholes: DataFrame, utt: str, width: float) -> DataFrame:
    """Spans whose start lies in none of the wholes (same cells as above)."""
    s = spans.withColumn("_cell", F.floor(F.col("xmin") / width)).alias("s")
    w = wholes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("xmin") / width), F.floor(F.col("xmax") / width)))).alias("w")
    same = (F.col(f"s.{utt}") == F.col(f"w.{utt}")) & (F.col("s._cell") == F.col("w._cell"))
    return s.join(w, same & (F.col("s.xmin") >= F.col("w.xmin")) & (F.col("s.xmin") < F.col("w.xmax")), "left_anti").drop("_cell")


def peaks(samples: DataFrame, pixels: int, utt: str = "utt", t: str = "t", x: str = "x") -> DataFrame:
    """Lowest and highest sample of each of ``pixels`` columns; with fewer samples than columns a sample fills several."""
    n = samples.groupBy(utt).agg(F.count("*").alias("n")).withColumnRenamed(utt, "_utt")
    columns = n.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))))
    few = columns.where(F.col("n") < pixels).withColumn("t", F.expr(f"pixel * n div {pixels}"))
    many = samples.join(n.where(F.col("n") >= pixels), F.col(utt) == F.col("_utt"))
    # column p holds samples floor(p n / px) to floor((p + 1) n / px) - 1
    many = many.select(F.col(utt), F.expr(f"(({t} + 1) * {pixels} - 1) div n").alias("pixel"), F.col(x).alias("x"))
    some = few.join(samples.withColumnRenamed(t, "_t"), (F.col("_utt") == F.col(utt)) & (F.col("t") == F.col("_t"))).select(F.col(utt), F.col("pixel").cast("long").alias("pixel"), F.col(x).alias("x"))
    return many.union(some).groupBy(utt, "pixel").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Boundaries of two alignments at the same place: keys and the absolute difference."""
    other = b.select(*keys, F.col(time).alias("_other"))
    return a.join(other, keys).select(*keys, F.abs(F.col(time) - F.col("_other")).alias("difference"))


def tolerances(differences: DataFrame, limits: list[float], keys: list[str], digits: int = 6) -> DataFrame:
    """Per key: n, the share within each limit, median and mean difference.

    Equal differences are counted before they meet, so a key with most of the
    rows costs as much as it has different values; round them beforehand.
    """
    each = differences.where("difference IS NOT NULL").groupBy(*keys, "difference").agg(F.count("*").alias("_n"))
    share = lambda c: F.round(F.sum(c * F.col("_n")) / F.sum("_n"), digits)
    shares = [share((F.col("difference") <= x).cast("double")).alias(f"within_{x:g}".replace(".", "_")) for x in limits]
    return each.groupBy(*keys).agg(F.sum("_n").alias("n"), *shares, F.round(F.percentile("difference", F.lit(0.5), F.col("_n")), digits).alias("median"), share(F.col("difference")).alias("mean"))
