"""Sufficient statistics: sums that merge from partial sums before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCATTER = "key string, row int, n double, sums array<double>"


def moments(frames: DataFrame, keys: list[str], vector: str, dim: int, weight: Column | None = None) -> DataFrame:
    """Per key: n, sx and sxx (arrays of sums of x and x^2 by dimension), weighted if asked."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(vector)[i].cast("double") for i in range(dim)]
    return frames.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.array(*[F.sum(w * v) for v in x]).alias("sx"), F.array(*[F.sum(w * v * v) for v in x]).alias("sxx")
    )


def smoothed(stats: DataFrame, tau: float) -> DataFrame:
    """Moments with ``tau`` more counts of their own average; a key without counts stays as it is."""
    more = F.when(F.col("n") == 0, 1.0).otherwise(1 + tau / F.col("n"))
    scaled = {c: F.transform(c, lambda s: s * F.col("_more")) for c in ("sx", "sxx")}
    return stats.withColumn("_more", more).withColumns(scaled | {"n": F.col("n") * F.col("_more")}).drop("_more")


def smoothed_with_model(stats: DataFrame, tau: float) -> DataFrame:
    """Moments with ``tau`` more counts of a model's Gaussian, by columns ``mean`` and ``square`` (of x^2) of each row."""
    add = lambda c, m: F.zip_with(c, m, lambda s, v: s + tau * v)
    return stats.withColumns({"sx": add("sx", "mean"), "sxx": add("sxx", "square"), "n": F.col("n") + tau}).drop("mean", "square")


def by_dimension(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Moments as rows: keys, n, dim, mean, var."""
    rows = stats.select(*keys, "n", F.posexplode(F.arrays_zip("sx", "sxx")).alias("dim", "s"))
    mean = F.col("s.sx") / F.col("n")
    return rows.select(*keys, "n", "dim", mean.alias("mean"), (F.col("s.sxx") / F.col("n") - mean * mean).alias("var"))


def normalised(frames: DataFrame, speaker: str, vector: str, dim: int) -> DataFrame:
    """Cepstral mean normalisation per speaker: the vectors without their speaker's mean.

    The statistics have one row per speaker; joined, not windowed, so that a
    speaker with most of the frames needs no task of its own.
    """
    stats = moments(frames, [speaker], vector, dim).select(F.col(speaker).alias("_speaker"), "n", "sx")
    joined = frames.join(stats, F.col(speaker).eqNullSafe(F.col("_speaker")))
    shifted = F.transform(vector, lambda x, i: x.cast("double") - F.col("sx")[i] / F.col("n"))
    return joined.withColumn(vector, shifted).drop("_speaker", "n", "sx")


def scatter(frames: DataFrame, key: str, vector: str, dim: int, augmented: bool = False) -> DataFrame:
    """Per key and row i: n and sum of x_i * x (with a last 1 if augmented).

    Each task adds up its own rows with numpy and sends dim rows per key it has
    met; these partial sums are added after the shuffle.
    """
    d = dim + augmented

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            x = np.array([v[:dim] for v in b.column(1).to_pylist()], np.float64).reshape(-1, dim)
            x = np.hstack([x, np.ones((len(x), 1))]) if augmented else x
            for k in set(keys):
                part = x[[i for i, y in enumerate(keys) if y == k]]
                s = held.setdefault(k, np.zeros((d, d + 1)))
                s[:, :d] += part.T @ part
                s[:, d] += len(part)
        rows = [(k, i, s[i, d], s[i, :d].tolist()) for k, s in held.items() for i in range(d)]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "row", "n", "sums"])

    sent = frames.where(F.col(vector).isNotNull()).select(F.col(key).cast("string"), vector).mapInArrow(task, SCATTER)
    return sent.groupBy("key", "row").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))


def affine_k(frames: DataFrame, speaker: str, pdf: str, vector: str, dim: int, models: DataFrame) -> DataFrame:
    """fMLLR statistics per speaker and dimension: beta and k_i = sum of mean_i / var_i * (x, 1).

    ``models`` has (pdf, mean, var); one Gaussian per pdf here, so each frame
    has weight 1. The frames are added up per speaker and pdf before the models join.
    """
    x = [*[F.col(vector)[j].cast("double") for j in range(dim)], F.lit(1.0)]
    sums = frames.groupBy(speaker, F.col(pdf).alias("_pdf")).agg(F.array(*[F.sum(v) for v in x]).alias("_s"), F.count("*").alias("_n"))
    ratio = F.zip_with(F.slice("mean", 1, dim), F.slice("var", 1, dim), lambda m, v: m / v)
    parts = sums.join(models.select(F.col("pdf").alias("_pdf"), ratio.alias("_ratio")), "_pdf").select(speaker, "_n", "_s", F.posexplode("_ratio").alias("dim", "_r"))
    return parts.groupBy(speaker, "dim").agg(F.sum("_n").alias("beta"), F.array(*[F.sum(F.col("_r") * F.col("_s")[j]) for j in range(dim + 1)]).alias("k")).select(speaker, "beta", "dim", "k")


def normalised_probabilities(counts: DataFrame, group: str, count: str, floor: float = 0.01, least: float = 5, rounds: int = 3) -> DataFrame:
    """Transition probabilities: floored and renormalised ``rounds`` times; groups with few counts or one row keep null."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(group)
    out = counts.withColumn("_total", F.sum(count).over(w)).withColumn("_kinds", F.count("*").over(w))
    out = out.withColumn("p", F.when((F.col("_total") >= least) & (F.col("_kinds") > 1), F.col(count) / F.col("_total")))
    for _ in range(rounds):
        out = out.withColumn("p", F.when(F.col("p").isNotNull(), F.greatest(F.col("p") / F.sum("p").over(w), F.lit(floor))))
    return out.drop("_total", "_kinds")


def split_gain(stats: DataFrame, node: list[str], yes: Column, floor: float = 0.01) -> DataFrame:
    """The gain in log-likelihood of splitting each node by a question: node, n_yes, n_no, gain.

    ``stats`` has n, sx and sxx (scalars) per node and whatever the question asks about.
    """
    side = stats.withColumn("_yes", F.coalesce(yes, F.lit(False)))
    s = lambda c, y: F.sum(F.when(F.col("_yes") == y, F.col(c)).otherwise(0.0))
    out = side.groupBy(*node).agg(*[s(c, y).alias(f"{c}_{k}") for c in ("n", "sx", "sxx") for k, y in (("yes", True), ("no", False))])
    return out.select(*node, F.col("n_yes"), F.col("n_no"), gain_of(out, floor).alias("gain"))


def gain_of(out: DataFrame, floor: float) -> Column:
    def objective(n: Column, sx: Column, sxx: Column) -> Column:
        var = sxx / n - (sx / n) * (sx / n)
        low = F.greatest(var, F.lit(floor))
        return F.when(n > 0, -0.5 * n * (F.lit(float(np.log(2 * np.pi))) + F.ln(low) + var / low)).otherwise(0.0)

    c = F.col
    whole = objective(c("n_yes") + c("n_no"), c("sx_yes") + c("sx_no"), c("sxx_yes") + c("sxx_no"))
    return objective(c("n_yes"), c("sx_yes"), c("sxx_yes")) + objective(c("n_no"), c("sx_no"), c("sxx_no")) - whole
