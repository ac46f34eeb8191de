"""Iterative and numeric queries on the supplied tables; these are tested against plain numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import acoustic, estimation, intervals, sequences, statistics
from ..operators.features import AT_ONCE, mfcc_batches, pack
from ..session import dealt
from ..sources.stages import stored
from . import aligner
from .inputs import frames, table

#: Tones of the event types, as phones of a corpus of tones (Hz).
TONES = {"view": 220.0, "signup": 440.0, "click": 880.0, "purchase": 1760.0}
RATE = 16_000


#: Dimensions of an embedding.
DIM = 64


def tone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt (user and week), its speaker (the user), words in order with their length in ms; errors are silence."""
    utt = F.concat_ws("-", "user_id", F.weekofyear("ts"))
    ms = (60 + F.pmod(F.xxhash64("event_id"), F.lit(80))).cast("int")
    e = table(spark, sf_dir, "events").select(F.split(utt, "-")[0].alias("speaker"), utt.alias("utt"), "ts", "event_id", F.col("event_type").alias("phone"), ms.alias("ms"))
    return dealt(e, "speaker").groupBy("speaker", "utt").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "phone", "ms"))).alias("e"))


@lru_cache(1024)
def _tone(phone: str | None, ms: int) -> np.ndarray:
    t = np.arange(RATE * ms // 1000) / RATE
    return 0.4 * np.sin(2 * np.pi * TONES[phone] * t) if phone in TONES else np.zeros(len(t))


def sounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first columns are utt and its events with words, rate and samples at the end; a few utterances at a time."""
    kinds = pa.list_(pa.list_(pa.list_(pa.string())))
    for b in batches:
        for i in range(0, b.num_rows, AT_ONCE):
            part = b.slice(i, AT_ONCE)
            texts, audio = [], []
            for utt, events in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                wave = np.concatenate([np.zeros(RATE // 20), *[_tone(x["phone"], x["ms"]) for x in events], np.zeros(RATE // 20)])
                audio.append((wave + 0.01 * np.random.default_rng(zlib.crc32(utt.encode())).normal(size=len(wave))).astype(np.float32))
                texts.append([[[x["phone"]]] for x in events if x["phone"] in TONES])
            samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, audio)]).astype(np.int32)), pa.array(np.concatenate(audio)))
            kept = [k for k in range(part.num_columns) if k != 1]
            columns = [*[part.column(k) for k in kept], pa.array(texts, kinds), pa.array([RATE] * len(audio), pa.int32()), samples]
            yield pa.RecordBatch.from_arrays(columns, names=[*[part.schema.names[k] for k in kept], "words", "rate", "samples"])


def tone_audio(words: DataFrame) -> DataFrame:
    """Audio rows with the words (one pronunciation of one phone each): 50 ms of silence, the tones, 50 ms of silence."""
    return words.select("utt", "e").mapInArrow(sounded, "utt string, words array<array<array<string>>>, rate int, samples array<float>")


def tone_mfcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each coefficient of each utterance; audio and frames stay in the task that makes them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, feats in mfcc_batches(sounded(batches)):
            means = pa.array([x.mean(0) for x in feats], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in feats], pa.int64()), means], names=["utt", "frames", "means"])

    rows = tone_words(spark, sf_dir).select("utt", "e").mapInArrow(task, "utt string, frames long, means array<double>")
    return rows.select("utt", F.posexplode("means").alias("dim", "mean"), "frames").select("utt", "dim", "frames", F.round("mean", 3).alias("mean"))


def _tone_truth(words: DataFrame) -> DataFrame:
    start = F.aggregate(F.slice("e.ms", 1, F.col("i")), F.lit(50), lambda a, x: a + x) / 1000
    rows = words.select("utt", "e", F.posexplode("e").alias("i", "x")).select("utt", "i", F.col("x.phone").alias("label"), start.alias("time")).where(F.col("label") != "error")
    return rows.select("utt", (F.row_number().over(Window.partitionBy("utt").orderBy("i")) - 1).alias("pos"), "label", "time")


def _tone_begins(spans: DataFrame, time: str) -> DataFrame:
    w = Window.partitionBy("utt").orderBy("idx")
    return spans.where("label <> 'sil'").select("utt", (F.row_number().over(w) - 1).alias("pos"), "label", F.col(time).alias("time"))


def _tone_utterances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The words, and stored utterances with their frames in single precision."""
    words = tone_words(spark, sf_dir)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, feats in mfcc_batches(part.select(["utt", "speaker", "words", "samples"]) for part in sounded(batches)):
            yield pa.RecordBatch.from_arrays([*b.columns, pack(feats)], names=["utt", "speaker", "words", "feats"])

    utts = words.select("utt", "e", "speaker").mapInArrow(task, "utt string, speaker string, words array<array<array<string>>>, feats binary")
    return words, stored(utts.where(F.size("words") > 0), "tone-frames")


def tone_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the tones, aligns them, and compares the beginnings of phones with where the tones begin: per phone, shares within 10 to 50 ms."""
    words, utts = _tone_utterances(spark, sf_dir)
    model, _ = aligner.trained(utts, iterations=4)
    spans = aligner.aligned(utts, model).where("tier = 'phones'").withColumn("begin", F.col("start_frame") * 0.01)
    d = intervals.compared(_tone_truth(words), _tone_begins(spans, "begin"), ["utt", "pos", "label"], "time")
    return intervals.tolerances(d, [0.01, 0.02, 0.025, 0.05], ["label"])


def tone_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a second pass with features adapted to each user, and with boundaries refined at 1 ms: per pass, shares within 5 to 25 ms."""
    words, utts = _tone_utterances(spark, sf_dir)
    model, _ = aligner.trained(utts, iterations=4)
    spans = stored(aligner.aligned_twice(utts, model, min_count=200).where("tier = 'phones'").withColumn("begin", F.col("start_frame") * 0.01), "tone-spans")
    truth = _tone_truth(words)
    send = spark.sparkContext.broadcast(model)
    # words and spans meet before there is audio, which stays in the task that makes it
    rows = words.join(aligner.phone_spans(spans), "utt").select("utt", "e", "spans")
    refined = dealt(rows, "utt").mapInArrow(lambda batches: aligner.refined_batches(sounded(batches), send.value), aligner.REFINED)
    passes = [("frames", _tone_begins(spans, "begin")), ("refined", _tone_begins(refined, "begin"))]
    found = [intervals.compared(truth, got, ["utt", "pos", "label"], "time").withColumn("pass", F.lit(name)) for name, got in passes]
    return intervals.tolerances(found[0].union(found[1]), [0.005, 0.01, 0.025], ["pass"])


def mixture_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a mixture trained on embeddings: iteration, gaussians, loglike."""
    _, log = estimation.trained_mixture(table(spark, sf_dir, "embeddings"), "embedding", DIM, 4, 8)
    return spark.createDataFrame([(x["iteration"], x["gaussians"], round(x["loglike"], 4)) for x in log], "iteration int, gaussians int, loglike double")


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context tree over event triples, grown by gain, with leaves merged to a multiple of 8.

    Questions ask whether the left, centre or right label is in a set that
    clustering of the labels has formed.
    """
    c = sequences.context(frames(spark, sf_dir), "label", outside="#")
    sums = [F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")]
    rows = c.groupBy("left", "label", "right").agg(*sums).orderBy("left", "label", "right").collect()  # bounded by the labels
    stats = [({"left": r["left"], "label": r["label"], "right": r["right"]}, np.array([r["n"], r["sx"], r["sxx"]])) for r in rows]
    by_label: dict[str, np.ndarray] = {}
    for context, s in stats:
        by_label[context["label"]] = by_label.get(context["label"], 0) + s
    sets = estimation.question_sets(by_label)
    nodes = estimation.grown_tree(stats, [(k, values) for k in ("left", "label", "right") for values in sets], 0.5, 24)
    leaves = {n["leaf"]: sum(stats[i][1] for i in n["rows"]) for n in nodes if "leaf" in n}
    merged = estimation.merged_leaves(leaves, 8)
    out = [(n["id"], n.get("key"), n.get("yes_set"), n.get("yes"), n.get("no"), merged.get(n.get("leaf")), int(n["n"])) for n in nodes]
    return spark.createDataFrame(out, "node int, key string, yes_set array<string>, yes int, no int, leaf int, n long")


def lda_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three directions of the embeddings, and the classes' mean along each."""
    e = table(spark, sf_dir, "embeddings")
    p = estimation.lda_projection(statistics.scatter(e, "label", "embedding", DIM, augmented=True), DIM, 3)
    dots = [sum(F.col("embedding")[i].cast("double") * F.lit(float(v)) for i, v in enumerate(row)) for row in p]
    return e.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(d), 4).alias(f"mean{k}") for k, d in enumerate(dots)])


def speaker_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fMLLR: speaker = vec_id mod 3, pdf = label; rows of each transform and the gain per frame."""
    d = DIM
    e = table(spark, sf_dir, "embeddings").withColumn("speaker", F.col("vec_id") % 3)
    models = acoustic.diagonal_models(e, "label", "embedding", d)
    k = statistics.affine_k(e, "speaker", "label", "embedding", d, models)
    key = F.concat_ws(",", "speaker", "label")
    s = statistics.scatter(e.withColumn("sp", key), "sp", "embedding", d, augmented=True)
    s = s.select(F.split("key", ",")[0].cast("long").alias("speaker"), F.split("key", ",")[1].cast("int").alias("pdf"), "row", "sums")
    cells = s.join(models.select("pdf", F.posexplode("var").alias("i", "var")), "pdf")
    g = cells.groupBy("speaker", "i", "row").agg(F.array(*[F.sum(F.col("sums")[j] / F.col("var")) for j in range(d + 1)]).alias("sums"))
    out = estimation.fmllr_transforms(k, g, d, min_count=2 * (d + 1))
    return out.select("speaker", "row", F.transform("w", lambda x: F.round(x, 3)).alias("w"), F.round("gain", 4).alias("gain"))


def mllt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MLLT of the embeddings (class = label): its rows, and the gain per frame."""
    d = DIM
    rows = statistics.scatter(table(spark, sf_dir, "embeddings"), "label", "embedding", d, augmented=True).collect()  # d + 1 rows per class
    sums: dict[str, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r["key"], np.zeros((d + 1, d + 1)))[r["row"]] = r["sums"]
    beta = sum(s[d, d] for s in sums.values())
    inside = [s[:d, :d] - np.outer(s[d, :d], s[d, :d]) / s[d, d] for s in sums.values()]
    g = np.stack([sum(c / (c[j, j] / s[d, d]) for c, s in zip(inside, sums.values(), strict=True)) for j in range(d)])
    a = estimation.mllt_transform(beta, g)
    gain = (estimation.mllt_objective(a, beta, g) - estimation.mllt_objective(np.eye(d), beta, g)) / beta
    return spark.createDataFrame([(i, [round(float(x), 4) for x in row], round(float(gain), 5)) for i, row in enumerate(a)], "row int, a array<double>, gain double")


QUERIES = {
    "tone_mfcc": (tone_mfcc, None),
    "tone_alignment": (tone_alignment, None),
    "tone_refinement": (tone_refinement, None),
    "mllt_rows": (mllt_rows, None),
    "mixture_training": (mixture_training, None),
    "tree_leaves": (tree_leaves, None),
    "lda_directions": (lda_directions, None),
    "speaker_transforms": (speaker_transforms, None),
}
