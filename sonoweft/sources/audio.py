"""PCM WAV files as rows of samples."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import resampled

AUDIO = "path string, rate int, samples array<float>, error string"


def decoded_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1..1: the mean of the channels; a cut-off tail is left out."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    raw = raw[: len(raw) // (channels * width) * channels * width]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 8_388_608
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / {2: 32_768, 4: 2_147_483_648}[width]
    return rate, x.reshape(-1, channels).mean(1)


def encoded_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples) * 32_767), -32_768, 32_767).astype("<i2").tobytes())
    return out.getvalue()


def read(spark: SparkSession, path: str, rate: int | None = 16_000) -> DataFrame:
    """path, rate, samples and error of every WAV file; a file that can't be read has an error and no samples."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    at, x = decoded_wav(data.as_py())
                    row = (name, rate or at, resampled(x, at, rate) if rate else x, None)
                except (wave.Error, EOFError, KeyError) as e:
                    row = (name, None, None, str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string()], strict=True)], names=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "content").mapInArrow(task, AUDIO)


def given(spark: SparkSession, sound: object, sample_rate: int | None = None, rate: int = 16_000) -> DataFrame:
    """One audio row of a path or of mono samples in memory.

    A path (text or a path object) has its own rate, so none may be given; samples are one-dimensional
    numbers and need theirs. Anything else is a TypeError, a rate that isn't positive a ValueError.
    """
    if isinstance(sound, (str, os.PathLike)):
        if sample_rate is not None:
            raise TypeError("sample_rate goes with samples in memory, not with a path")
        return read(spark, os.fspath(sound), rate)
    if sample_rate is None:
        raise TypeError("samples in memory need a sample_rate")
    if sample_rate <= 0:
        raise ValueError("sample_rate must be positive")
    try:
        x = None if isinstance(sound, (bytes, bytearray)) else np.asarray(sound, np.float64)
    except (TypeError, ValueError):
        x = None
    if x is None:
        raise TypeError("audio is a path, a one-dimensional array or a sequence of numbers")
    if x.ndim != 1:
        raise TypeError(f"audio must have one dimension (mono), not the shape {x.shape}")
    return spark.createDataFrame([(None, rate, resampled(x, sample_rate, rate).tolist(), None)], AUDIO)


def slices(audio: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """The samples of each span (key, start, end in seconds) of its audio: the columns of ``spans``, rate and samples.

    Ends are rounded to samples, halves upwards, and cut to what there is; a span that ends before it
    starts, or lies outside, has no samples. Spans of unknown audio are left out.
    """
    rows = spans.join(audio.select(key, F.col("rate").alias("_rate"), F.col("samples").alias("_samples")), key)
    at = lambda c: F.least(F.floor(F.greatest(F.col(c), F.lit(0.0)) * F.col("_rate") + 0.5), F.size("_samples")).cast("int")
    cut = F.slice("_samples", at("start") + 1, F.greatest(at("end") - at("start"), F.lit(0)))
    return rows.select(*[F.col(c) for c in spans.columns], F.col("_rate").alias("rate"), cut.alias("samples"))
