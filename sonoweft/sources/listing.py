"""Corpus folders: finding audio and transcripts and pairing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, speaker_name, without_extension
from . import interval_files

#: Extensions in order of preference (fixed values).
AUDIO = ("wav", "flac", "mp3", "ogg", "opus", "m4a", "aiff", "aif")
TRANSCRIPTS = ("lab", "txt", "textgrid")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder) and length of every file below it; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    top = folder.rstrip("/").split("://")[-1]
    return files.select(F.substring_index("path", f"{top}/", -1).alias("path"), F.col("path").alias("uri"), "length")


def _preference(ext: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), ext)


def paired(files: DataFrame, speaker: str | int = "folder") -> DataFrame:
    """id (path without extension), audio, transcript and speaker; a file without its counterpart keeps null.

    Of several audio files or transcripts of one id the first by kind, then path, is taken.
    """
    f = files.select("path", without_extension(F.col("path")).alias("id"), extension(F.col("path")).alias("ext"))
    pick = lambda kinds: F.min(F.when(F.col("ext").isin(*kinds), F.struct(_preference(F.col("ext"), kinds).alias("k"), "path")))["path"]
    out = f.groupBy("id").agg(pick(AUDIO).alias("audio"), pick(TRANSCRIPTS).alias("transcript")).where("audio IS NOT NULL OR transcript IS NOT NULL")
    return out.withColumn("speaker", speaker_name(F.coalesce("audio", "transcript"), speaker))


def scanned(spark: SparkSession, folder: str, speaker: str | int = "folder") -> DataFrame:
    """The utterances of a folder with audio and transcript, by id; raises if there is none."""
    out = paired(listed(spark, folder), speaker).where("audio IS NOT NULL AND transcript IS NOT NULL").orderBy("id")
    if out.isEmpty():
        raise ValueError(f"no audio with a transcript below {folder}")
    return out


def with_durations(spark: SparkSession, folder: str, audio_folder: str | None = None) -> DataFrame:
    """id, audio, textgrid and duration of every audio file, by id.

    Intervals without audio beside them take audio of the same stem below ``audio_folder`` (of several
    the first path). The duration is where the intervals end; audio that has none yet has a null
    there. Files below folders whose name starts with a dot aren't listed.
    """
    plain = lambda f: f.where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))
    files = plain(listed(spark, folder))
    both = paired(files.where(~extension(F.col("path")).isin("lab", "txt"))).select("id", "audio", F.col("transcript").alias("textgrid"))
    if audio_folder:
        stem = lambda c: F.element_at(F.split(c, "/"), -1)
        other = paired(plain(listed(spark, audio_folder))).where("audio IS NOT NULL").groupBy(stem(F.col("id")).alias("_stem")).agg(F.min("audio").alias("_other"))
        lone = F.when(F.col("audio").isNull(), stem(F.col("id")))
        both = both.withColumn("_lone", lone).join(other, F.col("_lone") == F.col("_stem"), "left").select("id", F.coalesce("audio", "_other").alias("audio"), "textgrid")
    grids = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][eE][xX][tT][gG][rR][iI][dD]").load(folder)
    ends = interval_files.ends(grids.select(F.substring_index("path", f"{folder.rstrip('/').split('://')[-1]}/", -1).alias("textgrid"), "content"))
    return both.where("audio IS NOT NULL").join(ends, "textgrid", "left").select("id", "audio", "textgrid", "duration").orderBy("id")
