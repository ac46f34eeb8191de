"""From a folder of audio and transcripts to a model, and from a model to interval files."""

from __future__ import annotations

from collections.abc import Collection

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import human_duration, real_time_factor
from ..functions.text import speaker_name, without_extension, words_of
from ..operators.features import mfcc_rows
from ..operators.lexicon import looked_up
from ..sources import audio, dictionary, interval_files, listing
from . import aligner

FRAME = 0.01


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative) and text of all transcripts; of interval files the nonempty labels of the first tier."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{lab,txt,TextGrid,LAB,TXT,textgrid}").load(folder)
    top = folder.rstrip("/").split("://")[-1]
    return texts_of(files.select(F.substring_index("path", f"{top}/", -1).alias("path"), "content"))


def texts_of(files: DataFrame) -> DataFrame:
    """path and text of transcript files (path, content)."""
    grid = F.lower("path").endswith(".textgrid")
    spans = interval_files.read_back(files.where(grid).select("path", "content"))
    first = spans.groupBy("path").agg(F.min_by("tier", "idx").alias("_tier"))
    spans = spans.join(first, "path").where("tier = _tier AND trim(label) <> ''")
    texts = spans.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]), " ").alias("text"))
    return files.where(~grid).select("path", F.col("content").cast("string").alias("text")).union(texts)


def pronounced(texts: DataFrame, lexicon: DataFrame, unknown: str = "spn") -> DataFrame:
    """utt, words (array of words, each with all its pronunciations) and oov counts, from (utt, text)."""
    rows = texts.select("utt", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    found = looked_up(rows, lexicon, unknown)
    per_word = found.groupBy("utt", "pos").agg(F.sort_array(F.collect_list(F.struct("pron_idx", "phones"))).alias("p"), F.max(F.col("oov").cast("int")).alias("oov"))
    return per_word.groupBy("utt").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda w: w["p"]["phones"]).alias("words"), F.sum("oov").alias("oov"))


def normalised(utts: DataFrame) -> DataFrame:
    """Features without the mean of their speaker; sums per utterance are added per speaker."""
    total = F.aggregate("feats", F.array_repeat(F.lit(0.0), F.size(F.col("feats")[0])), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    sums = utts.where(F.size("feats") > 0).select("speaker", F.size("feats").alias("n"), F.posexplode(total).alias("i", "s"))
    mean = sums.groupBy("speaker", "i").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("_mean"))
    return utts.join(mean, "speaker").withColumn("feats", F.transform("feats", lambda x: F.zip_with(x, "_mean", lambda a, b: a - b))).drop("_mean")


def utterances(spark: SparkSession, folder: str, lexicon: DataFrame) -> DataFrame:
    """utt, speaker, words, oov, seconds, feats of every utterance with readable audio."""
    pairs = listing.scanned(spark, folder)
    top = folder.rstrip("/").split("://")[-1]
    sound = audio.read(spark, folder).where("error IS NULL").select(F.substring_index("path", f"{top}/", -1).alias("audio"), "rate", "samples")
    text = transcripts(spark, folder).select(F.col("path").alias("transcript"), "text")
    rows = pairs.join(text, "transcript").select(F.col("id").alias("utt"), "speaker", "audio", "text")
    rows = rows.join(pronounced(rows.select("utt", "text"), lexicon), "utt").join(sound, "audio")
    rows = rows.withColumn("seconds", F.size("samples") / F.col("rate"))
    return normalised(mfcc_rows(rows.select("utt", "speaker", "words", "oov", "seconds", "rate", "samples")))


def is_file(spark: SparkSession, text: str) -> bool:
    """Whether a text of one line names a file that exists, by the file system that it names."""
    if not text.strip() or "\n" in text:
        return False
    jvm = spark.sparkContext._jvm
    try:
        path = jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(path)
    except IllegalArgumentException:  # not a path
        return False
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "UnsupportedFileSystemException":
            raise  # a file system that can't be reached isn't a text
        return False


def single(spark: SparkSession, sound: object, transcript: str, lexicon: DataFrame, sample_rate: int | None = None, speaker: str | int = "folder", known: Collection[str] | None = None) -> DataFrame:
    """One utterance, with the columns of ``utterances``, of a path or samples and a transcript.

    A transcript that names an existing file is read from it. With ``known`` (the phones of a model) a
    phone outside it raises; so does audio that can't be read and a transcript without words.
    """
    heard = audio.given(spark, sound, sample_rate).select("path", "rate", "samples", "error")
    row = heard.select("path", "error").first()
    if row is None or row.error:
        raise ValueError(f"audio can't be read: {row.error if row else sound}")
    if is_file(spark, transcript):
        found = texts_of(spark.read.format("binaryFile").load(transcript).select("path", "content")).first()
        transcript = found.text if found else ""
    at = F.lit(row.path)
    utt = F.lit("utt") if row.path is None else without_extension(F.element_at(F.split(at, "/"), -1))
    name = F.lit("speaker") if row.path is None else speaker_name(at, speaker)
    words = pronounced(spark.createDataFrame([(transcript,)], "text string").select(utt.alias("utt"), "text"), lexicon)
    needed = {r.phone for r in words.select(F.explode(F.flatten(F.flatten("words"))).alias("phone")).distinct().collect()}
    if not needed:
        raise ValueError("the transcript has no words")
    if known is not None and (missing := sorted(needed - set(known))):
        raise ValueError(f"phones that the model doesn't have: {' '.join(missing)}")
    sound_row = heard.select(utt.alias("utt"), name.alias("speaker"), "rate", "samples")
    rows = words.join(sound_row, "utt").withColumn("seconds", F.size("samples") / F.col("rate"))
    return normalised(mfcc_rows(rows.select("utt", "speaker", "words", "oov", "seconds", "rate", "samples")))


def train(spark: SparkSession, folder: str, dictionary_path: str, iterations: int = 10) -> tuple[aligner.Model, list[float]]:
    return aligner.trained(utterances(spark, folder, dictionary.read(spark, dictionary_path)).persist(), iterations)


def align(utts: DataFrame, model: aligner.Model) -> DataFrame:
    """Intervals in seconds: utt, tier, idx, label, xmin, xmax, duration; words have their own labels."""
    spans = aligner.aligned(utts, model).join(utts.select(F.col("utt"), F.col("seconds").alias("duration")), "utt")
    end = F.least(F.round(F.col("end_frame") * FRAME, 6), F.col("duration"))
    return spans.select("utt", "tier", "idx", F.when(F.col("label") == aligner.SILENCE, "").otherwise(F.col("label")).alias("label"), F.round(F.col("start_frame") * FRAME, 6).alias("xmin"), end.alias("xmax"), "duration", "loglike")


def summary(utts: DataFrame, spans: DataFrame, shown: int = 10) -> DataFrame:
    """One row: utterances, aligned, the first ``shown`` failed ids in order, unknown words, seconds."""
    done = spans.select("utt").distinct().withColumn("done", F.lit(1))
    both = utts.select("utt", "oov", "seconds").join(done, "utt", "left")
    first = both.where("done IS NULL").select("utt").orderBy("utt").limit(shown).agg(F.sort_array(F.collect_list("utt")).alias("failed"))
    sums = both.agg(F.count("*").alias("utterances"), F.count("done").alias("aligned"), F.sum("oov").alias("oov"), F.sum("seconds").alias("seconds"))
    return sums.join(first, F.lit(True)).select("utterances", "aligned", "failed", "oov", "seconds")  # one row each


def timed(summaries: DataFrame, elapsed: float) -> DataFrame:
    """A summary with the audio's length as text and the time spent for each second of it."""
    return summaries.withColumn("audio", human_duration(F.col("seconds"))).withColumn("rtf", real_time_factor(F.lit(float(elapsed)), F.col("seconds")))


def write_textgrids(spans: DataFrame, folder: str, short: bool = False) -> DataFrame:
    """Writes a TextGrid file per utterance below ``folder`` and returns utt, path, bytes, kept in ``_written`` there."""
    files = interval_files.saved(interval_files.written(spans, short=short), folder)
    files.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_written")
    return spans.sparkSession.read.schema(files.schema).parquet(f"{folder.rstrip('/')}/_written")
