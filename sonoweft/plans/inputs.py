"""The supplied tables in the roles of a speech corpus, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: utt (user), t from 0, x (value), label (event type)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), "ts", "event_id", F.col("value").alias("x"), F.col("event_type").alias("label"))
    return numbered(e, "utt", ["ts", "event_id"]).select("utt", F.col("t").cast("long").alias("t"), "x", "label", "event_id", "ts")


FRAMES_SQL = """frames AS (
  SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x, event_type AS label, event_id, ts FROM events
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals in whole milliseconds of a day: they begin at the time of day and last 500 times the value."""
    e = table(spark, sf_dir, "events")
    begin = F.expr("cast((hour(ts) * 60 + minute(ts)) * 60000 + floor(extract(SECOND FROM ts) * 1000) AS long)")
    return e.select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("utt"), "event_id", begin.alias("xmin"),
        (begin + F.floor(F.col("value") * 500) + 1).cast("long").alias("xmax"), F.col("event_type").alias("label"),
    )


SPANS_SQL = """spans AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS utt, event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) // 1000 AS xmin,
    (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) // 1000 + floor(value * 500)::BIGINT + 1 AS xmax, event_type AS label FROM events
)"""


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as transcripts: doc_id, pos, raw (as written)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+")).alias("pos", "raw"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "raw")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as transcripts: doc_id, pos, word (normalised, nonempty)."""
    from ..functions.text import normalize_word

    return raw_words(spark, sf_dir).select("doc_id", "pos", normalize_word(F.col("raw")).alias("word")).where("word <> ''")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n: raw words are counted before they are normalised, so each distinct one is treated once.

    The word is made to depend on the count, or the filter on it would be pushed
    below the count and normalise every occurrence.
    """
    from ..functions.text import normalize_word

    raw = raw_words(spark, sf_dir).groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select(F.when(F.col("n") > 0, normalize_word(F.col("raw"))).alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark texts as a lexicon with letters as phones: word, pron_idx, phones."""
    from ..functions.text import words_of

    w = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return w.select("word", F.lit(0).alias("pron_idx"), F.filter(F.split("word", ""), lambda c: c != "").alias("phones"))


#: The marks at the edges of a word, for SQL (fixed values).
EDGE_SQL = "、。।，？！!@<>→\"”()“„–,.:;—¿?¡：）|؟\\&%#*،~【】，…‥「」『』〝〟″⟨⟩♪・‚‘‹›«»～′$+=‘۔―"


def _normal(word: str) -> str:
    bare = f"trim(lower({word}), '{EDGE_SQL}')"
    return f"CASE WHEN translate({bare}, '''’‘', '') = '' THEN '' ELSE {bare} END"


WORDS_SQL = f"""words AS (
  SELECT doc_id, pos, word FROM (
    SELECT doc_id, pos, {_normal("raw")} AS word FROM (
      SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+')) AS raw,
        unnest(range(len(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+')))) AS pos FROM documents)
  ) WHERE word <> ''
), vocabulary AS (
  SELECT DISTINCT word FROM (SELECT {_normal("raw")} AS word FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+')) AS raw FROM benchmark)) WHERE word <> ''
)"""
