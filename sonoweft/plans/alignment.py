"""Run, interval, lexicon-probability and decoding queries on the supplied tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import acoustic, intervals, lexicon, sequences
from ..sources.interval_files import ctm
from .inputs import FRAMES_SQL, SPANS_SQL, frames, spans, table

#: Milliseconds of the cells in which spans are joined.
WIDTH = 60_000


def phone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(frames(spark, sf_dir), "label").select("utt", "run", "label", "start", "length")


RUNS_SQL = f"""{FRAMES_SQL}, marked AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM frames WINDOW w AS (PARTITION BY utt ORDER BY t)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY t)::BIGINT - 1 AS run FROM marked),
runs AS (SELECT utt, run, label, min(t) AS start, count(*) AS length FROM islands GROUP BY ALL)"""
PHONE_RUNS = f"WITH {RUNS_SQL} SELECT * FROM runs"


def word_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as phones, three phones a word, silences alone: word, first and end frame, phones."""
    w = Window.partitionBy("utt").orderBy("run")
    r = sequences.runs(frames(spark, sf_dir), "label").where("label <> 'error'")
    r = r.withColumn("word", F.floor((F.row_number().over(w) - 1) / 3)).groupBy("utt", "word")
    return r.agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("phones"), F.sum("length").alias("frames"))


WORD_INTERVALS = f"""WITH {RUNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY run) AS k FROM runs WHERE label <> 'error')
SELECT utt, (k - 1) // 3 AS word, min(start) AS first, max(start + length) AS "end", count(*) AS phones, sum(length)::BIGINT AS frames FROM k GROUP BY ALL"""


def interval_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gap_filled(spans(spark, sf_dir))


GAP_SQL = f"{SPANS_SQL}, prior AS (SELECT *, coalesce(max(xmax) OVER (PARTITION BY utt ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM spans)"
INTERVAL_GAP_FILL = f"WITH {GAP_SQL} SELECT utt, xmin, xmax, label FROM prior UNION ALL SELECT utt, p, xmin, '' FROM prior WHERE xmin > p"


def interval_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("utt", (F.col("xmin") / 1000.0).alias("xmin"), (F.col("xmax") / 1000.0).alias("xmax"), "label")
    return intervals.clamped(s, F.lit(86_000.0), 0.02)


INTERVAL_CLAMP = f"""WITH {SPANS_SQL}, s AS (SELECT utt, xmin / 1000.0e0 AS a, xmax / 1000.0e0 AS b, label FROM spans),
p AS (SELECT *, greatest(a, coalesce(max(b) OVER (PARTITION BY utt ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo, least(b, 86000.0e0) AS hi FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY hi DESC, lo DESC) AS r FROM p WHERE hi > lo)
SELECT utt, round(lo, 6) AS xmin, round(CASE WHEN r = 1 AND 86000.0e0 - hi < 0.02e0 THEN 86000.0e0 ELSE hi END, 6) AS xmax, label FROM k"""


def word_phone_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    words = s.where("label = 'view'").withColumn("xmax", F.col("xmin") + 14_400_000)
    out = intervals.inside_by_midpoint(s.where("label = 'click'"), words, "utt", 60 * WIDTH)
    return out.select(F.col("p.event_id").alias("phone"), F.col("w.event_id").alias("word"))


WORD_PHONE_MIDPOINT = f"""WITH {SPANS_SQL} SELECT p.event_id AS phone, w.event_id AS word FROM spans p JOIN spans w ON p.utt = w.utt AND (p.xmin + p.xmax) / 2 >= w.xmin AND (p.xmin + p.xmax) / 2 < w.xmin + 14400000
WHERE p.label = 'click' AND w.label = 'view'"""


def silence_outside_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return intervals.outside(s.where("label = 'error'"), s.where("label <> 'error'"), "utt", WIDTH).select("event_id", "utt", "xmin")


SILENCE_OUTSIDE_WORDS = f"""WITH {SPANS_SQL} SELECT event_id, utt, xmin FROM spans s WHERE label = 'error' AND NOT EXISTS
(SELECT 1 FROM spans w WHERE w.utt = s.utt AND w.label <> 'error' AND s.xmin >= w.xmin AND s.xmin < w.xmax)"""


def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of 60 columns, more than some utterances have samples."""
    p = intervals.peaks(frames(spark, sf_dir), 60)
    return p.select("utt", F.col("pixel").cast("long").alias("pixel"), "low", "high")


WAVEFORM_PEAKS = f"""WITH {FRAMES_SQL}, n AS (SELECT utt, count(*) AS n FROM frames GROUP BY utt), c AS (SELECT utt, n, unnest(range(60)) AS pixel FROM n)
SELECT c.utt, pixel, min(x) AS low, max(x) AS high FROM c JOIN frames f ON f.utt = c.utt AND f.t >= pixel * n // 60 AND f.t < greatest((pixel + 1) * n // 60, pixel * n // 60 + 1) GROUP BY ALL"""


def boundary_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as boundaries in two alignments; the second is off by half the tax."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utt"), F.col("l_linenumber").alias("pos"), "l_quantity", "l_tax")
    a = li.select("utt", "pos", (F.col("l_quantity") / 100).alias("time"))
    b = li.select("utt", "pos", (F.col("l_quantity") / 100 + F.col("l_tax") / 2).alias("time"))
    d = intervals.compared(a, b, ["utt", "pos"], "time").withColumn("all", F.lit("all")).withColumn("difference", F.round("difference", 9))
    return intervals.tolerances(d, [0.01, 0.02, 0.025, 0.05], ["all"])


BOUNDARY_TOLERANCE = """WITH a AS (SELECT l_orderkey AS utt, l_linenumber AS pos, l_quantity / 100 AS time, l_quantity / 100 + l_tax / 2 AS other FROM lineitem),
d AS (SELECT round(abs(x.time - y.other), 9) AS d FROM a x JOIN a y USING (utt, pos))
SELECT 'all' AS "all", count(*) AS n, round(avg(CASE WHEN d <= 0.01e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_01, round(avg(CASE WHEN d <= 0.02e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_02,
  round(avg(CASE WHEN d <= 0.025e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_025, round(avg(CASE WHEN d <= 0.05e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_05, round(median(d), 6) AS median, round(avg(d), 6) AS mean FROM d"""


def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames(spark, sf_dir).select("label", F.round(F.abs(F.col("x") / 1000 - F.floor(F.col("x") / 10) / 100), 9).alias("difference"))
    return intervals.tolerances(d, [0.005, 0.01], ["label"])


ACCURACY_BY_CLASS = f"""WITH {FRAMES_SQL}, d AS (SELECT label, round(abs(x / 1000 - floor(x / 10) / 100), 9) AS d FROM frames)
SELECT label, count(*) AS n, round(avg(CASE WHEN d <= 0.005e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_005, round(avg(CASE WHEN d <= 0.01e0 THEN 1.0e0 ELSE 0 END), 6) AS within_0_01, round(median(d), 6) AS median, round(avg(d), 6) AS mean FROM d GROUP BY label"""


def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.best_split(frames(spark, sf_dir).withColumn("x", F.round(F.col("x") - 245, 2)))


BEST_SPLIT = f"""WITH {FRAMES_SQL}, s AS (SELECT utt, t, round(sum(round(x - 245, 2)) OVER (PARTITION BY utt ORDER BY t), 6) AS g FROM frames), r AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY g DESC, t) AS r FROM s)
SELECT utt, t + 1 AS split, g AS gain FROM r WHERE r = 1"""


def token_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user and day as words, errors as silence."""
    e = table(spark, sf_dir, "events")
    utt = F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd"))
    rows = sequences.numbered(e.select(utt.alias("utt"), "ts", "event_id", F.col("event_type").alias("word")), "utt", ["ts", "event_id"])
    return lexicon.merged_tokens(rows, F.col("word") == "error")


TOKENS_SQL = """raw AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS utt, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS t, event_type AS word, event_type = 'error' AS silence FROM events),
kept AS (SELECT utt, t, word, silence FROM (SELECT *, silence AND coalesce(lag(silence) OVER (PARTITION BY utt ORDER BY t), false) AS again FROM raw) WHERE NOT again),
tokens AS (SELECT utt, t, word, silence FROM kept UNION ALL SELECT utt, min(t) - 1, '<s>', false FROM kept GROUP BY utt UNION ALL SELECT utt, max(t) + 1, '</s>', false FROM kept GROUP BY utt)"""
TOKEN_SEQUENCE = f"WITH {TOKENS_SQL} SELECT * FROM tokens"


def lexprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence probabilities of each word from token sequences."""
    return lexicon.silence_probabilities(lexicon.word_pairs(token_sequence(spark, sf_dir)))


LEXPROB = f"""WITH {TOKENS_SQL}, ahead AS (SELECT utt, t, word, silence, lead(word) OVER w AS n1, lead(silence) OVER w AS s1, lead(word, 2) OVER w AS n2 FROM tokens WINDOW w AS (PARTITION BY utt ORDER BY t)),
pairs AS (SELECT word, CASE WHEN s1 THEN n2 ELSE n1 END AS next, CASE WHEN s1 THEN 1.0e0 ELSE 0.0e0 END AS s FROM ahead WHERE NOT silence AND n1 IS NOT NULL AND CASE WHEN s1 THEN n2 ELSE n1 END IS NOT NULL),
g AS (SELECT avg(s) AS p FROM pairs), a AS (SELECT word, count(*) AS n, (sum(s) + 2 * any_value(g.p)) / (count(*) + 2) AS p FROM pairs, g GROUP BY word),
b AS (SELECT next AS word, (sum(s) + 2) / (sum(p) + 2) AS sb, (sum(1 - s) + 2) / (sum(1 - p) + 2) AS nb FROM pairs JOIN a USING (word) GROUP BY next)
SELECT coalesce(a.word, b.word) AS word, n AS n_after, CASE WHEN p IS NOT NULL THEN greatest(0.01e0, least(0.99e0, round(p, 2))) END AS sil_after,
  CASE WHEN sb IS NOT NULL THEN round(greatest(0.01e0, sb), 6) END AS sil_before, CASE WHEN nb IS NOT NULL THEN round(greatest(0.01e0, nb), 6) END AS nonsil_before FROM a FULL JOIN b ON a.word = b.word"""


def pron_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").select(F.col("event_type").alias("word"), F.floor(F.col("value") / 100).cast("long").alias("pron"))
    return lexicon.pronunciation_probabilities(uses)


PRON_PROBABILITIES = """WITH c AS (SELECT event_type AS word, floor(value / 100)::BIGINT AS pron, count(*) AS n FROM events GROUP BY ALL)
SELECT word, pron, n, greatest(0.01e0, least(0.99e0, round((n + 1) / (max(n) OVER (PARTITION BY word) + 1), 2))) AS prob FROM c"""

#: A two-state model: the cost of a frame in each state, of moving and of beginning.
LEVELS, SPREAD = (150.0, 350.0), 100.0
MOVES, BEGIN = ((0.2, 1.8), (1.6, 0.3)), (0.7, 0.7)


def viterbi_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("costs", F.array(*[F.pow((F.col("x") - m) / SPREAD, 2) for m in LEVELS]))
    d = acoustic.decoded(f, "utt", "t", "costs", np.array(MOVES), np.array(BEGIN))
    return d.groupBy("utt").agg(F.count("*").alias("n"), F.round(F.max("total"), 4).alias("cost"))


VITERBI_COST = f"""WITH RECURSIVE {FRAMES_SQL}, c AS (SELECT utt, t, power((x - {LEVELS[0]}) / {SPREAD}, 2) AS c0, power((x - {LEVELS[1]}) / {SPREAD}, 2) AS c1 FROM frames),
v AS (
  SELECT utt, t, {BEGIN[0]}::DOUBLE + c0 AS a, {BEGIN[1]}::DOUBLE + c1 AS b FROM c WHERE t = 0
  UNION ALL
  SELECT c.utt, c.t, least(a + {MOVES[0][0]}, b + {MOVES[1][0]}) + c0, least(a + {MOVES[0][1]}, b + {MOVES[1][1]}) + c1 FROM v JOIN c ON c.utt = v.utt AND c.t = v.t + 1
)
SELECT utt, t + 1 AS n, round(least(a, b), 4) AS cost FROM v QUALIFY row_number() OVER (PARTITION BY utt ORDER BY t DESC) = 1"""


def equal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames dealt evenly to the states of a five-state left-to-right model, with the mean of each state."""
    f = frames(spark, sf_dir)
    a = acoustic.equally_aligned(f.groupBy("utt").agg(F.count("*").alias("n")), "utt", "n", 5)
    return a.join(f, ["utt", "t"]).groupBy("utt", "state").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


EQUAL_ALIGNMENT = f"""WITH {FRAMES_SQL}, n AS (SELECT utt, count(*) AS n FROM frames GROUP BY utt)
SELECT utt, (t * 5 // n.n)::INTEGER AS state, count(*) AS n, round(avg(x), 6) AS mean FROM frames JOIN n USING (utt) WHERE n.n >= 5 GROUP BY ALL"""


def ctm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctm(spans(spark, sf_dir).select("utt", "xmin", "xmax", "label"))


CTM_LINES = f"""WITH {SPANS_SQL} SELECT utt || ' 1 ' || (xmin // 1000) || '.' || lpad((xmin % 1000)::VARCHAR, 3, '0') || ' ' || ((xmax - xmin) // 1000) || '.' || lpad(((xmax - xmin) % 1000)::VARCHAR, 3, '0') || ' ' || label AS line FROM spans"""


QUERIES = {
    "phone_runs": (phone_runs, PHONE_RUNS),
    "word_intervals": (word_intervals, WORD_INTERVALS),
    "interval_gap_fill": (interval_gap_fill, INTERVAL_GAP_FILL),
    "interval_clamp": (interval_clamp, INTERVAL_CLAMP),
    "word_phone_midpoint": (word_phone_midpoint, WORD_PHONE_MIDPOINT),
    "silence_outside_words": (silence_outside_words, SILENCE_OUTSIDE_WORDS),
    "waveform_peaks": (waveform_peaks, WAVEFORM_PEAKS),
    "boundary_tolerance": (boundary_tolerance, BOUNDARY_TOLERANCE),
    "accuracy_by_class": (accuracy_by_class, ACCURACY_BY_CLASS),
    "best_split": (best_split, BEST_SPLIT),
    "token_sequence": (token_sequence, TOKEN_SEQUENCE),
    "lexprob": (lexprob, LEXPROB),
    "pron_probabilities": (pron_probabilities, PRON_PROBABILITIES),
    "viterbi_cost": (viterbi_cost, VITERBI_COST),
    "equal_alignment": (equal_alignment, EQUAL_ALIGNMENT),
    "ctm_lines": (ctm_lines, CTM_LINES),
}
