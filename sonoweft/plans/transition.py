"""Transition models and alignments in transition ids on the supplied tables, with their SQL.

Event types are phones, errors silence; each run of a type is a phone whose
frames take the one path of that length through its states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import acoustic, sequences, statistics
from ..operators import transitions as tr
from .alignment import RUNS_SQL
from .inputs import FRAMES_SQL, frames, table

#: Left neighbours that the tree tells from all others.
NEAR = ("view", "click")
TAU = 25.0


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = table(spark, sf_dir, "events").select(F.col("event_type").alias("phone")).distinct()
    return tr.topology(phones, F.col("phone") == "error")


def monophones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shape(spark, sf_dir)
    return tr.model(s, tr.monophone_pdfs(s))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a tree that asks of the left neighbour: left, phone, state, pdf; a row for each state and neighbour, as a model's table is."""
    own = tr.monophone_pdfs(shape(spark, sf_dir))
    lefts = own.select(F.col("phone").alias("left")).union(spark.range(1).select(F.lit(""))).distinct()
    return own.join(F.broadcast(lefts), F.lit(True)).select("left", "phone", "state", (F.col("pdf") * 2 + F.col("left").isin(*NEAR).cast("int")).alias("pdf"))


_PATH = {
    "state": "CASE WHEN label = 'error' THEN CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END WHEN k = 0 THEN 0 WHEN k = length - 1 THEN 2 ELSE 1 END",
    "to": "CASE WHEN label = 'error' THEN CASE WHEN k = 0 THEN 3 WHEN k < length - 1 THEN 4 ELSE 5 END WHEN k = length - 1 THEN 3 WHEN k = 0 AND length > 2 THEN 1 WHEN k >= length - 2 THEN 2 ELSE 1 END",
}


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, t and the model's columns; a silence of fewer than three frames has no path and is left out."""
    r = sequences.runs(frames(spark, sf_dir), "label").where("label <> 'error' OR length > 2")
    f = r.select("utt", "run", "label", "start", "length", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("k"))
    f = f.select("utt", "run", (F.col("start") + F.col("k")).alias("t"), F.col("label").alias("phone"), F.expr(_PATH["state"]).alias("state"), F.expr(_PATH["to"]).alias("to"))
    return f.join(monophones(spark, sf_dir), ["phone", "state", "to"])


def _ends(n: int, quiet: bool) -> str:
    return "[" + ", ".join(f"{{'state': {s}, 'idx': {i}, 'to': {to}, 'p': {p!r}::DOUBLE}}" for s, i, to, p in tr.arcs_of(n, quiet)) + "]"


MODEL_SQL = f"""phones AS (SELECT DISTINCT event_type AS phone FROM events),
arcs AS (SELECT phone, unnest(CASE WHEN phone = 'error' THEN {_ends(5, True)} ELSE {_ends(3, False)} END, recursive := true) FROM phones),
shape AS (SELECT *, "to" = state AS self_loop, "to" = CASE WHEN phone = 'error' THEN 5 ELSE 3 END AS final FROM arcs),
own AS (SELECT phone, state, row_number() OVER (ORDER BY phone, state) - 1 AS pdf, row_number() OVER (ORDER BY phone, state) AS tstate FROM (SELECT DISTINCT phone, state FROM shape)),
model AS (SELECT own.*, idx, "to", p, self_loop, final, row_number() OVER (ORDER BY tstate, idx) AS tid FROM own JOIN shape USING (phone, state))"""
ALIGNED_SQL = f"""{RUNS_SQL}, {MODEL_SQL}, k AS (SELECT *, unnest(range(length)) AS k FROM runs WHERE label <> 'error' OR length > 2),
path AS (SELECT utt, run, start + k AS t, label AS phone, {_PATH["state"]} AS state, {_PATH["to"]} AS "to" FROM k),
aligned AS (SELECT * FROM path JOIN model USING (phone, state, "to"))"""
COUNTED_SQL = f"""{ALIGNED_SQL}, c AS (SELECT m.*, coalesce(n, 0) AS n FROM model m LEFT JOIN (SELECT tid, count(*) AS n FROM aligned GROUP BY tid) USING (tid)),
q0 AS (SELECT *, sum(n) OVER s AS total, count(*) OVER s AS kinds, n / sum(n) OVER s AS q FROM c WINDOW s AS (PARTITION BY tstate)),
q1 AS (SELECT * REPLACE (greatest(q / sum(q) OVER (PARTITION BY tstate), 0.01e0) AS q) FROM q0), q2 AS (SELECT * REPLACE (greatest(q / sum(q) OVER (PARTITION BY tstate), 0.01e0) AS q) FROM q1),
q3 AS (SELECT * REPLACE (greatest(q / sum(q) OVER (PARTITION BY tstate), 0.01e0) AS q) FROM q2),
learned AS (SELECT * EXCLUDE (q, n, total, kinds) REPLACE (CASE WHEN total >= 5 AND kinds > 1 THEN q ELSE p END AS p) FROM q3)"""


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.reestimated(monophones(spark, sf_dir), aligned(spark, sf_dir).groupBy("tid").agg(F.count("*").alias("n")))


def transition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transition id with its lookups, and the frames that the alignment gives it."""
    n = aligned(spark, sf_dir).groupBy("tid").agg(F.count("*").alias("n"))
    return monophones(spark, sf_dir).join(n, "tid", "left").select("tid", "tstate", "phone", "state", "pdf", "idx", "self_loop", "final", rounded(F.ln("p")).alias("log_p"), F.coalesce("n", F.lit(0)).alias("n"))


TRANSITION_IDS = f"""WITH {ALIGNED_SQL} SELECT m.tid, m.tstate, m.phone, m.state, m.pdf, m.idx, m.self_loop, m.final, round(ln(m.p), 6) + 0.0e0 AS log_p, count(a.tid) AS n
FROM model m LEFT JOIN aligned a ON m.tid = a.tid GROUP BY ALL"""


def transition_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned(spark, sf_dir).select("tid", rounded(F.col("p")).alias("p"))


TRANSITION_LEARNED = f"WITH {COUNTED_SQL} SELECT tid, round(p, 6) AS p FROM learned"


def tid_phone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.phones_of(tr.visits(aligned(spark, sf_dir)))


TID_PHONE_RUNS = f"""WITH {ALIGNED_SQL}, s AS (SELECT utt, phone, state, t, final, coalesce(sum(final::INTEGER) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS nth FROM aligned)
SELECT utt, nth, arg_min(phone, t) AS phone, min(t) AS start, count(*) AS length, arg_min(state, t) = 0 AND bool_or(final) AS ok FROM s GROUP BY utt, nth"""


def self_loops_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment with self-loops after the forward transition of their state."""
    return tr.in_order(tr.visits(aligned(spark, sf_dir))).select("utt", "t", "tid")


SELF_LOOPS_LAST = f"""WITH {ALIGNED_SQL}, v AS (SELECT *, coalesce(sum((NOT self_loop)::INTEGER) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS visit FROM aligned)
SELECT utt, min(t) OVER (PARTITION BY utt, visit) + row_number() OVER (PARTITION BY utt, visit ORDER BY self_loop, t) - 1 AS t, tid FROM v"""


def _converted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers = tree(spark, sf_dir)
    new = tr.model(shape(spark, sf_dir), answers)
    return tr.converted(tr.visits(aligned(spark, sf_dir)), answers, new), new, answers


def converted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by transition id of the monophones and of the model whose tree asks of the left neighbour."""
    return _converted(spark, sf_dir)[0].groupBy("tid", "new_tid").agg(F.count("*").alias("n"), F.min("t").alias("first"))


_CONVERTED_SQL = f"""{ALIGNED_SQL}, lefts AS (SELECT phone AS near FROM phones UNION ALL SELECT ''),
answers AS (SELECT near, phone, state, pdf * 2 + (near IN {NEAR})::INTEGER AS pdf FROM own CROSS JOIN lefts),
tuples AS (SELECT *, row_number() OVER (ORDER BY phone, state, pdf) AS tstate FROM (SELECT DISTINCT phone, state, pdf FROM answers)),
new AS (SELECT tuples.*, idx, p, row_number() OVER (ORDER BY tstate, idx) AS new_tid FROM tuples JOIN shape USING (phone, state)),
s AS (SELECT *, coalesce(sum(final::INTEGER) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS nth FROM aligned),
o AS (SELECT utt, nth, coalesce(lag(arg_min(phone, t)) OVER (PARTITION BY utt ORDER BY nth), '') AS near FROM s GROUP BY utt, nth),
both_ids AS (SELECT s.utt, s.t, s.tid, s.pdf AS old_pdf, new.pdf AS new_pdf, new_tid FROM s JOIN o USING (utt, nth) JOIN answers a ON a.near = o.near AND a.phone = s.phone AND a.state = s.state
  JOIN new ON new.phone = s.phone AND new.state = s.state AND new.idx = s.idx AND new.pdf = a.pdf)"""
CONVERTED_ALIGNMENT = f"WITH {_CONVERTED_SQL} SELECT tid, new_tid, count(*) AS n, min(t) AS first FROM both_ids GROUP BY ALL"


def pdf_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pdf of the tree the monophone pdf that most of its frames had: where its first mixture comes from."""
    both, new, _ = _converted(spark, sf_dir)
    old = monophones(spark, sf_dir).select("tid", F.col("pdf").alias("old_pdf"))
    return tr.votes(both.join(old, "tid").join(new.select(F.col("tid").alias("new_tid"), F.col("pdf").alias("new_pdf")), "new_tid"))


PDF_VOTES = f"""WITH {_CONVERTED_SQL}, n AS (SELECT new_pdf, old_pdf, count(*) AS n FROM both_ids GROUP BY ALL)
SELECT new_pdf, old_pdf, n FROM n QUALIFY row_number() OVER (PARTITION BY new_pdf ORDER BY n DESC, old_pdf) = 1"""


def tuple_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's model with the probabilities learned for monophones, matched by phone, state, pdf and index."""
    answers = tree(spark, sf_dir)
    new = tr.model(shape(spark, sf_dir), answers)
    pairs = answers.select("phone", "state", "pdf").distinct()
    foreign = learned(spark, sf_dir).select("phone", "state", "idx", "p").join(pairs, ["phone", "state"])
    return tr.imported(new, foreign).select("tid", "pdf", rounded(F.col("p")).alias("p"))


TUPLE_IMPORT = f"""WITH {COUNTED_SQL}, tuples AS (SELECT DISTINCT phone, state, pdf * 2 + near AS pdf FROM own CROSS JOIN (VALUES (0), (1)) AS v(near)),
numbered AS (SELECT *, row_number() OVER (ORDER BY phone, state, pdf) AS ts FROM tuples)
SELECT row_number() OVER (ORDER BY ts, idx) AS tid, n.pdf, round(p, 6) AS p FROM numbered n JOIN learned l ON n.phone = l.phone AND n.state = l.state"""


def recosted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each utterance's path under the learned probabilities."""
    cost = tr.costed(learned(spark, sf_dir)).select("tid", "cost")
    return aligned(spark, sf_dir).join(cost, "tid").groupBy("utt").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


RECOSTED_PATHS = f"""WITH {COUNTED_SQL}, l AS (SELECT *, ln(greatest(1 - coalesce(sum(CASE WHEN self_loop THEN p END) OVER (PARTITION BY tstate), 0), 1e-10)) AS l FROM learned),
costs AS (SELECT tid, -CASE WHEN self_loop THEN 0.1e0 * ln(p) ELSE (ln(p) - l) + 0.1e0 * l END AS cost FROM l)
SELECT utt, count(*) AS n, round(sum(cost), 4) + 0.0e0 AS cost FROM aligned JOIN costs USING (tid) GROUP BY utt"""


def self_loop_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of each utterance's phones, with self-loops: a phone's exit is the next one's first state."""
    runs = sequences.runs(frames(spark, sf_dir), "label").select("utt", "run", F.col("label").alias("phone"))
    trans = monophones(spark, sf_dir)
    node = lambda run, state: F.concat_ws(".", run, state)
    dst = F.when(F.col("final"), node(F.col("run") + 1, F.lit(0))).otherwise(node(F.col("run"), F.col("to")))
    arcs = runs.join(trans.where("NOT self_loop"), "phone").select("utt", node(F.col("run"), F.col("state")).alias("src"), dst.alias("dst"), "tid")
    g = tr.with_self_loops(arcs, trans).join(trans.select("tid", "self_loop"), "tid")
    return g.groupBy("utt").agg(F.count("*").alias("arcs"), F.sum(F.col("self_loop").cast("long")).alias("loops"), F.count_distinct(F.struct("dst", "dst_in")).alias("nodes"), F.sum("tid").cast("long").alias("tids"))


SELF_LOOP_GRAPH = f"""WITH {RUNS_SQL}, {MODEL_SQL}, a AS (
  SELECT utt, run || '.' || state AS src, CASE WHEN final THEN (run + 1) || '.0' ELSE run || '.' || "to" END AS dst, tid, tstate AS dst_in FROM runs JOIN model ON runs.label = model.phone AND NOT self_loop),
parts AS (SELECT DISTINCT utt, dst AS src, dst_in AS src_in FROM a),
g AS (SELECT a.utt, dst, dst_in, tid, false AS self_loop FROM a LEFT JOIN parts p ON a.utt = p.utt AND a.src = p.src UNION ALL
  SELECT utt, src, src_in, m.tid, true FROM parts JOIN model m ON m.tstate = src_in AND m.self_loop)
SELECT utt, count(*) AS arcs, count(*) FILTER (self_loop) AS loops, count(DISTINCT (dst, dst_in)) AS nodes, sum(tid)::BIGINT AS tids FROM g GROUP BY utt"""


def smoothed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each label with extra counts: of all frames' Gaussian, and of its own."""
    f = frames(spark, sf_dir)
    x = F.array("x")
    per = statistics.moments(f.select("label", x.alias("v")), ["label"], "v", 1)
    whole = statistics.moments(f.select(x.alias("v")), [], "v", 1)
    prior = whole.select((F.transform("sx", lambda s: s / F.col("n"))).alias("mean"), F.transform("sxx", lambda s: s / F.col("n")).alias("square"))
    by = statistics.smoothed_with_model(per.join(F.broadcast(prior), F.lit(True)), TAU)  # one row
    own = statistics.smoothed(per, TAU).select("label", F.col("sx").alias("own"))
    by = by.join(own, "label")
    return by.select("label", F.round("n", 4).alias("n"), *[F.round(F.col(c)[0], 2).alias(c) for c in ("sx", "sxx", "own")])


SMOOTHED_STATS = f"""WITH {FRAMES_SQL}, w AS (SELECT avg(x) AS m, avg(x * x) AS q FROM frames), s AS (SELECT label, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM frames GROUP BY label)
SELECT label, round(n + {TAU}::DOUBLE, 4) AS n, round(sx + {TAU}::DOUBLE * m, 2) AS sx, round(sxx + {TAU}::DOUBLE * q, 2) AS sxx, round(sx * ({TAU}::DOUBLE / n + 1), 2) AS own FROM s, w"""


def silence_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that each label's Gaussian wins, before and after the weights of silence are scaled by 1.5."""
    f = frames(spark, sf_dir)
    m = f.groupBy(F.col("label").alias("pdf")).agg(F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(0.01)).alias("var"), F.lit(1.0).alias("weight"))
    boosted = acoustic.silence_boosted(m, F.col("pdf") == "error", 1.5)
    both = m.join(boosted.select("pdf", F.col("weight").alias("boosted")), "pdf")
    line = both.agg(F.collect_list(F.struct("pdf", "mean", "var", "weight", "boosted")).alias("m"))  # one row, a Gaussian a label
    fit = lambda m: -0.5 * (F.ln(m["var"]) + (F.col("x") - m["mean"]) * (F.col("x") - m["mean"]) / m["var"])
    best = lambda w: F.array_max(F.transform("m", lambda m: F.struct(F.round(fit(m) + F.ln(m[w]), 6).alias("l"), m["pdf"].alias("pdf")))).alias(w)
    won = f.join(F.broadcast(line), F.lit(True)).select(best("weight"), best("boosted"))
    return won.groupBy(F.col("weight.pdf").alias("plain"), F.col("boosted.pdf").alias("after")).agg(F.count("*").alias("n"))


SILENCE_BOOST = f"""WITH {FRAMES_SQL}, m AS (SELECT label AS pdf, avg(x) AS mean, greatest(var_pop(x), 0.01e0) AS var FROM frames GROUP BY label),
l AS (SELECT utt, t, pdf, -0.5e0 * (ln(var) + (x - mean) * (x - mean) / var) AS l, ln(CASE WHEN pdf = 'error' THEN 1.5e0 ELSE 1.0e0 END) AS w FROM frames CROSS JOIN m),
r AS (SELECT utt, t, arg_max(pdf, (round(l, 6), pdf)) AS plain, arg_max(pdf, (round(l + w, 6), pdf)) AS after FROM l GROUP BY utt, t)
SELECT plain, after, count(*) AS n FROM r GROUP BY ALL"""


QUERIES = {
    "transition_ids": (transition_ids, TRANSITION_IDS),
    "transition_learned": (transition_learned, TRANSITION_LEARNED),
    "tid_phone_runs": (tid_phone_runs, TID_PHONE_RUNS),
    "self_loops_last": (self_loops_last, SELF_LOOPS_LAST),
    "converted_alignment": (converted_alignment, CONVERTED_ALIGNMENT),
    "pdf_votes": (pdf_votes, PDF_VOTES),
    "tuple_import": (tuple_import, TUPLE_IMPORT),
    "recosted_paths": (recosted_paths, RECOSTED_PATHS),
    "self_loop_graph": (self_loop_graph, SELF_LOOP_GRAPH),
    "smoothed_stats": (smoothed_stats, SMOOTHED_STATS),
    "silence_boost": (silence_boost, SILENCE_BOOST),
}
