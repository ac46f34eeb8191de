"""Frame, feature and statistics queries on the supplied tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import acoustic, sequences, statistics
from .inputs import FRAMES_SQL, frames, table

DIM = 64


def speaker_cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = statistics.normalised(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM)
    rows = e.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("x"), 5).alias("x"))


_VECTORS = "v AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SPEAKER_CMVN = f"WITH {_VECTORS} SELECT vec_id, dim, round(x - avg(x) OVER (PARTITION BY label, dim), 5) + 0.0e0 AS x FROM v"


def delta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.deltas(frames(spark, sf_dir))
    return d.select("utt", "t", rounded(F.col("delta1")).alias("delta1"), rounded(F.col("delta2")).alias("delta2"))


def _at(j: int) -> str:
    if j == 0:
        return "x"
    return f"coalesce({'lead' if j > 0 else 'lag'}(x, {abs(j)}) OVER w, {'last_value' if j > 0 else 'first_value'}(x) OVER u)"


DELTA_FEATURES = f"""WITH {FRAMES_SQL}
SELECT utt, t, round(({_at(1)} - {_at(-1)}) / 10.0e0 + ({_at(2)} - {_at(-2)}) / 5.0e0, 6) + 0.0e0 AS delta1,
  round((4 * {_at(-4)} + 4 * {_at(-3)} + {_at(-2)} - 4 * {_at(-1)} - 10 * x - 4 * {_at(1)} + {_at(2)} + 4 * {_at(3)} + 4 * {_at(4)}) / 100.0e0, 6) + 0.0e0 AS delta2
FROM frames WINDOW w AS (PARTITION BY utt ORDER BY t), u AS (PARTITION BY utt ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences.spliced(frames(spark, sf_dir)).select("utt", "t", F.posexplode("spliced").alias("offset", "x"))
    return s.select("utt", "t", (F.col("offset") - 3).cast("long").alias("offset"), "x")


SPLICE = f"""WITH {FRAMES_SQL}, n AS (SELECT utt, max(t) AS last FROM frames GROUP BY utt)
SELECT f.utt, f.t, o.offset, g.x FROM frames f JOIN n USING (utt) CROSS JOIN (SELECT unnest(range(-3, 4)) AS offset) o
JOIN frames g ON g.utt = f.utt AND g.t = greatest(0, least(n.last, f.t + o.offset))"""


def speaker_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.by_dimension(statistics.moments(table(spark, sf_dir, "embeddings"), ["label"], "embedding", DIM), ["label"])
    return s.select("label", F.col("dim").cast("long").alias("dim"), F.col("n").cast("long").alias("n"), rounded(F.col("mean")).alias("mean"), rounded(F.col("var")).alias("var"))


SPEAKER_MOMENTS = f"WITH {_VECTORS} SELECT label, dim, count(*) AS n, round(avg(x), 6) + 0.0e0 AS mean, round(sum(x * x) / count(*) - avg(x) * avg(x), 6) + 0.0e0 AS var FROM v GROUP BY label, dim"


def gmm_score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's best Gaussian (one per label) and the ln of the sum over all, by a broadcast model and one product per batch."""
    e = table(spark, sf_dir, "embeddings")
    model = acoustic.packed(acoustic.diagonal_models(e, "label", "embedding", DIM))
    s = acoustic.scored(e, "vec_id", "embedding", model)
    top = F.array_max("loglike")
    total = top + F.ln(F.aggregate("loglike", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return s.select("vec_id", "pdf", F.round(top, 4).alias("best"), F.round(total, 4).alias("total"))


GMM_SCORE_ARGMAX = f"""WITH {_VECTORS}, m AS (SELECT label, dim, avg(x) AS mean, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0.001e0) AS var FROM v GROUP BY label, dim),
s AS (SELECT v.vec_id, m.label AS pdf, -0.5e0 * sum(ln(2 * pi()) + ln(var) + (x - mean) * (x - mean) / var) AS l FROM v JOIN m USING (dim) GROUP BY v.vec_id, m.label),
b AS (SELECT vec_id, max(l) AS top FROM s GROUP BY vec_id)
SELECT s.vec_id, arg_max(pdf, l)::BIGINT AS pdf, round(max(l), 4) AS best, round(max(top) + ln(sum(exp(l - top))), 4) AS total FROM s JOIN b USING (vec_id) GROUP BY s.vec_id"""


def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    top = f.groupBy("utt").agg(F.max("x").alias("top"))
    return f.join(top, "utt").groupBy("utt").agg(rounded(F.max("top") + F.ln(F.sum(F.exp(F.col("x") - F.col("top"))))).alias("total"))


LOG_SUM_EXP = f"WITH {FRAMES_SQL}, m AS (SELECT utt, max(x) AS top FROM frames GROUP BY utt) SELECT utt, round(max(top) + ln(sum(exp(x - top))), 6) AS total FROM frames JOIN m USING (utt) GROUP BY utt"


def lda_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within-class and between-class covariance, from one scatter per class."""
    d = DIM
    s = statistics.scatter(table(spark, sf_dir, "embeddings"), "label", "embedding", d, augmented=True)
    last = s.where(F.col("row") == d).select(F.col("key").alias("k"), "n", F.col("sums").alias("sx"))
    cell = s.where(F.col("row") < d).drop("n").join(F.broadcast(last), F.col("key") == F.col("k")).select("n", "sx", "row", F.posexplode(F.slice("sums", 1, d)).alias("col", "xx"))
    pick = lambda c: F.element_at("sx", F.col(c) + 1)
    g = cell.groupBy("row", "col").agg(
        F.sum("n").alias("n"), F.sum("xx").alias("xx"), F.sum(pick("row")).alias("si"), F.sum(pick("col")).alias("sj"), F.sum(pick("row") * pick("col") / F.col("n")).alias("between")
    )
    total = F.col("xx") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")
    between = F.col("between") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")
    return g.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), rounded(total - between).alias("within"), rounded(between).alias("between"))


LDA_SCATTER = f"""WITH {_VECTORS}, w AS (SELECT * FROM v), c AS (SELECT label, dim, count(*) AS n, sum(x) AS sx FROM w GROUP BY label, dim),
b AS (SELECT a.dim AS row, z.dim AS col, sum(a.n) AS n, sum(a.sx) AS si, sum(z.sx) AS sj, sum(a.sx * z.sx / a.n) AS bb FROM c a JOIN c z USING (label) GROUP BY a.dim, z.dim),
s AS (SELECT a.dim AS row, z.dim AS col, sum(a.x * z.x) AS xx FROM w a JOIN w z USING (vec_id) GROUP BY a.dim, z.dim)
SELECT row, col, round(xx / n - bb / n, 6) + 0.0e0 AS within, round(bb / n - si / n * sj / n, 6) + 0.0e0 AS between FROM s JOIN b USING (row, col)"""


def mllt_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLLT statistics G_j: per class the scatter around its mean, over the class variance of j."""
    d = DIM
    s = statistics.scatter(table(spark, sf_dir, "embeddings"), "label", "embedding", d, augmented=True)
    last = s.where(F.col("row") == d).select(F.col("key").alias("k"), F.col("n").alias("nk"), F.col("sums").alias("sx"))
    c = s.where(F.col("row") < d).join(F.broadcast(last), F.col("key") == F.col("k"))
    centred = F.transform(F.slice("sums", 1, d), lambda x, j: x - F.element_at("sx", F.col("row") + 1) * F.element_at("sx", j + 1) / F.col("nk"))
    c = c.select("key", "row", "nk", centred.alias("g"))
    var = c.select(F.col("key").alias("k"), F.col("row").alias("j"), (F.element_at("g", F.col("row") + 1) / F.col("nk")).alias("var"))
    out = c.join(var, F.col("key") == F.col("k")).select("j", "row", F.posexplode("g").alias("col", "x"), "var").groupBy("j", "row", "col").agg(rounded(F.sum(F.col("x") / F.col("var")), 4).alias("g"))
    return out.select(*[F.col(k).cast("long").alias(k) for k in ("j", "row", "col")], "g")


MLLT_SCATTER = f"""WITH {_VECTORS}, w AS (SELECT vec_id, label, dim, x - avg(x) OVER (PARTITION BY label, dim) AS x FROM v),
var AS (SELECT label, dim AS j, avg(x * x) AS var FROM w GROUP BY label, dim), s AS (SELECT a.label, a.dim AS row, z.dim AS col, sum(a.x * z.x) AS xx FROM w a JOIN w z USING (vec_id) GROUP BY ALL)
SELECT j, row, col, round(sum(xx / var), 4) + 0.0e0 AS g FROM s JOIN var USING (label) GROUP BY j, row, col"""


def fmllr_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker = vec_id mod 10, pdf = label; beta and the rows of K."""
    e = table(spark, sf_dir, "embeddings").withColumn("speaker", F.col("vec_id") % 10)
    k = statistics.affine_k(e, "speaker", "label", "embedding", DIM, acoustic.diagonal_models(e, "label", "embedding", DIM))
    rows = k.select("speaker", "beta", "dim", F.posexplode("k").alias("col", "k"))
    return rows.select("speaker", "beta", F.col("dim").cast("long").alias("dim"), F.col("col").cast("long").alias("col"), rounded(F.col("k"), 5).alias("k"))


FMLLR_K = f"""WITH {_VECTORS}, w AS (SELECT * FROM v), m AS (SELECT label, dim, avg(x) AS mean, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0.001e0) AS var FROM w GROUP BY label, dim),
x1 AS (SELECT vec_id, dim AS col, x FROM w UNION ALL SELECT vec_id, 64, 1.0e0 FROM embeddings)
SELECT vec_id % 10 AS speaker, count(*) AS beta, m.dim, col, round(sum(mean / var * x1.x), 5) + 0.0e0 AS k FROM embeddings e JOIN m USING (label) JOIN x1 USING (vec_id) GROUP BY ALL"""


def fmllr_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_i per speaker: sum over pdfs of the augmented scatter over the pdf's variance of dimension i; of each row its diagonal and its sum."""
    d = DIM
    e = table(spark, sf_dir, "embeddings").withColumn("sp", F.concat_ws(",", F.col("vec_id") % 10, "label"))
    s = statistics.scatter(e, "sp", "embedding", d, augmented=True).withColumn("speaker", F.split("key", ",")[0].cast("long")).withColumn("pdf", F.split("key", ",")[1].cast("int"))
    m = acoustic.diagonal_models(e, "label", "embedding", d).select("pdf", F.posexplode("var").alias("i", "var"))
    g = s.join(m, "pdf").groupBy("speaker", "i", "row").agg(F.array(*[F.sum(F.col("sums")[j] / F.col("var")) for j in range(d + 1)]).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    return g.select("speaker", F.col("i").cast("long").alias("i"), F.col("row").cast("long").alias("row"), rounded(F.element_at("g", F.col("row") + 1), 4).alias("diagonal"), rounded(total, 4).alias("total"))


FMLLR_G = f"""WITH {_VECTORS}, m AS (SELECT label, dim, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0.001e0) AS var FROM v GROUP BY label, dim),
x1 AS (SELECT vec_id, label, dim, x FROM v UNION ALL SELECT vec_id, label, 64, 1.0e0 FROM embeddings), t AS (SELECT vec_id, sum(x) AS t FROM x1 GROUP BY vec_id),
c AS (SELECT vec_id % 10 AS speaker, label, dim AS row, sum(x * x) AS xx, sum(x * t) AS xt FROM x1 JOIN t USING (vec_id) GROUP BY ALL)
SELECT speaker, m.dim AS i, row, round(sum(xx / var), 4) + 0.0e0 AS diagonal, round(sum(xt / var), 4) + 0.0e0 AS total FROM c JOIN m USING (label) GROUP BY ALL"""


def two_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors from normalised features, sums over the plain ones: occ and mean per pdf for two competing Gaussians."""
    f = frames(spark, sf_dir)
    s = f.groupBy("utt").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = f.join(s, "utt").withColumn("z", (F.col("x") - F.col("m")) / F.greatest("sd", F.lit(1e-10)))
    p = 1 / (1 + F.exp(-2 * F.col("z")))
    g = z.withColumn("g", F.explode(F.array(F.struct(F.lit(0).alias("g"), (1 - p).alias("p")), F.struct(F.lit(1).alias("g"), p.alias("p")))))
    return g.groupBy("label", F.col("g.g").alias("g")).agg(rounded(F.sum("g.p"), 4).alias("occ"), rounded(F.sum(F.col("g.p") * F.col("x")) / F.sum("g.p"), 4).alias("mean"))


TWO_FEATURE_STATS = f"""WITH {FRAMES_SQL}, s AS (SELECT utt, avg(x) AS m, stddev_pop(x) AS sd FROM frames GROUP BY utt),
z AS (SELECT label, x, 1 / (1 + exp(-2 * (x - m) / greatest(sd, 1e-10))) AS p FROM frames JOIN s USING (utt)), g AS (SELECT label, 0 AS g, x, 1 - p AS p FROM z UNION ALL SELECT label, 1, x, p FROM z)
SELECT label, g, round(sum(p), 4) AS occ, round(sum(p * x) / sum(p), 4) AS mean FROM g GROUP BY label, g"""


def speaker_independent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for plain features that posteriors of normalised ones give: weight, mean and variance of two Gaussians a label."""
    f = frames(spark, sf_dir)
    s = f.groupBy("utt").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    p = 1 / (1 + F.exp(-2 * (F.col("x") - F.col("m")) / F.greatest("sd", F.lit(1e-10))))
    z = f.join(s, "utt").select("label", "x", F.posexplode(F.array(1 - p, p)).alias("g", "p"))
    sums = z.groupBy("label", "g").agg(F.sum("p").alias("occ"), F.array(F.sum(F.col("p") * F.col("x"))).alias("sx"), F.array(F.sum(F.col("p") * F.col("x") * F.col("x"))).alias("sxx"))
    return acoustic.solved(sums, "label").select("label", "g", rounded(F.col("weight")).alias("weight"), rounded(F.col("mean")[0], 4).alias("mean"), rounded(F.col("var")[0], 3).alias("var"))


SPEAKER_INDEPENDENT_MODEL = f"""WITH {FRAMES_SQL}, s AS (SELECT utt, avg(x) AS m, stddev_pop(x) AS sd FROM frames GROUP BY utt),
z AS (SELECT label, x, 1 / (1 + exp(-2 * (x - m) / greatest(sd, 1e-10))) AS p FROM frames JOIN s USING (utt)), g AS (SELECT label, 0 AS g, x, 1 - p AS p FROM z UNION ALL SELECT label, 1, x, p FROM z),
o AS (SELECT label, g, sum(p) AS occ, sum(p * x) / sum(p) AS mean, sum(p * x * x) / sum(p) AS square FROM g GROUP BY label, g)
SELECT label, g, round(occ / sum(occ) OVER (PARTITION BY label), 6) AS weight, round(mean, 4) AS mean, round(greatest(square - mean * mean, 0.001e0), 3) AS var FROM o"""


def global_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance over the first eleven of the shortest utterances, variance floored."""
    f = frames(spark, sf_dir)
    first = f.groupBy("utt").agg(F.count("*").alias("n")).orderBy("n", "utt").limit(11).select("utt")
    g = f.join(F.broadcast(first), "utt")
    return g.agg(F.count("*").alias("n"), rounded(F.avg("x")).alias("mean"), F.greatest(F.round(F.var_pop("x"), 4), F.lit(1e-4)).alias("var"))


GLOBAL_MOMENTS = f"""WITH {FRAMES_SQL}, n AS (SELECT utt, row_number() OVER (ORDER BY count(*), utt) AS r FROM frames GROUP BY utt)
SELECT count(*) AS n, round(avg(x), 6) AS mean, greatest(round(var_pop(x), 4), 0.0001e0) AS var FROM frames JOIN n USING (utt) WHERE r <= 11"""


def pdf_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy per pdf without silence frames (weight 0), and its share of all."""
    from pyspark.sql.window import Window

    f = frames(spark, sf_dir).withColumn("w", F.when(F.col("label") == "error", 0.0).otherwise(1.0))
    o = f.groupBy("label").agg(F.sum("w").alias("occ"), F.count("*").alias("n"))
    return o.withColumn("share", rounded(F.col("occ") / F.sum("occ").over(Window.partitionBy(F.lit(0)))))


PDF_OCCUPANCY = f"""WITH {FRAMES_SQL}, o AS (SELECT label, sum(CASE WHEN label = 'error' THEN 0.0e0 ELSE 1.0e0 END) AS occ, count(*) AS n FROM frames GROUP BY label)
SELECT label, occ, n, round(occ / sum(occ) OVER (), 6) AS share FROM o"""


def triphone_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequences.context(frames(spark, sf_dir), "label")
    return c.groupBy("left", "label", "right").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("sxx"))


TRIPHONE_CONTEXT = f"""WITH {FRAMES_SQL}, c AS (SELECT coalesce(lag(label) OVER w, '') AS "left", label, coalesce(lead(label) OVER w, '') AS "right", x FROM frames WINDOW w AS (PARTITION BY utt ORDER BY t))
SELECT "left", label, "right", count(*) AS n, round(sum(x), 4) AS sx, round(sum(x * x), 4) AS sxx FROM c GROUP BY ALL"""


def tree_split_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each centre: the gain of asking whether the left neighbour is a given label."""
    c = sequences.context(frames(spark, sf_dir), "label")
    s = c.groupBy("label", "left").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    asked = frames(spark, sf_dir).select(F.col("label").alias("question")).distinct()
    g = statistics.split_gain(s.join(F.broadcast(asked), F.lit(True)), ["label", "question"], F.col("left") == F.col("question"))
    return g.select("label", "question", F.col("n_yes").cast("long").alias("n_yes"), F.col("n_no").cast("long").alias("n_no"), F.round("gain", 4).alias("gain"))


def _objective(n: str, sx: str, sxx: str) -> str:
    var = f"({sxx} / {n} - ({sx} / {n}) * ({sx} / {n}))"
    return f"CASE WHEN {n} > 0 THEN -0.5e0 * {n} * ({math.log(2 * math.pi)}::DOUBLE + ln(greatest({var}, 0.01e0)) + {var} / greatest({var}, 0.01e0)) ELSE 0 END"


TREE_SPLIT_GAIN = f"""WITH {FRAMES_SQL}, c AS (SELECT coalesce(lag(label) OVER (PARTITION BY utt ORDER BY t), '') AS l, label, x FROM frames), q AS (SELECT DISTINCT label AS question FROM frames),
s AS (SELECT label, question, count(*) FILTER (l = question) AS ny, count(*) FILTER (l <> question) AS nn, coalesce(sum(x) FILTER (l = question), 0) AS xy, coalesce(sum(x) FILTER (l <> question), 0) AS xn,
  coalesce(sum(x * x) FILTER (l = question), 0) AS qy, coalesce(sum(x * x) FILTER (l <> question), 0) AS qn FROM c CROSS JOIN q GROUP BY label, question)
SELECT label, question, ny AS n_yes, nn AS n_no, round({_objective("ny", "xy", "qy")} + {_objective("nn", "xn", "qn")} - {_objective("(ny + nn)", "(xy + xn)", "(qy + qn)")}, 4) AS gain FROM s"""


def stats_by_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triphone statistics summed by tree leaf; the tree is a table of (left, label) to leaf."""
    c = sequences.context(frames(spark, sf_dir), "label")
    leaf = F.when(F.col("label") == "error", 0).when(F.col("left").isin("view", "click"), 1).otherwise(2)
    return c.groupBy("label", leaf.alias("leaf")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


STATS_BY_LEAF = f"""WITH {FRAMES_SQL}, c AS (SELECT coalesce(lag(label) OVER (PARTITION BY utt ORDER BY t), '') AS l, label, x FROM frames)
SELECT label, CASE WHEN label = 'error' THEN 0 WHEN l IN ('view', 'click') THEN 1 ELSE 2 END AS leaf, count(*) AS n, round(avg(x), 6) AS mean FROM c GROUP BY ALL"""


def transition_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequences.context(frames(spark, sf_dir), "label").where("right <> ''").groupBy("label", F.col("right").alias("next")).agg(F.count("*").alias("n"))
    p = statistics.normalised_probabilities(c, "label", "n", floor=0.19)
    return p.select("label", "next", "n", rounded(F.col("p")).alias("p"))


TRANSITION_MLE = f"""WITH {FRAMES_SQL}, b AS (SELECT label, lead(label) OVER (PARTITION BY utt ORDER BY t) AS next FROM frames), c AS (SELECT label, next, count(*) AS n FROM b WHERE next IS NOT NULL GROUP BY ALL),
p0 AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM c), p1 AS (SELECT *, greatest(p / sum(p) OVER (PARTITION BY label), 0.19e0) AS q FROM p0),
p2 AS (SELECT *, greatest(q / sum(q) OVER (PARTITION BY label), 0.19e0) AS r FROM p1), p3 AS (SELECT *, greatest(r / sum(r) OVER (PARTITION BY label), 0.19e0) AS s FROM p2)
SELECT label, next, n, round(s, 6) AS p FROM p3"""


def gmm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expectation and maximisation step of a mixture that starts at the labels' Gaussians."""
    d = DIM
    e = table(spark, sf_dir, "embeddings")
    start = acoustic.diagonal_models(e, "label", "embedding", d).select(F.col("pdf").alias("g"), F.lit(0.1).alias("weight"), "mean", "var")
    m = acoustic.maximised(acoustic.weighted_moments(e, "embedding", start, d))
    rows = m.select("g", F.round("weight", 5).alias("weight"), F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "s"))
    return rows.select(F.col("g").cast("int").alias("g"), "weight", F.col("dim").cast("long").alias("dim"), rounded(F.col("s.mean"), 5).alias("mean"), rounded(F.col("s.var"), 5).alias("var"))


GMM_STATS = f"""WITH {_VECTORS}, w AS (SELECT * FROM v), m AS (SELECT label AS g, dim, avg(x) AS mean, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0.001e0) AS var FROM w GROUP BY label, dim),
l AS (SELECT vec_id, g, -0.5e0 * sum(ln(var) + (x - mean) * (x - mean) / var) AS l FROM w JOIN m USING (dim) GROUP BY vec_id, g), t AS (SELECT vec_id, max(l) AS top FROM l GROUP BY vec_id),
e AS (SELECT vec_id, g, exp(l - top) AS e FROM l JOIN t USING (vec_id)), p AS (SELECT vec_id, g, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
s AS (SELECT g, dim, sum(p) AS occ, sum(p * x) AS sx, sum(p * x * x) AS sxx FROM p JOIN w USING (vec_id) GROUP BY g, dim),
k AS (SELECT * FROM s WHERE (occ > 10 AND occ / (SELECT count(*) FROM embeddings) > 1e-5) OR occ = (SELECT max(occ) FROM s))
SELECT g, round(occ / (sum(occ) OVER (PARTITION BY dim)), 5) AS weight, dim, round(sx / occ, 5) + 0.0e0 AS mean, round(greatest(sxx / occ - (sx / occ) * (sx / occ), 0.001e0), 5) + 0.0e0 AS var FROM k"""


QUERIES = {
    "speaker_cmvn": (speaker_cmvn, SPEAKER_CMVN),
    "delta_features": (delta_features, DELTA_FEATURES),
    "splice": (splice, SPLICE),
    "speaker_moments": (speaker_moments, SPEAKER_MOMENTS),
    "gmm_score_argmax": (gmm_score_argmax, GMM_SCORE_ARGMAX),
    "log_sum_exp": (log_sum_exp, LOG_SUM_EXP),
    "lda_scatter": (lda_scatter, LDA_SCATTER),
    "mllt_scatter": (mllt_scatter, MLLT_SCATTER),
    "fmllr_k": (fmllr_k, FMLLR_K),
    "fmllr_g": (fmllr_g, FMLLR_G),
    "speaker_independent_model": (speaker_independent_model, SPEAKER_INDEPENDENT_MODEL),
    "two_feature_stats": (two_feature_stats, TWO_FEATURE_STATS),
    "global_moments": (global_moments, GLOBAL_MOMENTS),
    "pdf_occupancy": (pdf_occupancy, PDF_OCCUPANCY),
    "triphone_context": (triphone_context, TRIPHONE_CONTEXT),
    "tree_split_gain": (tree_split_gain, TREE_SPLIT_GAIN),
    "stats_by_leaf": (stats_by_leaf, STATS_BY_LEAF),
    "transition_mle": (transition_mle, TRANSITION_MLE),
    "gmm_stats": (gmm_stats, GMM_STATS),
}
