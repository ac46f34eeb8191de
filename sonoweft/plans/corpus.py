"""Corpus and lexicon queries on the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import durations, numbers, text
from ..operators import lexicon, schedules, sequences
from .inputs import WORDS_SQL, table, vocabulary, word_counts, words


def lexicon_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unknown_words(word_counts(spark, sf_dir), vocabulary(spark, sf_dir))


LEXICON_OOV = f"WITH {WORDS_SQL} SELECT word, count(*) AS n FROM words ANTI JOIN vocabulary USING (word) GROUP BY word"


def oov_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_oov(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)


OOV_TOP10 = f"{LEXICON_OOV} ORDER BY n DESC, word LIMIT 10"


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.looked_up(words(spark, sf_dir), vocabulary(spark, sf_dir))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.size("phones").cast("long")).alias("n_phones"), F.sum(F.col("oov").cast("long")).alias("n_oov"))


LEXICON_LOOKUP = f"""WITH {WORDS_SQL}
SELECT doc_id, count(*) AS n_words, sum(CASE WHEN v.word IS NULL THEN 1 ELSE length(v.word) END)::BIGINT AS n_phones, count(*) FILTER (v.word IS NULL) AS n_oov
FROM words w LEFT JOIN vocabulary v ON w.word = v.word GROUP BY doc_id"""


def position_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary(spark, sf_dir).withColumn("tagged", text.tag_phones(F.col("phones")))
    rows = v.select("word", F.posexplode("tagged").alias("pos", "tagged"))
    return rows.select("word", F.col("pos").cast("long").alias("pos"), "tagged", text.untag_phone(F.col("tagged")).alias("phone"))


POSITION_TAGS = f"""WITH {WORDS_SQL}, letters AS (SELECT word, unnest(range(length(word))) AS pos FROM vocabulary)
SELECT word, pos, substr(word, pos + 1, 1) || CASE WHEN length(word) = 1 THEN '_S' WHEN pos = 0 THEN '_B' WHEN pos = length(word) - 1 THEN '_E' ELSE '_I' END AS tagged,
  substr(word, pos + 1, 1) AS phone FROM letters"""


def phone_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of all transcripts against those of the vocabulary: what a remap would find missing."""
    used = word_counts(spark, sf_dir).select(F.explode(F.split("word", "")).alias("symbol")).where("symbol <> ''")
    known = vocabulary(spark, sf_dir).select(F.explode("phones").alias("symbol")).distinct()
    return lexicon.missing_symbols(used, known, "symbol")


PHONE_REMAP = f"""WITH {WORDS_SQL}
SELECT DISTINCT symbol FROM (SELECT unnest(string_split(word, '')) AS symbol FROM words) WHERE symbol <> '' AND symbol NOT IN
  (SELECT unnest(string_split(word, '')) FROM vocabulary)"""


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with ids by sort order; 0 is kept for epsilon."""
    s = vocabulary(spark, sf_dir).select(F.explode("phones").alias("sym")).distinct()
    return s.select("sym", F.row_number().over(Window.orderBy("sym")).cast("long").alias("id")).union(spark.range(1).select(F.lit("<eps>"), F.col("id")))


SYMBOL_TABLE = f"""WITH {WORDS_SQL}, s AS (SELECT DISTINCT unnest(string_split(word, '')) AS sym FROM vocabulary)
SELECT sym, row_number() OVER (ORDER BY encode(sym)) AS id FROM s UNION ALL SELECT '<eps>', 0"""


def subset_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 shortest utterances (a subset is a training stage's own size, not the corpus's)."""
    return sequences.shortest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 200)


SUBSET_SHORTEST = "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 200"


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.greedy_chunks(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000)


GREEDY_CHUNKS = """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
c AS (
  SELECT source, doc_id, i, 0 AS chunk, n_chars AS held FROM d WHERE i = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.i, c.chunk + CASE WHEN c.held > 0 AND c.held + d.n_chars > 20000 THEN 1 ELSE 0 END,
    CASE WHEN c.held > 0 AND c.held + d.n_chars > 20000 THEN d.n_chars ELSE c.held + d.n_chars END
  FROM c JOIN d ON d.source = c.source AND d.i = c.i + 1
)
SELECT source, doc_id, chunk FROM c"""


def phone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user and day as a phone string with separators at errors, split into words."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    line = F.array_join(F.transform("e.event_type", lambda x: F.when(x == "error", "|").otherwise(x)), " ")
    w = day.select("user_id", "day", text.phone_words(line).alias("w")).select("user_id", "day", F.posexplode("w").alias("pos", "phones"))
    return w.select("user_id", "day", F.col("pos").cast("long").alias("pos"), F.array_join("phones", " ").alias("phones"))


PHONE_WORDS = """WITH line AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(CASE WHEN event_type = 'error' THEN '|' ELSE event_type END, ' ' ORDER BY ts, event_id) AS s,
    bool_or(event_type = 'error') AS cut FROM events GROUP BY ALL
), parts AS (
  SELECT user_id, day, list_filter(list_transform(string_split(s, CASE WHEN cut THEN '|' ELSE ' ' END), lambda x: trim(x)), lambda x: x <> '') AS w FROM line
)
SELECT user_id, day, unnest(range(len(w))) AS pos, unnest(w) AS phones FROM parts"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a file tree: source/doc.ext, with several transcript types."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ext = F.element_at(F.array(*map(F.lit, ["wav", "flac", "MP3", "lab", "txt", "TextGrid"])), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    stem = F.concat("source", F.lit("/u"), F.floor(F.col("doc_id") / 2).cast("string"))
    return d.select(F.concat(stem, F.lit("."), ext).alias("path"), "n_chars")


PATHS_SQL = "paths AS (SELECT source || '/u' || (doc_id // 2) || '.' || ['wav', 'flac', 'MP3', 'lab', 'txt', 'TextGrid'][doc_id % 6 + 1] AS path, n_chars FROM documents)"


def file_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.listing import paired

    return paired(paths(spark, sf_dir))


FILE_PAIRING = f"""WITH {PATHS_SQL}, f AS (SELECT path, regexp_replace(path, '[.][^./]*$', '') AS id, lower(regexp_extract(path, '[.]([^./]*)$', 1)) AS ext FROM paths),
a AS (SELECT id, arg_min(path, [list_position(['wav', 'flac', 'mp3'], ext)::VARCHAR, path]) AS audio FROM f WHERE ext IN ('wav', 'flac', 'mp3') GROUP BY id),
t AS (SELECT id, arg_min(path, [list_position(['lab', 'txt', 'textgrid'], ext)::VARCHAR, path]) AS transcript FROM f WHERE ext IN ('lab', 'txt', 'textgrid') GROUP BY id)
SELECT id, audio, transcript, CASE WHEN contains(id, '/') THEN string_split(id, '/')[-2] ELSE 'speaker' END AS speaker FROM a FULL JOIN t USING (id)"""


def dictionary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines derived from conversations, read as entries: word, optional probabilities, phones."""
    from ..sources.dictionary import parsed_lines

    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = F.split("text", "[ \t\n\r]+")
    word, phones = F.lower(w[0]), F.array_join(F.filter(F.split(F.lower(F.coalesce(w[1], F.lit("x"))), ""), lambda c: c != ""), " ")
    prob = lambda k: F.format_string("0.%02d", (F.pmod(F.col("conv_id") + k, F.lit(90)) + 10).cast("int"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    line = F.when(kind == 0, F.concat_ws(" ", word, phones)).when(kind == 1, F.concat_ws(" ", word, prob(0), phones)).when(kind == 2, F.concat_ws(" ", word, prob(0), prob(1), prob(2), prob(3), phones)).otherwise(F.concat_ws(" ", F.lit(";"), word))
    lines = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line"), line.alias("value"))
    e = parsed_lines(lines)
    return e.select("word", "pron_idx", F.array_join("phones", " ").alias("phones"), "prob", "sil_after", "sil_before", "nonsil_before")


DICTIONARY_COLUMNS = r"""WITH c AS (
  SELECT conv_id * 100 + turn AS line, conv_id, turn, string_split_regex(text, '[ \t\n\r]+') AS w FROM conversations WHERE text IS NOT NULL
), e AS (
  SELECT line, lower(w[1]) AS word, array_to_string(list_filter(string_split(lower(coalesce(w[2], 'x')), ''), lambda x: x <> ''), ' ') AS phones, (conv_id + turn) % 4 AS kind,
    (conv_id % 90 + 10) / 100 AS p0, ((conv_id + 1) % 90 + 10) / 100 AS p1, ((conv_id + 2) % 90 + 10) / 100 AS p2, ((conv_id + 3) % 90 + 10) / 100 AS p3 FROM c
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY word, phones ORDER BY line) AS nth FROM e WHERE kind < 3 AND word <> '' AND phones <> '' AND word NOT LIKE ';%' AND word NOT LIKE '#%'
)
SELECT word, row_number() OVER (PARTITION BY word ORDER BY line) - 1 AS pron_idx, phones, CASE WHEN kind > 0 THEN p0 END AS prob, CASE WHEN kind = 2 THEN p1 END AS sil_after,
  CASE WHEN kind = 2 THEN p2 END AS sil_before, CASE WHEN kind = 2 THEN p3 END AS nonsil_before FROM kept WHERE nth = 1"""


def prob_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    base = labels.select("doc_id", F.lit(0.5).alias("prob"))
    learned = labels.where("toxic = 1 OR quality = 0").select("doc_id", ((F.col("quality") + 1) / 4.0).alias("prob"))
    return lexicon.overridden(base, learned, ["doc_id"], "prob")


PROB_OVERRIDE = """SELECT b.doc_id, coalesce(l.prob, 0.5e0) AS prob FROM labels b LEFT JOIN (SELECT doc_id, (quality + 1) / 4.0e0 AS prob FROM labels WHERE toxic = 1 OR quality = 0) l ON b.doc_id = l.doc_id"""


def multi_pron_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("user_id").alias("word"), "event_type", F.when(F.col("value") > 480, F.lit(0.5)).alias("prob")).groupBy("word", "event_type").agg(F.max("prob").alias("prob"))
    return lexicon.shares(entries)


MULTI_PRON_SHARE = """WITH e AS (SELECT user_id AS word, event_type, max(CASE WHEN value > 480 THEN 0.5 END) AS prob FROM events GROUP BY ALL),
w AS (SELECT word, count(*) AS n, bool_or(prob IS NOT NULL) AS p FROM e GROUP BY word)
SELECT count(*) AS words, sum(n)::BIGINT AS prons, round(avg(CASE WHEN n > 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS multi_share, bool_or(p) AS has_prob FROM w"""


def scatter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a subset back on all utterances; null where none."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase' AND value > 400").groupBy("user_id").agg(F.count("*").alias("aligned"))
    return e.select("user_id").distinct().join(done, "user_id", "left")


SCATTER_RESULTS = """SELECT u.user_id, d.aligned FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN
(SELECT user_id, count(*) AS aligned FROM events WHERE event_type = 'purchase' AND value > 400 GROUP BY user_id) d USING (user_id)"""


def align_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: utterances, aligned, seconds of audio, and the first ten failed ones in order."""
    d = table(spark, sf_dir, "documents").withColumn("failed", F.col("n_chars") < 200)
    sums = d.groupBy("source").agg(F.count("*").alias("utterances"), F.sum((~F.col("failed")).cast("long")).alias("aligned"), numbers.rounded(F.sum("n_chars") * 0.01).alias("seconds"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = d.where("failed").select("source", "doc_id", nth.alias("nth")).where("nth <= 10").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    out = sums.join(first.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("source", "utterances", "aligned", "seconds", F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("failed_ids"))


ALIGN_SUMMARY = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars < 200 ORDER BY doc_id) AS nth FROM documents)
SELECT source, count(*) AS utterances, count(*) FILTER (n_chars >= 200) AS aligned, round(sum(n_chars) * 0.01e0, 6) AS seconds,
coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (n_chars < 200 AND nth <= 10), '') AS failed_ids FROM d GROUP BY source"""


def variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with variant suffixes and the words under them, counted."""
    w = words(spark, sf_dir).withColumn("variant", F.concat("word", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("("), (F.col("pos") % 4 + 2).cast("string"), F.lit(")"))).otherwise("")))
    out = w.select("variant", text.strip_variant(F.col("variant")).alias("word"))
    return out.groupBy("word").agg(F.count_distinct("variant").alias("variants"), F.count("*").alias("n"))


VARIANT_WORDS = f"""WITH {WORDS_SQL}
SELECT word, count(DISTINCT word || CASE WHEN pos % 3 = 0 THEN '(' || (pos % 4 + 2) || ')' ELSE '' END) AS variants, count(*) AS n FROM words GROUP BY word"""


def spoken_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language: the length of the audio (0.1 s a character) as text, and the time factor of half a second's work a document."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.sum("n_chars") / 10).alias("seconds"), F.count("*").alias("n"))
    spent = F.col("n") / 2
    return d.select("source", "lang", durations.human_duration(F.col("seconds")).alias("audio"), durations.human_duration(spent).alias("spent"), durations.real_time_factor(spent, F.col("seconds")).alias("rtf"))


_HUMAN = """CASE WHEN {s} < 60 THEN printf('%.1fs', {s}) WHEN {s} < 3600 THEN printf('%dm %02ds', floor({s} / 60)::BIGINT, floor({s})::BIGINT % 60)
ELSE printf('%dh %02dm %02ds', floor({s} / 3600)::BIGINT, floor({s})::BIGINT % 3600 // 60, floor({s})::BIGINT % 60) END"""

SPOKEN_DURATIONS = f"""WITH d AS (SELECT source, lang, sum(n_chars)::DOUBLE / 10 AS s, count(*)::DOUBLE / 2 AS e FROM documents GROUP BY ALL)
SELECT source, lang, {_HUMAN.format(s="s")} AS audio, {_HUMAN.format(s="e")} AS spent, CASE WHEN s > 0 THEN printf('%.3fx', e / s) ELSE '—' END AS rtf FROM d"""


#: A schedule of rounds (kind, subset, optional) for the sizes of the supplied tables.
ROUNDS = [("mono", 20, False), ("tri", 40, False), ("lda", 40, False), ("probs", 30, True), ("sat", 60, True), ("tri", 0, False), ("sat", 120, True), ("sat", 0, True)]


def effective_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds that the documents of each source and language would go through as a corpus; lda is disabled."""
    sizes = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("utts"))
    return schedules.effective_rounds(sizes, ROUNDS, {"lda"})


EFFECTIVE_SCHEDULE = f"""WITH r(nth, kind, subset, optional) AS (VALUES {", ".join(f"({n}, '{k}', {s}, {o})" for n, (k, s, o) in enumerate(ROUNDS))}),
sizes AS (SELECT source, lang, count(*) AS utts FROM documents GROUP BY ALL),
rounds AS (SELECT *, bool_or(optional AND subset > utts) OVER (PARTITION BY source, lang ORDER BY nth) AS ended FROM sizes, r WHERE kind <> 'lda')
SELECT source, lang, utts, nth, kind, CASE WHEN subset < utts THEN subset ELSE 0 END::BIGINT AS subset, optional FROM rounds WHERE NOT ended"""


QUERIES = {
    "spoken_durations": (spoken_durations, SPOKEN_DURATIONS),
    "effective_schedule": (effective_schedule, EFFECTIVE_SCHEDULE),
    "lexicon_oov": (lexicon_oov, LEXICON_OOV),
    "oov_top10": (oov_top10, OOV_TOP10),
    "lexicon_lookup": (lexicon_lookup, LEXICON_LOOKUP),
    "position_tags": (position_tags, POSITION_TAGS),
    "phone_remap": (phone_remap, PHONE_REMAP),
    "symbol_table": (symbol_table, SYMBOL_TABLE),
    "subset_shortest": (subset_shortest, SUBSET_SHORTEST),
    "greedy_chunks": (greedy_chunks, GREEDY_CHUNKS),
    "phone_words": (phone_words, PHONE_WORDS),
    "file_pairing": (file_pairing, FILE_PAIRING),
    "dictionary_columns": (dictionary_columns, DICTIONARY_COLUMNS),
    "prob_override": (prob_override, PROB_OVERRIDE),
    "multi_pron_share": (multi_pron_share, MULTI_PRON_SHARE),
    "scatter_results": (scatter_results, SCATTER_RESULTS),
    "align_summary": (align_summary, ALIGN_SUMMARY),
    "variant_words": (variant_words, VARIANT_WORDS),
}
