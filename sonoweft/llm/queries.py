"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocation, decontam, exact, lm, media, packing, runs, shared, sharding, simhash, tokenfile, toxicity, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared.new_path(spark, "warc")
    files = warc.write(warc.page_records(pages), folder)
    back = warc.records(warc.read(spark, warc.written(files, folder), payloads=False))
    return back.select(
        warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to")).alias("refers_to")
    )


def op2_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.cut(docs, vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")
    return packing.pack(pieces)


#: What every formatting of ``conversations`` also covers: a text full of control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_schema_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    records = chat.canonical(chat.records_of(rows.unionByName(control)))
    return chat.digests(chat.formatted(records))


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 14 AS chars FROM rows
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars)::BIGINT AS formatted_chars,
    list(role ORDER BY turn, role, text) AS roles
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction'
    WHEN coalesce(((conv_id % 3) + 3) % 3, 0) = 0 THEN 'messages' WHEN ((conv_id % 3) + 3) % 3 = 1 THEN 'conversations' ELSE 'dialog' END AS layout
FROM grouped
"""


def op4_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = media.edited(media.rendered(embeddings.where("vec_id % 100 = 0")))
    found = media.copies(media.rendered(embeddings), queries)
    return found.select(F.col("image_id").alias("vec_id"), "class_id", F.col("queries.query_id").alias("query_ids"), F.col("queries.inliers").alias("inliers"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(toxicity.remainder("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontam.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenfile.round_trip(spark, docs, vocabulary("byte_bpe_50k.json"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm.score(docs, toxicity.remainder("doc_id", 10) == 0)


def op11_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact.classes(docs, {"sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("carried.sha256").alias("text_sha256"))


OP11_SQL = """
WITH sized AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM sized WINDOW same AS (PARTITION BY t)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return runs.digests(runs.periodic_runs(runs.planted(docs)))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), split AS (
  SELECT doc, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_split_to_array(piece, '[\x20\x09]+') AS ws FROM split
), words AS (
  SELECT * FROM (SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM pieces) WHERE w <> ''
), next AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), f1 AS (SELECT lang, w1, count(*) AS f FROM next GROUP BY ALL
), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM next WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM next WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS f FROM next WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM f2 x JOIN f1 p ON (p.lang, p.w1) = (x.lang, x.w1) JOIN f1 q ON (q.lang, q.w1) = (x.lang, x.w2)
  UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, p.f, q.f
  FROM f3 x JOIN f1 p ON (p.lang, p.w1) = (x.lang, x.w1) JOIN f2 q ON (q.lang, q.w1, q.w2) = (x.lang, x.w2, x.w3)
  UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, p.f, q.f
  FROM f3 x JOIN f2 p ON (p.lang, p.w1, p.w2) = (x.lang, x.w1, x.w2) JOIN f1 q ON (q.lang, q.w1) = (x.lang, x.w3)
  UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 || ' ' || x.w4, x.f, 1, p.f, q.f
  FROM f4 x JOIN f1 p ON (p.lang, p.w1) = (x.lang, x.w1) JOIN f3 q ON (q.lang, q.w1, q.w2, q.w3) = (x.lang, x.w2, x.w3, x.w4)
  UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 || ' ' || x.w4, x.f, 2, p.f, q.f
  FROM f4 x JOIN f2 p ON (p.lang, p.w1, p.w2) = (x.lang, x.w1, x.w2) JOIN f2 q ON (q.lang, q.w1, q.w2) = (x.lang, x.w3, x.w4)
  UNION ALL SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 || ' ' || x.w4, x.f, 3, p.f, q.f
  FROM f4 x JOIN f3 p ON (p.lang, p.w1, p.w2, p.w3) = (x.lang, x.w1, x.w2, x.w3) JOIN f1 q ON (q.lang, q.w1) = (x.lang, x.w4)
), scored AS (
  SELECT *, (2000000::HUGEINT * a) // (l + r) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, inner_phrase AS phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS inner_phrase, f FROM f3
    UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3
    UNION ALL SELECT lang, w1 || ' ' || w2, f FROM f4
    UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f4
    UNION ALL SELECT lang, w3 || ' ' || w4, f FROM f4
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f FROM f4
    UNION ALL SELECT lang, w2 || ' ' || w3 || ' ' || w4, f FROM f4
  ) GROUP BY lang, inner_phrase
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, c.score
  FROM lowest c LEFT JOIN longer g ON (g.lang, g.phrase) = (c.lang, c.phrase)
  WHERE g.f IS NULL OR 100 * g.f::HUGEINT < 80 * c.a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_salvage_warc": op1_salvage_warc,
        "op2_best_two_fit_packing": op2_best_two_fit_packing,
        "op3_schema_chats": op3_schema_chats,
        "op4_local_descriptors": op4_local_descriptors,
        "op5_toxicity": op5_toxicity,
        "op6_covering_simhash": op6_covering_simhash,
        "op7_vector_sharding": op7_vector_sharding,
        "op8_qgram_decontamination": op8_qgram_decontamination,
        "op9_token_files": op9_token_files,
        "op10_backoff_automaton": op10_backoff_automaton,
        "op11_radix_exact_dedup": op11_radix_exact_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_schema_chats": OP3_SQL, "op11_radix_exact_dedup": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
