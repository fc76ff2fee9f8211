"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.llm import chat, clustering, decontam, minhash, mixing, order_minhash, quality, secret_scan, simhash, suffix_dedup, toxicity, urls, whitening
from rowgate.llm.common import fold, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels, fold("label_id", 3) != 1)
    score = F.col("quality_score")
    return quality.score(docs, network).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_log_odds")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("label_id", 5) != 0)
    score = F.col("toxic_score")
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows)
    turns = chat.read_back("formatted")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.masked("formatted", "loss_mask"), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("spans")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    own = (
        op1_quality_classifier,
        op2_url_filters,
        op3_toxicity,
        op4_chat_formatting,
        op5_secret_scans,
        op6_suffix_array_dedup,
        op7_document_fingerprints,
        op8_simhash_near_dedup,
        op9_benchmark_decontamination,
        op10_mixing_sources,
        op11_centroid_clustering,
        op12_embedding_whitening,
        op13_minhash_near_dedup,
        pipeline,
    )
    return {f.__name__: f for f in own}


_MESSAGES = """
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
"""

OP4_SQL = f"""
SELECT conv_id, count(*)::BIGINT AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<|turn|>' || '<|says|>' || '<|end|>') + length(role) + length(text)
  + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g')))::BIGINT AS formatted_chars
FROM ({_MESSAGES}) GROUP BY conv_id
"""

OP10_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
 filled AS (SELECT *, 2 * source_size / weight AS full_at FROM sources),
 levels AS (
  SELECT *, (1.5 * (sum(source_size) OVER ())
    - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / ((sum(weight) OVER ())
    - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM filled),
 level AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE level < full_at),
 targets AS (
  SELECT source, source_size::BIGINT AS source_size, coalesce(least(2 * source_size, weight * (SELECT level FROM level)), 2 * source_size) AS target
  FROM levels),
 rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
 (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE
   < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


def _op11_sql(rounds: int = 10) -> str:
    """All rounds one after the other, every vector against every centroid."""
    steps = [
        """
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c::DOUBLE))) = 64),
long AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range(64)) AS i FROM v),
first AS (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c FROM v QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS m, unnest(range(64)) AS i FROM first)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM long JOIN c{n} USING (i) GROUP BY r, c)
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{n}
 LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN long USING (r) GROUP BY c, i) USING (c, i))""")
    return f"""WITH {",".join(steps)},
named AS (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN named USING (c)
"""


OP13_SQL = r"""
WITH RECURSIVE cut AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
 whole AS MATERIALIZED (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM cut),
 sizes AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM whole),
 shingles AS MATERIALIZED (SELECT r, unnest(s) AS s FROM whole),
 pairs AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r) p
   JOIN sizes a ON p.a = a.r JOIN sizes b ON p.b = b.r WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
 reached(a, b) AS (SELECT r, r FROM sizes UNION SELECT reached.a, pairs.b FROM reached JOIN pairs ON reached.b = pairs.a)
SELECT x.doc_id, x.n::BIGINT AS n_shingles, min(y.doc_id) AS component_id, x.doc_id IS NOT DISTINCT FROM min(y.doc_id) AS kept
FROM reached JOIN sizes x ON reached.a = x.r JOIN sizes y ON reached.b = y.r GROUP BY x.r, x.doc_id, x.n
"""


def oracle_sql() -> dict[str, str]:
    out = {"op4_chat_formatting": OP4_SQL, "op10_mixing_sources": OP10_SQL, "op11_centroid_clustering": _op11_sql(), "op13_minhash_near_dedup": OP13_SQL}
    from corpus_pipeline import ORACLE_SQL

    if ORACLE_SQL:
        out["pipeline"] = ORACLE_SQL
    return out
