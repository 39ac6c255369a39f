"""The queries of the corpus operators over the driver's tables, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm import decontam, langid, licences, lmscore, negatives, runs, sentencepiece, shards, simhash, suffixes, toxicity, urlfilter, vectors
from orograph.llm.common import learning_rows, new_path, table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), chosen)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(learning_rows(F.col("doc_id"))))
    told = langid.identify(docs, model)
    return told.select("doc_id", (~learning_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(learning_rows(F.col("doc_id"))))
    told = toxicity.score(docs, model)
    return told.select("doc_id", (~learning_rows(F.col("doc_id"))).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"), arrivals=4)
    done = store.compact()
    store.vacuum()
    return store.shards(["doc_id"], done).withColumn("version", F.lit(done.version))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_repeats(table(spark, sf_dir, "documents"))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.repeats_removed(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_embeddings": op7_embeddings,
    "op8_url_filter": op8_url_filter,
    "op9_licences": op9_licences,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL = {
    "op8_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ), rules(verdict, host, path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), hits AS (
            SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
            FROM parts p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
             AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1
    """,
    "op11_hard_negatives": """
        WITH rows_ AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM rows_ a JOIN rows_ r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
        ), positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score
            FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS n
            FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        )
        SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE n <= 3
    """,
    "op13_suffix_dedup": """
        WITH texts AS (
            SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents
        ), segments AS MATERIALIZED (
            SELECT doc_id, 512 * b AS base, array_slice(x, 512 * b + 1, 512 * b + 561) AS s FROM texts, unnest(range((octet_length(x) + 511) // 512)) AS t(b)
        ), windows AS MATERIALIZED (
            SELECT doc_id, base + i AS i, array_slice(s, i + 1, i + 50) AS w FROM segments, unnest(range(least(512, octet_length(s) - 49))) AS t(i)
        ), firsts AS (
            SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS earlier FROM windows JOIN firsts USING (w) WHERE least < doc_id
        ), marked AS (
            SELECT doc_id, i, sum(CASE WHEN i <= earlier + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM gone
        ), spans AS (
            SELECT doc_id, n, min(i) AS s, max(i) + 50 AS e FROM marked GROUP BY doc_id, n
        ), parts AS (
            SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans
        ), cut AS (
            SELECT p.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS rest,
                   string_agg(hex(array_slice(x, before + 1, s)), '' ORDER BY s) AS head
            FROM parts p JOIN texts t ON p.doc_id = t.doc_id GROUP BY p.doc_id
        )
        SELECT t.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || hex(array_slice(x, coalesce(rest, 0) + 1, octet_length(x))))) AS kept_sha256
        FROM texts t LEFT JOIN cut c ON t.doc_id = c.doc_id
    """,
}
