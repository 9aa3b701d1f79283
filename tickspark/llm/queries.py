"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import cas, counts, langid, mixing, neardup, outliers, packing, secrets, stream_dedup, toxicity
from tickspark.llm.common import documents, work_dir
from tickspark.llm.tokens import tokenizer_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = work_dir(spark, "store")
    cas.write_store(documents(spark, sf_dir), store, tokenizer_path(WORD_BPE), end_id=1)
    return cas.read_digests(spark, store, work_dir(spark, "facts"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.rates(documents(spark, sf_dir), labels)


def op4_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = work_dir(spark, "counts")  # a new cache, so that every run counts everything
    found = counts.count_tokens(documents(spark, sf_dir), cache, tokenizer_path(BYTE_BPE))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_content_store": op1_content_store,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_digest_cache": op4_digest_cache,
    "op5_secret_scan": op5_secret_scan,
    "op6_streaming_dedup": op6_streaming_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_hyperminhash": op10_hyperminhash,
    "pipeline": pipeline,
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL = {
    "op6_streaming_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    # equal sets are one node; links by shared shingles; the closure walks from each node to the least it reaches
    "op10_hyperminhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS MATERIALIZED (
          SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
        named AS MATERIALIZED (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS node, sh FROM s),
        nodes AS MATERIALIZED (SELECT node, min(doc_id) AS least, any_value(n) AS n, any_value(sh) AS sh FROM named WHERE node IS NOT NULL GROUP BY node),
        e AS MATERIALIZED (SELECT least, n, unnest(sh) AS x FROM nodes),
        links AS MATERIALIZED (
          SELECT a, b FROM (SELECT a.least AS a, b.least AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.least <> b.least GROUP BY a.least, b.least)
          WHERE 100 * shared >= 85 * (na + nb - shared)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        labels AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, d.n AS n_shingles, coalesce(least(n.least, l.b), n.least, d.doc_id) AS component_id, d.doc_id = coalesce(least(n.least, l.b), n.least, d.doc_id) AS kept
        FROM named d LEFT JOIN nodes n ON d.node = n.node LEFT JOIN labels l ON l.a = n.least""",
}
