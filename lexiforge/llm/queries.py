"""One query for each operator, over whole tables, with production parameters; and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import bm25_packing, bt_quality, digest_index, flac_media, line_suffix, pitman_yor, prob_minhash, tiered_shards, token_cache, unigram_codec
from lexiforge.llm.common import crc_fold, documents, workspace


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = bt_quality.fit(docs, labels, learn=crc_fold("key", 3) != 1)
    out = bt_quality.score(docs, model)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), F.col("bt_score").alias("score"), (F.col("bt_score") >= 0.5).cast("int").alias("predicted"))


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, compacted; the shard of each document in the last version."""
    docs = documents(spark, sf_dir)
    store = tiered_shards.ShardStore(spark, workspace(spark, "shards"))
    for half in (0, 1):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half))
    store.compact(keep=1)
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "_shard.shard", F.col("_shard.rows").alias("shard_rows"), F.col("_shard.bytes").alias("shard_bytes"), "_shard.tier", F.lit(store.version()).cast("long").alias("version"))


def op3_unigram_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_codec.digest(texts(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(texts(spark, sf_dir), held_out=crc_fold("doc_id", 5) == 1)


def op5_prob_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(texts(spark, sf_dir)).drop("text_hash")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.digest(texts(spark, sf_dir))


def op7_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count_tokens(texts(spark, sf_dir), tokenizer("piece_bpe_32k.model"), workspace(spark, "token-cache"))


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack_documents(texts(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op9_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_suffix.clean(texts(spark, sf_dir))


def op10_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(texts(spark, sf_dir), digest_index.DigestIndex(spark, workspace(spark, "digest-index")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry_quality, op2_size_tiered_shards, op3_unigram_codec, op4_pitman_yor_score, op5_prob_minhash_dedup,
        op6_flac_media, op7_digest_token_counts, op8_bm25_packing, op9_suffix_line_dedup, op10_digest_index_dedup,
    )
}

ORACLE_SQL = {
    "op9_suffix_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
nb AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx,
              len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]{1,24}')) AS w FROM e WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
p AS (SELECT a.doc_id, a.idx, b.idx - a.idx + 1 AS n, a.w AS wa, b.w AS wb,
             sum(b.w) OVER x AS s, string_agg(b.line, chr(10)) OVER x AS k
      FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx AND a.idx + 9
      WINDOW x AS (PARTITION BY a.doc_id, a.idx ORDER BY b.idx)),
win AS (SELECT * FROM p WHERE s >= 10 AND (s - wb < 10 OR s - wa < 10)),
f AS (SELECT *, min(struct_pack(d := doc_id, i := idx)) OVER (PARTITION BY n, k) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(idx, idx + n - 1)) AS idx FROM f WHERE struct_pack(d := doc_id, i := idx) > first),
isl AS (SELECT g.doc_id, nb.pos, g.idx - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.idx) AS run FROM gone g JOIN nb USING (doc_id, idx)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS c FROM isl GROUP BY doc_id, run),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text FROM e
         WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = e.doc_id AND e.pos BETWEEN r.a AND r.b) GROUP BY e.doc_id),
n AS (SELECT doc_id, CAST(sum(c) AS INTEGER) AS c FROM runs GROUP BY doc_id),
o AS (SELECT d.doc_id, CASE WHEN n.c IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(n.c, 0) AS lines_deleted
      FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, text, lines_deleted, lines_deleted > 0 AND NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') AS all_deleted FROM o
""",
    "op10_digest_index_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
}
