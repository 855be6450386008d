"""The operators' queries over whole tables, for __spark_entry__.py: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lexical, lm, media, negatives, packing, secrets, simhash, token_counts, toxicity, warc, wavelet
from .common import tables


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return wavelet.read_shards(wavelet.write_shards(docs, "word_bpe_49k.json", end_id=1), with_ids=False)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2, window=4096)


def op4_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(tables(spark, sf_dir, "pages"), min_revisit_bytes=0)
    found = warc.records(warc.read_archives(files, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_from_table(tables(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.fingerprints(media.media_column(tables(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("codes"), F.hex(F.xxhash64("frames", "codes")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "frames", "codes")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"), "piece_bpe_32k.model")
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"), decontam.WHOLE)


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, tables(spark, sf_dir, "labels")))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = tables(spark, sf_dir, "documents").withColumn("held_out", lm.held_out())
    model = lm.train(docs.where("not held_out"))
    found = lm.score(docs, model)
    return found.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each hundredth vector, after every seventh label has been made wrong."""
    rows = tables(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", noisy))


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical.ranked(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"), 10)


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), about AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM docs WHERE len(terms) > 0
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, about WHERE term IN (SELECT term FROM items) GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), about GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_wavelet_shards,
        op2_simhash_near_duplicates,
        op3_packing,
        op4_web_archives,
        op5_token_counts,
        op6_media_fingerprints,
        op7_language_id,
        op8_spaced_seed_decontamination,
        op9_entropy_secrets,
        op10_ordinal_toxicity,
        op11_language_model,
        op12_hard_negatives,
        op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
