"""The registered queries of this package and their SQL oracles."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, hard_negatives, html_extract, license_scan, mixing, ngram_join, periodic_runs, quality_fm, sentencepiece_bpe, syncmers, toxicity, warc, word_bpe

#: Where the tokenizer model lies, unless a caller names another file.
MODEL = "piece_bpe_32k.model"
TOKENIZER = "word_bpe_49k.json"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors, once a session, for clusters whose Python path lacks it."""
    context = spark.sparkContext
    if not getattr(context, "_strandline_shipped", False):
        top = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp()) / "strandline.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(packed))
        context._strandline_shipped = True
    return spark


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sizes AS (SELECT name, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY name),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sizes),
level AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER w AS BIGINT), 0))
            / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS lvl
  FROM ranked WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT name, source_size,
         CASE WHEN lvl * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
              ELSE least((SELECT arg_min(lvl, 3 * source_size / weight) FROM level WHERE NOT lvl * weight > 3 * source_size) * weight,
                         CAST(3 * source_size AS DOUBLE)) END AS target
  FROM level),
summed AS (
  SELECT r.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY r.name ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through
  FROM rows r JOIN target t ON r.name = t.name),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - (through - size))) AS BIGINT) AS taken
FROM epochs
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM bodies)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.tokenize_documents(_table(spark, sf_dir, "documents"), model_path())


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM r
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_of_documents(_table(spark, sf_dir, "documents"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.tokenize_documents(_table(spark, sf_dir, "documents"), model_path(TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_syncmers": op4_syncmers,
        "op5_toxicity": op5_toxicity,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_html": op7_html,
        "op8_licenses": op8_licenses,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_runs": op12_runs,
        "op13_word_bpe": op13_word_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL}
