"""Queries of this subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.common import shared_dir, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.lines import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.substring import dedup_substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, digests=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.images import image_copies, rendered

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return image_copies(rendered(vectors)).withColumnRenamed("id", "vec_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.quality import CLEAN, grade_documents, ratings_of, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")))
    return grade_documents(docs, model, CLEAN).select("doc_id", "expected_grade", "p_tail", "keep")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.bpe import build_lexicon, digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer_file(), build_lexicon(docs, tokenizer_file()))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a cache of its own, empty at first: all distinct texts are encoded."""
    from quaver.llm.tokencount import count_tokens

    cache = f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), cache)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.llm.audit import failures, interactions

    return interactions(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_line_dedup,
        op3_language_id,
        op4_substring_dedup,
        op5_best_fit_packing,
        op6_image_copies,
        op7_warc,
        op8_quality_classifier,
        op9_bpe,
        op10_fingerprints,
        op11_fill_in_middle,
        op12_token_counts,
        op13_filter_audit,
    )
}

SQL = {
    "op4_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM windows
), least AS (
  SELECT h, min(doc_id) AS d FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hashed JOIN least USING (h) WHERE doc_id > d
), gone AS (
  SELECT doc_id, list(i) AS r FROM removed GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(r), 0)::BIGINT AS n_removed,
  sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF r IS NULL OR NOT list_contains(r, i)], ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
""",
    "op7_warc": """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), hashed AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM own
), least AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM least
""",
    "op11_fill_in_middle": r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM own
), told AS (
  SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM told
)
SELECT doc_id, len(w)::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""",
    "op13_filter_audit": r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM own
), rated AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter([
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS f
  FROM worded LEFT JOIN rated USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), played AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, f,
    list_contains(f, filter_order[step]) AS fails, list_has_any(f, string_split(filter_order[1:step - 1], '')) AS before
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT before), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (fails AND before), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND len(f) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT before), 0) AS toxic_lost
  FROM played GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
""",
}
