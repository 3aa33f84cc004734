"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumplake.llm import (
    bpe, decontaminate, filter_audit, licenses, line_dedup, nn_descent, packing, pii, rans, simhash_dedup, toxicity, warc, whitening)
from dumplake.llm.registry import query, table
from dumplake.session import stage, stage_path

#: Vocabulary of the multilingual byte-level BPE query.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Vocabulary of the token-id files.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Vocabulary of the packed sequences.
WORDS = public_tokenizers.path("word_bpe_49k.json")


@query("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages),
    g AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS groups FROM p)
    SELECT page_id, octet_length(encode(html)) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 15) & 31)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 10) & 31)::INT, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 5) & 31)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x & 31)::INT, 1) FOR x IN groups], '') AS payload_digest,
      CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to, true AS verified
    FROM g
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = stage_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


@query()
def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as sections and read back."""
    path = stage_path(spark, "rans")
    rans.write_ids(table(spark, sf_dir, "documents"), path, TOKENIZER, public_tokenizers.PATTERN)
    read = rans.read_ids(spark, path).select("part", "section", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rans.with_starts(stage(read, "rans-read")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the classifier learnt from the labels that may teach."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, and how much of it was a later copy."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum([x * x FOR x IN embedding::DOUBLE[]]) > 0),
    pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
    FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a
""")
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.cluster(table(spark, sf_dir, "documents"))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(text) AS n_chars FROM docs),
    known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * n_chars)::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * EXISTS (SELECT 1 FROM docs d WHERE d.text = w.text AND d.doc_id < w.doc_id)::INT AS bits
      FROM w LEFT JOIN known USING (doc_id)),
    c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
    o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS masks
      FROM l l1, l l2, l l3, l l4, l l5 WHERE (l1.b | l2.b | l3.b | l4.b | l5.b) = 31),
    s AS (SELECT filter_order, step, masks[step] AS bit, coalesce(list_sum(masks[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, sum(n) FILTER ((bits & (before | bit)) = 0) AS kept, sum(n) FILTER ((bits & before) = 0 AND (bits & bit) != 0) AS removed,
        sum(n) FILTER ((bits & before) != 0 AND (bits & bit) != 0) AS redundant, sum(n) FILTER (bits = bit) AS unique_fails,
        sum(good) FILTER ((bits & before) = 0 AND (bits & bit) != 0) AS good_lost, sum(toxic) FILTER ((bits & before) = 0 AND (bits & bit) != 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step)
    SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
      coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
      (sum(coalesce(removed, 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley
    FROM r
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five filters under every order of applying them, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
