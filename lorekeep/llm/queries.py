"""Queries over the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicated

    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived_pages

    rows = archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, html, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100
             THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS first FROM pages)
"""


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_index import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


OP3_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT n AS a, n AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.n = b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.n) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN found ON found.a = v.n
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0
    OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), budget=2, width=3).select("doc_id", "fingerprint", "component_id")


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mixed

    rows = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import language_scores

    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import found

    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import fingerprint_documents

    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, sketches=64, tuple_size=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dual_tree import hard_negatives

    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, positives=5, negatives=10)


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id % 100 = 0)),
scores AS (SELECT a.anchor, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM anchors a JOIN v ON len(a.e) = len(v.e)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scores WHERE same AND vec_id IS DISTINCT FROM anchor_id) WHERE place <= 5),
negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
              row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS rank
              FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def op12_heap_merge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import index, search

    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
items AS (SELECT DISTINCT item_id, text AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
sums AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sums GROUP BY term),
lengths AS (SELECT row, 100 - 90 + (90 * len(t)::BIGINT * n) // l AS m FROM d, sums),
scores AS (SELECT item_id, item, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row) GROUP BY item_id, item, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


#: Rules that every page is judged by first: fixed values of the task.
PAGE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import given, judged, labelled_pages, mined

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = mined(labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(pages, given(spark, PAGE_RULES), rules).select("page_id", "host", "path", "rule", "verdict", "by")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_salvage": OP2_SQL, "op3_pivot_permutation": OP3_SQL, "op11_dual_tree_negatives": OP11_SQL, "op12_heap_merge_search": OP12_SQL}
