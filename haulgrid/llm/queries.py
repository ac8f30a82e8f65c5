"""The operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulgrid.llm import decontaminate, langid, lm_score, media, ngram_join, packing, pii, sharding, tokenfile, urlfilter

#: The public tokenizer's file name; its place is asked of the package that holds it.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_table(spark, sf_dir, "documents"))


def op3_shard_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_report(_table(spark, sf_dir, "documents"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    labelled = urlfilter.page_labels(pages, _table(spark, sf_dir, "labels"))
    return urlfilter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pack_differencing, op2_media_boxes, op3_shard_propagation, op4_template_leaks, op5_token_file, op6_ngram_join, op7_pii_disclosure, op8_masked_likelihood, op9_url_templates, op10_language_spans)}

ORACLE_SQL = {
    # Shingles of words, pairs that share enough of them, and what can be reached by links.
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
""",
}
