"""The pipeline against its stages done by hand."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haulgrid.llm import pii
from haulgrid.llm.queries import tokenizer_path
from haulgrid.llm.tokens import Encoder
from tests.llm.test_operators import DATA, ODD, SCHEMA, brute_components, brute_spans


@pytest.fixture
def odd_documents(spark):
    clash = ["sig", "key", "n", "start", "ids", "size", "id", "hash", "score", "spans", "_terms", "label", "k1", "term", "_id", "text_hash", "component"]
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in clash})


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, DATA)
        assert df.columns == docs.columns
        df = spark.createDataFrame(df.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    assert set(kept["language"]) == {k for k, t in rows if any(c.isalpha() for c in t)}
    near = brute_components([x for x in rows if x[0] in kept["language"]], 5, 80, 100)
    assert set(kept["near_copies"]) == {c for _, _, c in near}
    texts = dict(rows)
    leaked = {k for k in kept["near_copies"] if any(b in " ".join(re.findall(r"\w+", texts[k].lower())) for b in benchmark)}
    assert leaked and set(kept["benchmark_leaks"]) == set(kept["near_copies"]) - leaked
    assert kept["personal_data"] == {k: pii.redacted(texts[k], brute_spans(texts[k])) for k in kept["benchmark_leaks"]}
    got = corpus_pipeline.run(spark, DATA).collect()
    e = Encoder(tokenizer_path())
    sizes = Counter()
    for r in got:
        sizes[r.doc_id] += r.length
    assert sizes == {k: len(e.whole(t)) // 4 + 1 for k, t in kept["personal_data"].items()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_stages_on_odd_rows(spark, odd_documents):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names: each stage keeps what it must."""
    columns = odd_documents.columns
    ids = {name: Counter() for name, _ in corpus_pipeline.STAGES[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, DATA)
        assert out.columns == columns
        ids[name] = Counter((r.doc_id, r.text) for r in out.collect())
    rows = Counter((r.doc_id, r.text) for r in odd_documents.collect())
    assert ids["language"] == Counter({k: n for k, n in rows.items() if any(c.isalpha() for c in k[1] or "")})
    assert ids["benchmark_leaks"] == ids["personal_data"] == rows
    assert sum(corpus_pipeline.STAGES[-1][1](spark, odd_documents, DATA).select("doc_id", "start").collect().count(x) for x in [(7, 0)]) == 1
