"""The stages of the pipeline on empty tables and odd rows, each after the one before."""

import re

import corpus_pipeline
from tests.llm.helpers import ROWS, documents

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.collect() == [], name


def test_stages_on_odd_rows(spark):
    docs = documents(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        found = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(found.collect(), found.schema)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns, name
        if name in ("toxicity", "exact dedup", "simhash near-dedup"):
            assert docs.count() <= before, name
    assert 0 < kept["toxicity"].count() <= len(ROWS)
    texts = [r.text or "" for r in kept["exact dedup"].collect()]
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts}) == len(texts)
    mixed, pieces = kept["mixing"], kept["packing"].collect()
    # Every row that the mix took is packed once, from its first token to its end id.
    spans = {}
    for p in pieces:
        spans.setdefault((p.doc_id, p.row), []).append((p.start, p.length, p.doc_tokens))
    assert len(spans) == mixed.count()
    for parts in spans.values():
        at = 0
        for start, length, n in sorted(parts):
            assert start == at
            at += length
        assert at == n
