"""The operators over a given table, against brute force and held-out labels."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablegauge.llm import queries as q
from tablegauge.llm import simhash

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


def words(text):
    return len(WORD.findall(text or ""))


def linked(ids, fps, budget=3):
    """Component of every id: its smallest id, by comparing all pairs."""
    fps, parent = np.array(fps, dtype=np.uint64), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= budget):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def fingerprint(text):
    return simhash.fingerprint_of(text, 3, 42) & (1 << 64) - 1


@pytest.mark.parametrize("group_limit", [simhash.GROUP_LIMIT, 2])
def test_near_duplicates(spark, docs, group_limit):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = simhash.near_duplicates(df, group_limit=group_limit).collect()
    ids = sorted(docs.doc_id)
    text = dict(zip(docs.doc_id, docs.text))
    fps = [fingerprint(text[i]) for i in ids]
    want = linked(ids, fps)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in zip(ids, fps)}


def test_many_near_fingerprints(spark):
    """A dense ball of fingerprints, in groups too large for their limit."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    while len(fps) < 1500:
        flips = rng.choice(20, rng.integers(0, 7), replace=False)
        mask = np.uint64(sum(1 << int(b) for b in flips))
        fps.add(int((centres[rng.integers(4)] ^ mask).view(np.int64)))
    fps |= {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 500)}
    fps = sorted(fps)
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tablegauge.llm.components import components
    from tablegauge.llm.work import Scratch

    scratch = Scratch(spark)
    roots = {r.node: r.root for r in components(simhash.links(classes, 3, 64, scratch), scratch).collect()}
    got = defaultdict(set)
    for f in fps:
        got[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for f, root in linked(fps, [f & (1 << 64) - 1 for f in fps]).items():
        want[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_mixture_meets_its_targets(spark, docs):
    got = q.op7_mixing(spark, SF_DIR).toPandas().merge(docs[["doc_id", "source", "text"]])
    assert (got["size"] == got.text.map(words)).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    weights = [(5, 2, 1)[i % 3] for i in range(len(sums))]
    cap, total = 3 * sums["size"].to_numpy(float), float(sums["size"].sum())
    target = np.zeros(len(sums))
    free = np.ones(len(sums), dtype=bool)
    while True:  # share, cap, and share the excess again
        target[free] = (total - cap[~free].sum()) * np.array(weights)[free] / np.array(weights)[free].sum()
        over = free & (target > cap)
        if not over.any():
            break
        target[over] = cap[over]
        free &= ~over
    assert np.allclose(sums.target, target)
    assert (abs(sums.taken - sums.target) <= sums.most).all()
    assert abs(sums.taken.sum() - total) < 0.02 * total
    assert (abs(sums.taken - sums.target) <= 0.25 * sums.most).sum() > len(sums) // 2


def test_packed_tokens(spark, docs):
    got = q.op8_packing(spark, SF_DIR).toPandas().sort_values(["doc_id", "start"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {k: g for k, g in got.groupby("doc_id")}
    for doc_id, enc in zip(docs.doc_id, tokenizer.encode_batch(list(docs.text), add_special_tokens=False)):
        ids, at = np.array(enc.ids + [1], dtype="<u4"), 0
        for r in pieces[doc_id].itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    full = got.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == 2048).all()
    # every window holds every source's share to a token or two
    shares = got.merge(docs[["doc_id", "source"]]).groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    want = 2048 * shares.sum() / shares.to_numpy().sum()
    assert (abs(shares.iloc[:-1] - want) < 2).all().all()


def test_languages_of_held_out_documents(spark, docs):
    got = q.op1_language(spark, SF_DIR).toPandas().merge(docs)
    out = got[got.held_out]
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = q.op4_toxicity(spark, folder).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    out = got[got.held_out].merge(labels)
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit > 0.8 * (out.toxic == 1).sum() and hit > 0.9 * (out.predicted == 1).sum()


def test_pipeline_rejects_toxic_documents_of_every_language(spark):
    """The toxicity stage against the labels, not against its own model."""
    folder = "/root/testdata/sf0.1"
    docs, given = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    clean = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    known = docs.merge(given.groupby("doc_id", as_index=False).toxic.max())
    known["rejected"] = ~known.doc_id.isin(kept)
    for lang, rows in known.groupby("lang"):
        caught = (rows.rejected & (rows.toxic == 1)).sum()
        print(lang, caught, (rows.toxic == 1).sum(), rows.rejected.sum())
        assert caught > 0.5 * (rows.toxic == 1).sum() and caught > 0.8 * rows.rejected.sum(), lang


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    from tablegauge.llm import toxicity

    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{SF_DIR}/documents.parquet")

    def run(name, df):
        stages[name](spark, df, SF_DIR).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = run("toxicity", start)
    model = toxicity.fit(start, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    texts = dict(zip(docs.doc_id, docs.text))

    def score(text):
        n, found = toxicity.passages(text, model)
        return toxicity.probability(toxicity.evidence(n, found, model.rate), model.curve)

    want = sorted(i for i, t in texts.items() if score(t) < 0.3)
    assert sorted(r.doc_id for r in clean.collect()) == want

    first = {}
    for i in want:
        first.setdefault(SPACE.sub(" ", texts[i]), i)
    once = run("exact dedup", clean)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    ids = sorted(first.values())
    keep = sorted(set(linked(ids, [fingerprint(texts[i]) for i in ids]).values()))
    near = run("simhash near-dedup", once)
    assert sorted(r.doc_id for r in near.collect()) == keep

    mixed = run("mixing", near)
    counts = Counter(r.doc_id for r in mixed.collect())
    assert set(counts) <= set(keep) and max(counts.values()) <= 3
    assert {f.name for f in mixed.schema} == set(docs.columns)
    assert abs(sum(words(texts[i]) * n for i, n in counts.items()) / sum(words(texts[i]) for i in keep) - 1) < 0.1

    packed = run("packing", mixed).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in counts}
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n * tokens[i] for i, n in counts.items()}
