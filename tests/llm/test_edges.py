"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tablegauge.llm import (
    exact_dedup,
    language,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from tests.llm.helpers import LONG, ROWS, documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates(spark):
    rows = exact_dedup.exact_duplicates(documents(spark), first_digit=4, growth=4).collect()
    texts = Counter(normal(r[1]) for r in ROWS)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert Counter(sha[r.text_sha256] for r in rows) == texts
    for t, n in texts.items():
        own = [r for r in rows if sha[r.text_sha256] == t]
        ids = [r[0] for r in ROWS if normal(r[1]) == t and r[0] is not None]
        assert {r.group_size for r in own} == {n}
        assert {r.keep_id for r in own} == {min(ids) if ids else None}
        assert [r.doc_id for r in own if r.kept] == [min(ids) if ids else None]


def test_drop_exact_duplicates_keeps_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert Counter(normal(r.text) for r in kept.collect()) == Counter({normal(r[1]): 1 for r in ROWS})


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.component_id) for r in rows}
    assert {(5, 5), (6, 5), (1, 1), (2, 1), (7, 7), (None, None)} <= found
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 9)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 9)} == {3}
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 5), (False, 7), (False, 8), (True, 0)
    ]


def test_mixing(spark):
    rows = mixing.mixture(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 3 * r.size and (r.size or not r.taken) for r in rows)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    assert sum(r.size for r in rows) == words
    again = mixing.mixture(documents(spark)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(documents(spark))
    assert mixed.columns == documents(spark).columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_packing(spark):
    rows = packing.packed(documents(spark), BPE, window=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in ROWS)
    windows: dict = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    # documents with one copy come back exactly
    for (doc_id, ids), n in want.items():
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == doc_id and r.doc_tokens == len(ids))
        if n == 1 and sum(d == doc_id for d, _ in want) == 1:
            assert b"".join(b for _, b in own) == np.array(ids, "<u4").tobytes()
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())


def test_language(spark):
    train = documents(spark, [(i, "the house and the tree", "en", "a") for i in range(3)]
                      + [(9, "das haus und der baum", "de", "a"), (10, None, "de", "a"), (11, "x", None, None)])
    model = language.fit(train)
    rows = {r.doc_id: r for r in language.identify(documents(spark, [
        (1, "the tree", "de", "a"), (2, "baum haus", None, "a"), (3, "12 !?", "en", "a"), (4, None, "en", "a"),
        (5, "houses trees", "en", "a"), (6, "baume und hauser", "en", "a")]), model).collect()}
    assert [rows[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in rows.values())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    clean = [(i, f"plain words about topic {i} and nothing else", "en", "a") for i in range(200)]
    toxic = [(1000 + i, f"you nasty fool nasty fool of topic {i}", "en", "b") for i in range(60)]
    train = labels(spark, [(r[0], 1, 0) for r in clean] + [(r[0], 0, 1) for r in toxic] + [(1000, 1, 0), (None, 1, 1), (5, 1, None)])
    docs = documents(spark, clean + toxic + ROWS)
    model = toxicity.fit(docs, train)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == 260 + len(ROWS)
    assert all(r.predicted == (r.doc_id is not None and r.doc_id >= 1000) for r in rows)
    assert all(0 <= r.score <= 1 and (r.passages if r.predicted else True) for r in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 200 + len(ROWS)


def test_toxic_words_of_a_rarely_labelled_language(spark):
    """Its toxic words are rare one by one; new ones share only their stem with those labelled."""
    ends = [a + b for a in "bdfgklmnprst" for b in ("ato", "eno", "iro", "ula")]
    clean = [(i, " ".join(f"c{e}{ends[(i * k + 7) % 48]}" for k, e in enumerate(ends[i % 5 :: 5])), "es", "a") for i in range(300)]
    toxic = [(1000 + i, f"c{ends[i]} " + " ".join(f"zomente{ends[(i * 5 + k) % 48]}" for k in range(4)), "es", "b") for i in range(24)]
    new = [(2000 + i, f"c{ends[i]} zomente{ends[i]}xi zomente{ends[i]}or cato zomente{ends[i]}ud", "es", "b") for i in range(9)]
    train = labels(spark, [(r[0], 1, 0) for r in clean] + [(r[0], 0, 1) for r in toxic])
    docs = documents(spark, clean + toxic + new)
    model = toxicity.fit(docs, train)
    rows = toxicity.toxicity(docs, model).collect()
    assert {r.doc_id for r in rows if r.predicted} == {r[0] for r in toxic + new}


def test_toxicity_learns_from_at_most_so_many_bytes(spark):
    docs = documents(spark, [(i, "vile words here" if i % 2 else "kind words here", "en", "a") for i in range(40)])
    train = labels(spark, [(i, 1, i % 2) for i in range(40)])
    whole = toxicity.fit(docs, train, max_bytes=40 * 15)
    assert whole.words == toxicity.fit(docs, train).words and whole.words["vile"] > 0
    half = toxicity.fit(docs, train, max_bytes=40 * 15 // 2)
    assert half.words["vile"] < whole.words["vile"]
    assert toxicity.fit(docs, train, max_bytes=14).words == {}


def test_maximal_segments():
    scores = [4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]
    assert toxicity.maximal_segments(scores) == [(0, 0, 4), (2, 2, 3), (4, 10, 7)]
    assert toxicity.maximal_segments([]) == [] and toxicity.maximal_segments([-1.0, -2.0]) == []


def test_token_counts(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    unigram = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    extra = ["  b  c ", "▁▁a ▁b", "<s> </s> <0x0A> <unk>", "naïve​ x", "ab" * 500, "\U0001f600" * 40]
    docs = ROWS + [(100 + i, t, "en", "a") for i, t in enumerate(extra)]
    rows = token_counts.token_counts(documents(spark, docs), token_counts.vocabulary(path)).collect()
    want = Counter((r[0], len(unigram.encode(r[1] or "").ids)) for r in docs)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want


def test_quality(spark):
    rows = quality.judged(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].n_words == 30_000 and not by_id[5].base_failed
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    repeated = documents(spark, [(1, "a b c d e f a b c d e", "en", "s"), (2, "x\n\nx\nx\n", "en", "s")])
    found = {r.doc_id: r for r in quality.judged(repeated).collect()}
    assert found[1].n_repeat_words == 10 and found[2].n_dup_lines == 2


def test_hosts_lose_all_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "en", "bad") for i in range(90)] + [(100 + i, good, "en", "bad") for i in range(10)]
    rows += [(200 + i, good, "en", f"h{i % 20}") for i in range(200)]
    kept = {r.doc_id for r in quality.judged(documents(spark, rows)).collect() if r.kept}
    assert kept == {200 + i for i in range(200)}


def test_secrets(spark):
    key = "AKIA" + "A1B2" * 4
    token = "zq9Xw8Vt7Ub6Sn5Rm4Ql3"
    text = f"😀 {key} and password = 'abc' then secret:abcdefg"
    at = text.index("secret:")
    rows = [(1, text, "en", "a"), (2, "f" * 24 + " " + token, "en", "b")]
    rows += [(10 + i, f"use {token[::-1]} here", "en", f"s{i}") for i in range(5)]
    rows += [(3, "password=token:abcdef", "en", "a"), (4, "x" * 50_000 + " token=" + "q" * 9, None, None)]
    got = {r.doc_id: r for r in secrets.secret_digests(documents(spark, rows)).collect()}
    assert got[1].spans == f"access:2:22,assign:{at}:{len(text)}" and (got[1].n_assign, got[1].n_access) == (1, 1)
    assert got[2].spans == f"hex:0:24,token:25:{25 + len(token)}"
    assert got[2].base_sha256 == hashlib.sha256(b"hex:0:24").hexdigest()
    assert {got[10 + i].spans for i in range(5)} == {""}  # widely copied
    assert got[3].n_assign == 0 and got[4].spans == "assign:50001:50016"


def test_many_spans_in_one_text(spark):
    text = "token=abcdef " * 700
    (row,) = secrets.secret_digests(documents(spark, [(1, text, "en", "a")])).collect()
    assert row.spans == ",".join(f"assign:{13 * i}:{13 * i + 12}" for i in range(700))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n😀</p>\r\n"
    rows = [(3, "http://a/x?y=1", tricky), (1, "http://b/", tricky), (2, None, None), (None, "u\r\nv", ""), (5, "::[", "\r\n\r\n"),
            (7, "u", LONG), (8, "u", LONG), (9, "u", "once"), (9, "w", "once")]
    got = warc.archived_pages(pages(spark, rows).repartition(3)).collect()
    first: dict = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    want = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        revisits = page_id != first[html or ""]
        want[(page_id, len(payload), warc.payload_digest(payload), "revisit" if revisits else "response",
              first[html or ""] if revisits else None, True)] += 1
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == want


def test_warc_further_columns_are_not_read(spark):
    """Columns named as those of the records, or of the result, make no difference."""
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (None, None, None)]
    plain = pages(spark, rows)
    clashing = plain.selectExpr("*", "'p' AS payload", "7 AS row", "'d' AS payload_digest", "'r' AS record_type", "map(1, 2) AS headers")
    assert Counter(map(tuple, warc.archived_pages(clashing).collect())) == Counter(map(tuple, warc.archived_pages(plain).collect()))


def test_warc_captures_are_nested(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "http://a/", "x"), (2, "http://b/", "y")]), str(tmp_path / "a"), min_bytes=5)
    found = warc.captures(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert sorted(bytes(r.response.payload) for r in found) == [b"x", b"y"]
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and r.response.digest_ok for r in found)


def test_empty_tables(spark):
    docs = documents(spark, [])
    none = labels(spark, [])
    assert exact_dedup.exact_duplicates(docs).collect() == []
    assert simhash.near_duplicates(docs).collect() == []
    assert mixing.mixture(docs).collect() == []
    assert packing.packed_digests(docs, BPE).collect() == []
    assert language.identify(docs, language.fit(docs)).collect() == []
    assert toxicity.toxicity(docs, toxicity.fit(docs, none)).collect() == []
    assert quality.judged(docs).collect() == []
    assert secrets.secret_digests(docs).collect() == []
    assert warc.archived_pages(pages(spark, [])).collect() == []
    assert token_counts.token_counts(docs, token_counts.Vocabulary({"a": -1.0}, False, -11.0)).collect() == []


def test_labels_without_toxic_documents(spark):
    docs = documents(spark)
    model = toxicity.fit(docs, labels(spark, [(1, 1, 0), (2, 1, 0)]))
    assert {r.predicted for r in toxicity.toxicity(docs, model).collect()} == {0}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, tmp_path, number):
    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    out = corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert out.count() > 0
