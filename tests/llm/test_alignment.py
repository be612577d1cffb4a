"""Alignment against tokens walked one by one, with the libraries' own tokenizers."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tablegauge.llm import alignment
from tablegauge.llm.alignment import alignments, linked_pairs
from tests.llm.helpers import LONG, documents

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001/documents.parquet"


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def tokens(texts):
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    table = byte_of()
    for text in texts:
        if not text:
            yield [], []
            continue
        left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = f" {text}".encode()
        spelled = [b"".join(x for _, x in side) for side in (left, right)]
        yield (left, right) if spelled == [whole, whole] else ([], [])


def brute(rows):
    """Rows of (doc_id, text), and the counts of all pairs."""
    linked, found, counts = [], [], Counter()
    for left, right in tokens([t for _, t in rows]):
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        own, j = [], 0
        for start, end, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                own.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        texts = []
        for side in spans:
            parts, k = [[]], 0
            for _, e, i in side:
                parts[-1].append(str(i))
                if k < len(ends) and e == ends[k]:
                    parts.append([])
                    k += 1
            texts.append([",".join(p) for p in parts[:-1]])
        groups = ";".join(f"{x}|{y}" for x, y in zip(*texts, strict=True))
        digest = hashlib.sha256(groups.encode()).hexdigest() if ends else ""
        linked.append(own)
        counts.update(own)
        found.append((len(left), len(right), len(ends), len(own), digest))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (doc_id, _), own, row in zip(rows, linked, found):
        best = sum(counts[p] == highest[p[1]] for p in own)
        out.append((doc_id, *row[:4], best, sum(counts[p] for p in own), row[4]))
    return out, counts


def compare(spark, rows):
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    expected, counts = brute(rows)
    found = [tuple(r) for r in alignments(docs, *FILES).collect()]
    assert len(found) == len(expected)
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {(r.a, r.b): r["count"] for r in linked_pairs(docs, *FILES).collect()} == counts


ODD = [
    (1, "one two three"),
    (2, ""),
    (3, None),
    (4, "<|endoftext|> <s> <0x41> </s> <unk>"),
    (5, "a▁b: another mark"),
    (6, "ünï cödé 日本語 😀 words \x00 \x07"),
    (7, "  two  spaces \n\t and   more   "),
    (8, " "),
    (9, "supercalifragilistic antidisestablishmentarianism"),
    (10, "the the the the same same same"),
    (10, "the the the the same same same"),
    (None, "no id"),
    (11, LONG),
]


def test_odd_texts(spark):
    compare(spark, ODD)


def test_small_chunks(spark, monkeypatch):
    """A few bytes a chunk: documents of one chunk hold pairs of another."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    compare(spark, ODD[:-1] + [(20 + i, f"the same words {i} again and again") for i in range(40)])


def test_given_documents(spark):
    compare(spark, [tuple(r) for r in spark.read.parquet(DATA).select("doc_id", "text").collect()])


def test_empty_table(spark):
    found = alignments(documents(spark, []), *FILES)
    assert found.collect() == []
    assert found.dtypes == [(n, "bigint") for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [
        ("groups_sha256", "string")
    ]
