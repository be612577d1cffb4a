"""Token counts of a unigram tokenizer, without building its tokens.

Count-only Viterbi: an Aho-Corasick automaton enumerates every vocabulary piece in a word;
dynamic programming over its characters keeps, per position, the best score and the number
of pieces on the best path. Of equal scores the piece that starts first wins, as in the
library's own search, which tries starts in ascending order and replaces only what is worse.
A character that no single-character piece covers may be left unknown at the lowest score
less 10; it counts one piece per byte of its UTF-8 where the vocabulary has byte pieces, and
else one piece per run of such characters.

A space becomes the marker that begins the next word, so no piece reaches over the end of a
word: words are searched one by one, each once per task as long as it is remembered. Sums of
whole-number scores are exact, hence the ties are.

Defined results: null and empty texts have no tokens and score 0; the table's rows come back
one by one, repeated or not; a word of any length is one search with memory in its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000  # words whose counts a task keeps
LONGEST_REMEMBERED = 64  # characters


@dataclass
class Vocabulary:
    scores: dict[str, float]  # of the pieces that text can match
    has_bytes: bool
    unknown: float  # score of an unknown character


def vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a SentencePiece model, read as a unigram vocabulary.

    Control, unknown and byte pieces never match text. The lowest score is that of all
    entries, as the search takes it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if i not in special}
    lowest = min(model.get_score(i) for i in ids)
    return Vocabulary(scores, sum(model.is_byte(i) for i in ids) == 256, lowest - UNKNOWN_PENALTY)


class Counter:
    """Counts pieces word by word."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece in vocabulary.scores if len(piece) == 1}
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through one word."""
        if not self.single.issuperset(word):
            return self._word_with_unknown(word)
        best, pieces = [-math.inf] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for last, (length, score) in self.automaton.iter(word):  # of one end, the longest first
            start = last + 1 - length
            total = best[start] + score
            if total > best[last + 1]:
                best[last + 1] = total
                pieces[last + 1] = pieces[start] + 1
        return pieces[-1], best[-1]

    def _word_with_unknown(self, word: str) -> tuple[int, float]:
        v = self.vocabulary
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        run = [False] * (n + 1)  # the best path ends in an unknown character
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if v.scores:
            for last, found in self.automaton.iter(word):
                matches[last + 1].append(found)
        for end in range(1, n + 1):
            top, start, unknown, single = None, 0, False, False
            for length, score in sorted(matches[end], reverse=True):  # the first start first
                single = single or length == 1
                total = best[end - length] + score
                if top is None or total > top:
                    top, start = total, end - length
            if not single:
                total = best[end - 1] + v.unknown
                if top is None or total > top:
                    top, start, unknown = total, end - 1, True
            best[end] = top
            if not unknown:
                pieces[end] = pieces[start] + 1
            elif v.has_bytes:
                pieces[end] = pieces[start] + len(word[start].encode("utf-8", "surrogatepass"))
            else:
                pieces[end] = pieces[start] + (not run[start])
            run[end] = unknown
        return pieces[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; a marker goes in front unless it begins with one."""
        if not text:
            return 0, 0.0
        count, score, known = 0, 0.0, self.known
        for part in text.replace(MARK, " ").removeprefix(" ").split(" "):
            found = known.get(part)
            if found is None:
                found = self.word(MARK + part)
                if len(part) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found
            count += found[0]
            score += found[1]
        return count, score


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``score`` (of the best path)."""
    # Plain values: executors need not have this package.
    plain = (vocabulary.scores, vocabulary.has_bytes, vocabulary.unknown)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(*shared.value))
        for batch in batches:
            found = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_tokens long, score double")
