"""Operator 1: token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic programming carries
only the best score and the number of pieces up to there, so no segmentation is built. Ties follow the tokenizer's
rule: of equally good paths to a position the one with the longest last piece stays, because a later (shorter) piece
must score strictly more. A character without a one-character piece costs the least score minus ten; it counts as its
UTF-8 bytes where the vocabulary has byte pieces, and otherwise a run of such characters counts one.

No piece of the usual vocabularies has the word mark after another character, so a text falls into words that can be
solved alone (scores are added in double precision, integers exactly); each task keeps the counts of words it has
seen. A vocabulary with longer pieces is solved over the whole text.

Edge cases: null and empty texts have 0 tokens; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK, UNKNOWN_PENALTY, KEPT_WORDS = "▁", 10.0, 300_000
VOCABULARY = "piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; a few ten thousand, small enough to broadcast."""

    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Pieces and scores of a sentencepiece model file (control, unknown, unused and byte pieces left out)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        return cls(tuple((sp.id_to_piece(i), float(sp.get_score(i))) for i in ids), any(sp.is_byte(i) for i in range(len(sp))))


class Counter:
    """Counts the pieces of texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.bytes = vocabulary.byte_pieces
        crossing = any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.word = None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.seen: dict[str, int] = {}

    def solve(self, s: str) -> int:
        n = len(s)
        best: list[float | None] = [0.0] + [None] * n
        count, loose = [0] * (n + 1), [False] * (n + 1)
        done = 0

        def close(upto: int) -> None:
            # a position is final once all pieces that end there are seen; unknown characters come last, as the shortest
            nonlocal done
            while done < upto:
                done += 1
                c = s[done - 1]
                if c not in self.single:
                    score = best[done - 1] + self.unknown
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        count[done] = count[done - 1] + (len(c.encode()) if self.bytes else not loose[done - 1])
                        loose[done] = True

        for end, (size, score) in self.automaton.iter(s):
            end += 1
            if end - 1 > done:
                close(end - 1)
            start = end - size
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end], loose[end] = score, count[start] + 1, False
        close(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        if self.word is None:
            return self.solve(s)
        total, seen = 0, self.seen
        for w in self.word.findall(s):
            n = seen.get(w)
            if n is None:
                if len(seen) >= KEPT_WORDS:
                    seen.clear()
                n = self.solve(w)
                if len(w) <= 64:
                    seen[w] = n
            total += n
        return total


def token_counts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            n = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary_file: str = f"/opt/tokenizers/{VOCABULARY}") -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load(vocabulary_file))
