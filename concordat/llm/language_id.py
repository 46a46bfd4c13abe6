"""Operator 4: language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its n-grams; the filters are bit-sliced, so that a slot of the table holds one
bit for each language, in as many words of ``WORD_LANGS`` bits as there are languages for, and the AND of an n-gram's
slots is the bitmask of all languages that may contain it. A text's
hits per language are the popcounts of that bit over its n-grams, corrected for the filter's share of false positives;
the language with the most evidence wins. An n-gram weighs by the number of languages that have it, rarer ones more.

Learning counts n-grams (three and four characters of lower-cased words with their borders, and short words whole)
over all training documents with a shuffled sum per (language, n-gram); an n-gram enters a language's filter if it
makes up at least ``min_share`` of that language's n-grams, so a filter has at most 1 / min_share entries whatever the
corpus' size, and the table (``slots`` words for each ``WORD_LANGS`` languages) is broadcast.

Edge cases: a null text or one without a letter gets ``und`` and 0.0; a text none of whose n-grams is known gets the
first learned language with score 1 / languages; no training rows: ``und`` for all; rows with null lang teach nothing;
extra columns are ignored. All languages of the training rows are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import chunks, mix, texts_of

SLOTS, MIN_SHARE, SIZES = 1 << 18, 2e-5, (3, 4)
WORD_LANGS = 63

_BREAK = np.ones(256, bool)  # ASCII characters that are not letters
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram of every text; non-letters of ASCII count as blanks, A-Z and À-Þ as lower case."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    a = np.where(_BREAK[raw], 32, raw)
    upper = (a >= 65) & (a <= 90)
    a = np.where(upper, a + 32, a).astype(np.uint8)
    latin = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)) + 1
    a[latin] += 32
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lens + 1)
    lead = np.flatnonzero((a < 128) | (a >= 192))
    # runs of blanks count once
    keep = np.concatenate(([True], ~((a[lead][1:] == 32) & (a[lead][:-1] == 32)))) if len(lead) else np.zeros(0, bool)
    lead = lead[keep]
    width = np.diff(np.concatenate((lead, [len(a)])))
    code = a[lead].astype(np.uint64)
    for j in (1, 2, 3):  # up to four bytes a character
        more = (width > j) & (a[np.minimum(lead + j, len(a) - 1)] >= 128)
        code = np.where(more, (code << np.uint64(8)) | a[np.minimum(lead + j, len(a) - 1)], code)
    d, docs, out = doc[lead], [], []
    space = code == 32
    for n in SIZES:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : j + m]
            if 0 < j < n - 1:
                inner |= space[j : j + m]
        ok = (d[:m] == d[n - 1 :]) & (~inner if n < 4 else ~(space[1 : 1 + m] & space[2 : 2 + m]))
        docs.append(d[:m][ok])
        out.append(mix(h[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


@dataclass
class LanguageFilters:
    """``table[w][slot]``: bit l of word w is set if an n-gram of language w * WORD_LANGS + l falls there; ``false_rate[l]``: share of chance hits."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        n = np.uint64(self.table.shape[1] - 1)
        one, two = (h & n).astype(np.int64), ((h >> np.uint64(32)) & n).astype(np.int64)
        return [word[one] & word[two] for word in self.table]

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text and language: hits, corrected for false positives, as a share of the evidence for all languages."""
        doc, h = grams(texts)
        masks = self.masks(h)
        count = sum(np.bitwise_count(m).astype(float) for m in masks)
        weight = np.where(count > 0, np.maximum(len(self.langs) - count, 0.02), 0.0)
        total = np.bincount(doc, weight, len(texts))
        bit = lambda i: (masks[i // WORD_LANGS] >> np.uint64(i % WORD_LANGS)) & np.uint64(1)
        hits = np.stack([np.bincount(doc, bit(i) * weight, len(texts)) for i in range(len(self.langs))], 1)
        clean = np.maximum(hits - total[:, None] * self.false_rate, 0) / (1 - self.false_rate)
        power = (clean / np.maximum(total, 1e-9)[:, None]) ** 3
        s = power.sum(1, keepdims=True)
        return np.where(s > 0, power / np.where(s > 0, s, 1), 1 / len(self.langs))


def learn(documents: DataFrame, slots: int = SLOTS, min_share: float = MIN_SHARE) -> LanguageFilters:
    """Build the filters from all rows of (lang, text) with a lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            code = {x: i for i, x in enumerate(names)}
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for part, texts in chunks(langs, texts_of(b)):
                doc, h = grams(texts)
                of = np.fromiter((code[x] for x in part), np.int64, len(part))[doc]
                for i in np.unique(of):
                    v, n = np.unique(h[of == i], return_counts=True)
                    if i in held:
                        v, where = np.unique(np.concatenate((held[i][0], v)), return_inverse=True)
                        n = np.bincount(where, np.concatenate((held[i][1], n))).astype(np.int64)
                    held[i] = v, n
            for i, (v, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(v)), pa.array(v.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
        langs = [x for x, _ in totals]
        table, false_rate = np.zeros((max(1, -(-len(langs) // WORD_LANGS)), slots), np.uint64), np.zeros(len(langs))
        if langs:
            least = documents.sparkSession.createDataFrame([(x, n * min_share, i // WORD_LANGS, 1 << i % WORD_LANGS) for i, (x, n) in enumerate(totals)], "lang string, least double, word int, bit bigint")
            kept = counts.join(F.broadcast(least), "lang").where("n >= least")
            last = F.lit(slots - 1)
            at = F.array(F.col("gram").bitwiseAND(last), F.shiftrightunsigned("gram", 32).bitwiseAND(last))
            # at most one row for each word of the table reaches the driver
            for x in kept.select("word", F.explode(at).alias("at"), "bit").groupBy("word", "at").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
                table[x.column("word").to_numpy(), x.column("at").to_numpy()] = x.column("bits").to_numpy().view(np.uint64)
            false_rate = np.array([((table[i // WORD_LANGS] >> np.uint64(i % WORD_LANGS)) & np.uint64(1)).mean() ** 2 for i in range(len(langs))])
    finally:
        counts.unpersist()
    return LanguageFilters(langs, table, false_rate)


def identify(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            pred, score = [], []
            texts = texts_of(b)
            for _, part in chunks(texts, texts):
                e = known.evidence(part) if known.langs else None
                for i, t in enumerate(part):
                    sure = e is not None and has_letter(t)
                    pred.append(known.langs[int(e[i].argmax())] if sure else "und")
                    score.append(float(e[i].max()) if sure else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    filters = learn(documents.where(~held_out).select("lang", "text"))
    return identify(documents, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
