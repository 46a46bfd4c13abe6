"""Text statistics of whole documents, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import Chunk, chunks, repeated, texts_of

# byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 .?, 6 comma-like, 7 symbol, 8 !, 9 |, 10 other
# punctuation, 11 first byte of a non-ASCII character, 12 its other bytes
_CLASS = np.full(256, 10, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
for _chars, _k in ((b".?", 5), (b",;:'-", 6), (b"#*$%&<>", 7), (b"!", 8), (b"|", 9)):
    _CLASS[list(_chars)] = _k
_CLASS[192:256], _CLASS[128:192] = 11, 12
N_CLASS = 13

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_len", "upper", "digit", "symbol", "exclaim", "pipe", "sentence", "comma", "other", "non_ascii",
    "dup_lines", "repeat_words", "distinct_words", "line_words", "newline", "short_words", "long_words", "upper_words",
]


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whole-text counts (columns BASE) and ratios (columns FEATURES), one row per text; an empty text gives zeros."""
    c = Chunk(texts)
    n = c.n
    doc = np.repeat(np.arange(n), c.lens + 1)
    by = np.bincount(doc * N_CLASS + _CLASS[c.raw], minlength=n * N_CLASS).reshape(n, N_CLASS)
    by[:, 4] -= 1  # the byte put after each document
    words = np.diff(c.word_first)
    chars = by[:, [0, 1, 2, 5, 6, 7, 8, 9, 10, 11]].sum(1)
    line_doc, line, full = c.lines()
    earlier, _ = repeated(line_doc[full], line[full])
    dup = np.bincount(line_doc[full][earlier], minlength=n)
    n_lines = np.bincount(line_doc[full], minlength=n)
    word_doc, w = c.word_doc, c.words
    cover = np.zeros(len(w), bool)
    if len(w) >= 3:
        key = (w[:-2] * np.uint64(3) + w[1:-1]) * np.uint64(5) + w[2:]
        inside = np.flatnonzero(word_doc[:-2] == word_doc[2:])
        _, again = repeated(word_doc[inside], key[inside])
        at = inside[again]
        cover[at] = cover[at + 1] = cover[at + 2] = True
    repeat = np.bincount(word_doc[cover], minlength=n)
    earlier, _ = repeated(word_doc, w)
    distinct = words - np.bincount(word_doc[earlier], minlength=n)
    size = c.ends - c.starts
    first_upper = (c.raw[c.starts] >= 65) & (c.raw[c.starts] < 91)
    second = c.raw[np.minimum(c.starts + 1, len(c.raw) - 1)]
    shout = first_upper & (second >= 65) & (second < 91)
    per = lambda mask: np.bincount(word_doc[mask], minlength=n)
    base = np.stack([words, chars, by[:, 7] + by[:, 9], dup, repeat], 1).astype(np.int64)
    nw, nc, nl = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    # '&' is a symbol of its own here and in the base count
    f = [
        np.log1p(words), chars / nw, by[:, 1] / nc, by[:, 2] / nc, by[:, 7] / nc, by[:, 8] / nc, by[:, 9] / nc,
        by[:, 5] / nw, by[:, 6] / nw, by[:, 10] / nc, by[:, 11] / nc, dup / nl, repeat / nw, distinct / nw,
        words / nl, by[:, 4] / nw, per(size <= 2) / nw, per(size >= 14) / nw, per(shout) / nw,
    ]
    return base, np.stack(f, 1)


def measured(batch: pa.RecordBatch):
    """(counts, features) of all rows of a batch, worked through in chunks."""
    texts = texts_of(batch)
    parts = [measure(t) for _, t in chunks(texts, texts)]
    if not parts:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
