"""Quality rules as a short-circuit cascade.

A sample tells what each rule costs and which texts it rejects; rules then run in the
order of rejection per cost among what the rules before them let through, and a text
meets no further rule once one rejects it. The order changes the work only: a text is
kept exactly if no rule rejects it. Features are computed when the first rule asks for
them, and only for the texts that are still in. ``score`` reports some features of every
text; those of the rules in OWN are never computed for a text that is already out.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice

#: Rows of the sample that orders the rules; it decides no text's verdict.
SAMPLE_ROWS = 2000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTHS = (2, 20)
MAX_DIGIT_PERCENT = 30
MAX_BARE_WORD_PERCENT = 30
LONGEST_WORD = 1000
_CLASSES = bytes(32 if c in b" \t\n\x0b\x0c\r" else 97 if c >= 128 or chr(c).isalpha() else 46 for c in range(256))
_BARE = re.compile(rb"(?<![^ ])\.+(?![^ ])")


def word_features(data: bytes, text: str) -> tuple[int, int]:
    """Words, and code points in them."""
    return len(data.split()), len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))


def symbol_feature(data: bytes) -> int:
    return len(data) - len(data.translate(None, b"#*$%&|<>"))


def line_features(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def repeat_feature(data: bytes) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    words = data.split()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(windows)] |= hit
    return int(cover.sum())


def bare_feature(data: bytes) -> int:
    """Words without an ASCII letter or a character beyond ASCII."""
    return len(_BARE.findall(data.translate(_CLASSES)))


def longest_feature(data: bytes) -> int:
    """Code points of the longest word, exact where it may exceed LONGEST_WORD."""
    words = data.split()
    most = max(map(len, words), default=0)
    return most if most <= LONGEST_WORD else max(len(w.decode()) for w in words)


class Features:
    """A slice's features, each computed once for the rows that are asked for."""

    def __init__(self, texts: list[str]):
        self.texts, self.data = texts, [t.encode() for t in texts]
        self.held: dict[str, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        width, compute = FEATURES[name]
        if name not in self.held:
            self.held[name] = np.zeros((len(self.texts), width), np.int64)
            self.known[name] = np.zeros(len(self.texts), bool)
        held, known = self.held[name], self.known[name]
        for i in rows[~known[rows]]:
            held[i] = compute(self.data[i], self.texts[i])
        known[rows] = True
        return held[rows]


FEATURES: dict[str, tuple[int, Callable]] = {
    "words": (2, word_features),
    "symbols": (1, lambda data, text: symbol_feature(data)),
    "lines": (2, lambda data, text: line_features(data)),
    "repeats": (1, lambda data, text: repeat_feature(data)),
    "digits": (1, lambda data, text: len(data) - len(data.translate(None, b"0123456789"))),
    "bare": (1, lambda data, text: bare_feature(data)),
    "longest": (1, lambda data, text: longest_feature(data)),
}
#: Those that ``score`` reports.
REPORTED = ("words", "symbols", "lines", "repeats")


def _few_words(f: Features, rows):
    return f.get("words", rows)[:, 0] < MIN_WORDS


def _word_length(f: Features, rows):
    n, chars = f.get("words", rows).T
    return (chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * n)


def _symbols(f: Features, rows):
    return 100 * f.get("symbols", rows)[:, 0] > MAX_SYMBOL_PERCENT * f.get("words", rows)[:, 0]


def _dup_lines(f: Features, rows):
    n, dup = f.get("lines", rows).T
    return 100 * dup > MAX_DUP_LINE_PERCENT * n


def _repeats(f: Features, rows):
    return 100 * f.get("repeats", rows)[:, 0] > MAX_REPEAT_PERCENT * f.get("words", rows)[:, 0]


def _digits(f: Features, rows):
    return 100 * f.get("digits", rows)[:, 0] > MAX_DIGIT_PERCENT * f.get("words", rows)[:, 1]


def _bare_words(f: Features, rows):
    return 100 * f.get("bare", rows)[:, 0] > MAX_BARE_WORD_PERCENT * f.get("words", rows)[:, 0]


def _long_word(f: Features, rows):
    return f.get("longest", rows)[:, 0] > LONGEST_WORD


#: name -> rows that it rejects. The first two are the base rules.
RULES: dict[str, Callable] = {
    "few_words": _few_words,
    "repeats": _repeats,
    "word_length": _word_length,
    "symbols": _symbols,
    "dup_lines": _dup_lines,
    "digits": _digits,
    "bare_words": _bare_words,
    "long_word": _long_word,
}
BASE = ("few_words", "repeats")
#: Rules whose features are computed for survivors alone.
OWN = ("digits", "bare_words", "long_word")


def cascade(f: Features, order: list[str]) -> np.ndarray:
    """True for rows that no rule rejects."""
    left = np.arange(len(f.texts))
    for name in order:
        if not len(left):
            break
        left = left[~RULES[name](f, left)]
    kept = np.zeros(len(f.texts), bool)
    kept[left] = True
    return kept


def plan(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' order, from costs and rejections on a sample of about sample_rows."""
    total = df.count()

    def measure(batches):
        for _, texts in each_slice(batches):
            masks, cost, rows = np.zeros(len(texts), np.int64), [], np.arange(len(texts))
            for k, name in enumerate(RULES):
                f = Features(texts)  # each rule pays for its own features
                began = time.perf_counter()
                masks |= RULES[name](f, rows).astype(np.int64) << k
                cost.append(time.perf_counter() - began)
            found = Counter(masks.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values())), pa.array([cost] + [[0.0] * len(cost)] * (len(found) - 1))], ["mask", "n", "cost"])

    part = df.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, sample_rows / max(total, 1)), seed=7)
    seen = part.mapInArrow(measure, "mask long, n long, cost array<double>")
    got = seen.groupBy("mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("cost")[k]).alias(f"c{k}") for k in range(len(RULES))]).collect()
    names = list(RULES)
    cost = {name: sum(r[f"c{k}"] for r in got) + 1e-9 for k, name in enumerate(names)}
    left, order = {r["mask"]: r["n"] for r in got}, []
    while len(order) < len(names):
        gain = {n: sum(c for m, c in left.items() if m >> names.index(n) & 1) / cost[n] for n in names if n not in order}
        best = max(gain, key=lambda n: (gain[n], -cost[n]))
        order.append(best)
        left = {m: c for m, c in left.items() if not m >> names.index(best) & 1}
    return order


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Null and empty texts have no words and fail; repeated rows get the
    same each, and an empty table none. A text of any length is read whole. Shares equal to
    a limit pass."""
    order = order or plan(df, text_col)

    def run(batches):
        for batch, texts in each_slice(batches):
            f, rows = Features(texts), np.arange(len(texts))
            words, symbols, lines, repeats = (f.get(n, rows) for n in REPORTED)
            failed = np.zeros(len(texts), bool)
            for name in BASE:
                failed |= RULES[name](f, rows)
            cols = [words[:, 0], words[:, 1], symbols[:, 0], lines[:, 1], repeats[:, 0], failed, cascade(f, order)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], [batch.schema.names[0], *OUT])

    kind = df.select(F.col(f"`{id_col}`").alias(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in OUT))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(df: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of df that no rule rejects, with all their columns; null and empty texts
    go, repeated rows stay or go together."""
    order = order or plan(df, text_col)

    def run(batches):
        for batch, texts in each_slice(batches, text_col):
            yield batch.filter(pa.array(cascade(Features(texts), order)))

    return df.mapInArrow(run, df.schema)
