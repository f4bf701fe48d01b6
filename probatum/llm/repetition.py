"""Quality rules on repetition: how many characters lie inside repeated n-grams and lines."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from probatum.llm.shared import fresh

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"

#: most share of characters in the most frequent n-gram, by n, where it is found often enough to be one
TOP_GRAM, LEAST_TIMES = {2: 0.20, 3: 0.18, 4: 0.16}, 3
#: most share of characters that repeat an earlier n-gram, by n: half of what the base rule allows both copies together
REPEATED_GRAM = dict.fromkeys(range(5, 11), 0.15)
#: most share of characters in lines that repeat an earlier line
REPEATED_LINE_CHARS = 0.20
#: the base rules: fewest words; most words of 8-word windows found twice or more, in percent
LEAST_WORDS, WINDOW, WINDOW_PERCENT = 20, 8, 30

_KINDS = {LongType: pa.int64(), DoubleType: pa.float64(), BooleanType: pa.bool_()}
#: what is measured; the base rules and the verdict last
MEASURES = StructType([
    *[StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    *[StructField(n, DoubleType()) for n in ("top_gram_share", "repeated_gram_share", "repeated_line_share", "repeated_line_chars")],
    *[StructField(n, BooleanType()) for n in ("base_failed", "kept")]])
_FIELDS = [pa.field(f.name, _KINDS[type(f.dataType)]) for f in MEASURES]
_BASE = 0x9E3779B97F4A7C15


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Word numbers as 64 random-looking bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Windows:
    """Rolling 64-bit hashes of all word windows of a text, for any window length."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        up, self._down = _powers(1 << max(10, int(self.n + 1).bit_length()))
        self._sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(ids) * up[:self.n])))

    def hashes(self, length: int) -> np.ndarray:
        at = self._sums
        return (at[length:] - at[:-length]) * self._down[:self.n - length + 1]

    def commonest(self, length: int) -> tuple[np.ndarray, int]:
        """One start for each of the windows found most often, and how often that is."""
        h = self.hashes(length)
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        counts = np.diff(np.append(first, len(h)))
        return order[first[counts == counts.max()]], int(counts.max())

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray] | None:
        """For each window: whether it is found twice or more, and whether an earlier one equals it; None if none is."""
        h = self.hashes(length)
        in_order = np.sort(h)
        if not (in_order[1:] == in_order[:-1]).any():
            return None
        order = np.argsort(h, kind="stable")
        first_of = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        counts = np.diff(np.append(np.flatnonzero(first_of), len(h)))
        twice, later = np.empty(len(h), bool), np.empty(len(h), bool)
        twice[order], later[order] = np.repeat(counts > 1, counts), ~first_of
        return twice, later


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts`` (marks)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:len(starts)] += starts
    edge[length:length + len(starts)] -= starts[:n + 1 - length]
    return np.cumsum(edge[:n]) > 0


def measure(text: str) -> tuple:
    """The measures of one text, in the order of ``MEASURES``."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))

    seen: set[bytes] = set()
    n_lines = n_dup_lines = line_chars = 0
    for line in raw.split(b"\n"):
        if bare := line.strip():
            n_lines += 1
            if line in seen:
                n_dup_lines += 1
                line_chars += len(bare.decode())
            seen.add(line)

    lengths = np.array([len(w.decode()) for w in numbers], dtype=np.int64)[ids] if n else ids
    windows, ends = Windows(ids), np.concatenate(([0], np.cumsum(lengths)))
    n_repeat_words, top_share, repeated_share, over = 0, 0.0, 0.0, False
    for size, most in TOP_GRAM.items():
        if n >= size:
            starts, times = windows.commonest(size)
            if times < LEAST_TIMES:
                break
            share = times * int((ends[starts + size] - ends[starts]).max()) / word_chars
            top_share, over = max(top_share, share), over or share > most
    for size, most in REPEATED_GRAM.items():
        # where no window is found twice, no longer one is
        if n < size or (found := windows.repeated(size)) is None:
            break
        twice, later = found
        share = int(lengths[_covered(later, size, n)].sum()) / word_chars
        repeated_share, over = max(repeated_share, share), over or share > most
        if size == WINDOW:
            n_repeat_words = int(_covered(twice, size, n).sum())
    line_share = n_dup_lines / n_lines if n_lines else 0.0
    chars_share = line_chars / word_chars if word_chars else 0.0
    base_failed = n < LEAST_WORDS or 100 * n_repeat_words > WINDOW_PERCENT * n
    over |= chars_share > REPEATED_LINE_CHARS
    return (n, word_chars, n_symbols, n_dup_lines, n_repeat_words, top_share, repeated_share, line_share, chars_share,
            base_failed, not (base_failed or over))


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    rows = [measure(t or "") for t in texts.to_pylist()]
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], fields=_FIELDS)


def measured(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``name`` of the measures and the verdict ``kept``.

    Words stand between ASCII white space.  A null text counts as empty and has no words,
    so it fails the base rules.  No row is dropped; a table without rows stays one.
    """
    return docs.withColumn(name, measures(F.col(text)))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they were."""
    (name,) = fresh(docs, "quality")
    return measured(docs, text, name).where(F.col(f"{name}.kept")).select(*docs.columns)
