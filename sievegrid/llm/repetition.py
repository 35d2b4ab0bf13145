"""Quality rules with suffix-array repetition.

Base counts come from one pass over each whole text.  For the method, the words of a text
form a suffix array (by prefix doubling); its longest-common-prefix values mark every maximal
substring of at least ``min_words`` words that the text repeats, the union of their spans
gives the covered fraction, and a text fails where that fraction or the longest repeat is
over its limit.  A text in which no run of ``min_words`` words repeats skips the array: it
has no such interval.

Null and empty texts have zero counts and fail the base rules; null and repeated ids are
carried through; a very long text is one block of its own; empty tables give empty results;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_REPEAT = 10
MAX_COVERED_PERCENT = 20
MAX_LONGEST = 80

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _row_of(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hash made different for each row."""
    return K.mix(h ^ K.mix(row.astype(np.uint64) + K.U64(1)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = flag[order[:-1][same]] = True
    return flag


def spans_covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + lengths, 1)
    return np.cumsum(edge[:-1]) > 0


def longest_repeats(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest run from it that occurs elsewhere in its row.

    Suffix array of all rows together: ranks start with the row's number, so suffixes of
    different rows never share a prefix.
    """
    n = len(words)
    row = _row_of(rows, np.arange(n))
    end = rows[1:][row]
    _, word = np.unique(words, return_inverse=True)
    rank = np.unique(row.astype(np.int64) * (int(word.max()) + 1) + word, return_inverse=True)[1]
    levels, k = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while True:
        nxt = np.zeros(n, np.int64)
        ok = np.arange(n) + k < end
        nxt[ok] = levels[-1][np.flatnonzero(ok) + k].astype(np.int64) + 1
        key = levels[-1].astype(np.int64) * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int32)
        new[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        levels.append(new)
        k *= 2
        if int(new.max()) == n - 1:
            break
    a, b = order[:-1].copy(), order[1:].copy()  # neighbours in the suffix array
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        size = 1 << level
        ok = (a + size <= end[order[:-1]]) & (b + size <= end[order[1:]])
        at = np.flatnonzero(ok)
        at = at[levels[level][a[at]] == levels[level][b[at]]]
        a[at] += size
        b[at] += size
        lcp[at] += size
    out = np.zeros(n, np.int64)
    out[order[1:]] = lcp
    out[order[:-1]] = np.maximum(out[order[:-1]], lcp)
    return out


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of every row of a block of texts."""
    n = len(offsets) - 1
    h, _, _, rows = K.hash_words(data, offsets)
    n_words = np.diff(rows)
    word_byte = ~K.SEPARATOR[data]
    out = {"n_words": n_words, "word_chars": _per_row(word_byte & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_SYMBOL[data], offsets)}
    # lines with a word
    starts, ends, lines = K.word_spans(data, offsets, data == 10)
    if len(starts):
        seen = np.concatenate([[0], np.cumsum(word_byte)])
        ok = seen[ends] > seen[starts]
        line_row = np.repeat(np.arange(n), np.diff(lines))[ok]
        keys = _keyed(K.hash_spans(data, starts, ends)[ok], line_row)
        _, first = np.unique(keys, return_index=True)
        out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    at = K.inside(rows, 3)
    twice = at[repeated(_keyed(K.grams(h, 3)[at], _row_of(rows, at)))]
    covered = np.zeros(len(h) + 1, bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = _per_row(covered[:-1], rows)
    # repeats of at least min_repeat words: only rows with a repeated run of that length
    out["covered_words"], out["longest_repeat"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(twice):
        at = at[np.isin(_row_of(rows, at), np.unique(_row_of(rows, twice)))]
        at = np.intersect1d(at, K.inside(rows, min_repeat), assume_unique=True)
        again = at[repeated(_keyed(K.grams(h, min_repeat)[at], _row_of(rows, at)))]
        chosen = np.unique(_row_of(rows, again))
        if len(chosen):
            sizes = n_words[chosen]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            words = np.concatenate([h[rows[r] : rows[r + 1]] for r in chosen.tolist()])
            longest = longest_repeats(words, bounds)
            keep = np.flatnonzero(longest >= min_repeat)
            out["covered_words"][chosen] = _per_row(spans_covered(len(words), keep, longest[keep]), bounds)
            out["longest_repeat"][chosen] = np.maximum.reduceat(longest, bounds[:-1])
    return out


def rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts, ``base_failed`` and ``kept``."""
    counts = COLUMNS[1:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for low, high in K.doc_blocks(offsets):
                off = offsets[low : high + 1]
                found = measure(data[off[0] : off[-1]], off - off[0], min_repeat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(found[c].astype(np.int64)) for c in counts)], names=["doc_id", *counts])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in counts))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (100 * F.col("covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
