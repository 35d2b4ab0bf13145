"""Periodic runs of words, found with a suffix automaton.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at
least ``min_length`` words and ``min_exponent`` periods long, that no neighbouring word
extends.  A text is dealt with in two steps:

- Every word of a run lies in a window of a few words that comes again within the run, so
  only stretches of windows whose like is near (nearer than the stretch allows) go on.  The
  windows are compared by 64-bit hashes, which may let too much through, never too little.
- The suffix automaton of a stretch gives, for each state, the end positions of its strings.
  Sets of ends move up the suffix links, the smaller into the larger, and stay ordered.  Two
  ends that become neighbours at a state are the ends of its longest string, at distance d: where
  d doesn't exceed the state's length they seed a square, and the state's length tells how far
  the period reaches to the left.  A seed whose period goes on to the right stands in a run that
  has another seed at its right end; that one gives the run.  With ``min_exponent`` of 3 or
  more, every run has such a seed among neighbours.

Words are compared exactly, as bytes.  A worker holds the automaton of one stretch at a time,
some 300 bytes a word of it.  Null and empty texts have no runs and no words; null and
repeated ids are carried through, a row each; very long texts are whole; empty tables give
empty results; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MERGE = 64


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of the suffix automaton: length and suffix link of each state, and the state of each prefix."""
    # most states have one transition; the others keep the rest in a dictionary
    length, link, symbol, target, more, prefixes = [0], [-1], [-1], [0], [None], []
    last = 0
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        symbol.append(-1)
        target.append(0)
        more.append(None)
        p = last
        while p >= 0:
            if symbol[p] < 0:
                symbol[p], target[p] = c, new
            elif symbol[p] == c or more[p] is not None and c in more[p]:
                break
            elif more[p] is None:
                more[p] = {c: new}
            else:
                more[p][c] = new
            p = link[p]
        if p >= 0:
            q = target[p] if symbol[p] == c else more[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                symbol.append(symbol[q])
                target.append(target[q])
                more.append(dict(more[q]) if more[q] is not None else None)
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    elif more[p] is None or more[p].get(c) != q:
                        break
                    else:
                        more[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        prefixes.append(new)
        last = new
    return length, link, prefixes


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    length, link, prefixes = automaton(words)
    # below this length no state can seed a run
    least = min(max((min_exponent - 1) * d, min_length - d) for d in range(1, min_length + 1))
    # ends are held negated: in periodic text the set that moves up has the later ends
    ends: list[list[int] | None] = [None] * len(length)
    for i, state in enumerate(prefixes):
        ends[state] = [-i]
    found: dict[tuple[int, int], int] = {}

    def seed(size: int, left: int, right: int) -> None:
        d = right - left
        if (min_exponent - 1) * d > size or d + size < min_length:
            return
        start = left - size + 1
        if (start == 0 or words[start - 1] != words[start - 1 + d]) and (right == n - 1 or words[right + 1] != words[left + 1]):
            found[start, right] = min(d, found.get((start, right), d))  # a multiple of the period gives the same run

    for v in sorted((v for v in range(1, len(length)) if length[v] > least), key=length.__getitem__, reverse=True):
        up, small = link[v], ends[v]
        ends[v] = None
        size = length[up]
        if size < least:
            continue
        large = ends[up]
        if large is None:
            ends[up] = small
            continue
        if len(large) < len(small):
            large, small = small, large
        ends[up] = large
        if len(small) > _MERGE:  # two ordered lists merge in one pass
            large += small
            large.sort()
            for x in small:
                i = bisect_left(large, x)
                if i:
                    seed(size, -x, -large[i - 1])
                if i + 1 < len(large):
                    seed(size, -large[i + 1], -x)
            continue
        for x in small:
            i = bisect_left(large, x)
            if i:
                seed(size, -x, -large[i - 1])
            if i < len(large):
                seed(size, -large[i], -x)
            large.insert(i, x)
    return sorted((start, right - start + 1, d) for (start, right), d in found.items())


def window(min_length: int, min_exponent: int) -> int:
    """The most words for which every window of a run comes again in it, and the windows cover it."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(data: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, words) of the parts of a block's texts that may hold runs."""
    size = window(min_length, min_exponent)
    hashes, _, _, rows = K.hash_words(data, offsets)
    at = K.inside(rows, size)
    if len(at) < 2:
        return (np.zeros(0, np.int64),) * 3
    row = np.searchsorted(rows, at, "right") - 1
    keys = K.mix(K.grams(hashes, size)[at] ^ K.mix(row.astype(np.uint64) + K.U64(1)))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    gap = at[order[same + 1]] - at[order[same]]
    far = np.int64(1) << 62
    near = np.full(len(at), far)
    near[order[same]] = gap
    near[order[same + 1]] = np.minimum(near[order[same + 1]], gap)
    spot = np.flatnonzero(near <= (rows[row + 1] - rows[row]) // min_exponent)
    if not len(spot):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, np.diff(at[spot]) != 1))
    low, high = at[spot[first]], at[spot[np.append(first[1:], len(spot)) - 1]] + size
    fits = (high - low >= min_length) & (np.minimum.reduceat(near[spot], first) * min_exponent <= high - low)
    row = row[spot[first]][fits]
    return row, low[fits] - rows[row], (high - low)[fits]


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept_text) of every row.

    ``kept_text`` lacks each word that stands in a run after its first period; its words are
    joined by single spaces.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent has to be 3 or more")

    def row_runs(words: list[bytes], parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for low, size in parts:
            codes: dict[bytes, int] = {}
            inner = [codes.setdefault(w, len(codes)) for w in words[low : low + size]]
            out += [(low + start, length, period) for start, length, period in runs_of(inner, min_length, min_exponent)]
        return out

    def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for low, high in K.doc_blocks(offsets):
                own = offsets[low : high + 1]
                parts: dict[int, list[tuple[int, int]]] = {}
                for row, first, size in zip(*(x.tolist() for x in stretches(data[own[0] : own[-1]], own - own[0], min_length, min_exponent)), strict=True):
                    parts.setdefault(row, []).append((first, size))
                n_words, all_runs, texts = [], [], []
                for i in range(high - low):
                    words = data[own[i] : own[i + 1]].tobytes().split()
                    runs = row_runs(words, parts[i]) if i in parts else []
                    n_words.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    texts.append(b" ".join(kept(words, runs) if runs else words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n_words, pa.int64()), pa.array(all_runs, _TYPE), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, kept_text string")


def highest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of several; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_periodic_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where about a tenth of the texts end in a repeated phrase, by the id's checksum.

    Let h be the checksum of the decimal id and g = h div 10: where h ends in 0 and the text has n > 0 words,
    the words from a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    text = F.col(text_col).cast("string")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
