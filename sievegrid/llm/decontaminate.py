"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by at most k = m * ``percent`` / 100
edits (rounded down).  Cut into k + 1 pieces, at least one piece is in the passage unchanged:
an automaton over all pieces finds every exact hit.  Each hit is verified with Myers'
bit-parallel distance, from the inside out: of k + 1 pieces with at most k errors some path
of ever larger runs of pieces has fewer errors than pieces at every step, so a chance hit
ends after a few characters and no passage is lost.

Texts and items are compared in lower case with white space folded to one blank, by one rule
at every length: an item shorter than a budget of one needs is found wherever it stands.
``whole_words`` (off by default) keeps passages that stand between non-word characters only.
Myers' distance run backwards from a passage's end gives its start.  Null and empty items match
nothing; null and empty texts hold nothing; repeated items are matched each under its own
id; a null document id is carried through; texts are searched whole; empty tables give empty
results; other columns are never read.

The benchmark is broadcast in blocks, filled item by item up to ``BLOCK_CHARS`` characters (an
item above that is a block of its own); a larger one makes more passes over the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import lean

PERCENT = 10
BLOCK_CHARS = 4_000_000


def fold(text: str) -> str:
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, budget: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the pattern and any part of ``text``, and where that part ends.

    Above the budget the distance given is budget + 1.  ``anchored``: parts from the text's
    start only.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, budget + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | anchored
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Item:
    """A test item, its pieces, and the runs of pieces above each."""

    def __init__(self, item_id: int, text: str, percent: int = PERCENT, whole_words: bool = False):
        self.id, self.text, self.whole_words = item_id, fold(text), whole_words
        self.budget = min(len(self.text) * percent // 100, max(0, len(self.text) - 1))
        n = self.budget + 1
        self.cuts = [len(self.text) * i // n for i in range(n + 1)]
        self._masks: dict[tuple[int, int, int], dict[str, int]] = {}

    def runs(self, piece: int) -> list[tuple[int, int]]:
        """Ever larger runs of pieces that hold this one, up to the whole item."""
        low, high, path = 0, self.budget + 1, []
        while high - low > 1:
            path.append((low, high))
            mid = (low + high) // 2
            low, high = (low, mid) if piece < mid else (mid, high)
        return path[::-1]

    def verify(self, doc: str, piece: int, start: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of a passage around an exact hit of a piece at ``start``."""
        found = (0, start, start + len(self.text)) if not self.budget else None
        for low, high in self.runs(piece):
            budget = high - low - 1
            a, b = self.cuts[low], self.cuts[high]
            begin = max(0, start - (self.cuts[piece] - a) - budget)
            window = doc[begin : start + (b - self.cuts[piece]) + budget]
            distance, end = myers(self._of(a, b, 1), b - a, window, budget)
            if distance > budget:
                return None
            found = distance, begin, begin + end
        distance, _, end = found
        if distance:  # backwards from the end, to where the passage starts
            m = len(self.text)
            _, size = myers(self._of(0, m, -1), m, doc[max(0, end - m - distance) : end][::-1], distance, anchored=True)
            found = distance, end - size, end
        else:
            found = 0, end - len(self.text), end
        if self.whole_words and (found[1] and doc[found[1] - 1].isalnum() or end < len(doc) and doc[end].isalnum()):
            return None
        return found

    def _of(self, a: int, b: int, step: int) -> dict[str, int]:
        if (a, b, step) not in self._masks:
            self._masks[a, b, step] = masks(self.text[a:b][::step])
        return self._masks[a, b, step]


def matcher(items: list[tuple[int, str]], percent: int = PERCENT, whole_words: bool = False):
    """The automaton over all pieces; each has the (item, piece) it stands for."""
    import ahocorasick

    machine, own = ahocorasick.Automaton(), {}
    made = [x for x in (Item(i, t, percent, whole_words) for i, t in items) if x.text]
    for item in made:
        for p in range(item.budget + 1):
            own.setdefault(item.text[item.cuts[p] : item.cuts[p + 1]], []).append((item, p))
    for piece, users in own.items():
        machine.add_word(piece, (len(piece), users))
    machine.make_automaton()
    return machine


def search(machine, text: str, any_one: bool = False) -> dict[int, tuple[int, int, int]]:
    """The best passage for each item: least distance, then first start, and its end, in the folded text.

    With ``any_one`` the first passage found is enough.
    """
    doc, out, done = fold(text), {}, {}
    if not len(machine):
        return out
    for at, (size, users) in machine.iter(doc):
        start = at - size + 1
        for item, piece in users:
            # pieces of one passage lie on one diagonal, which is verified until it gives a passage
            diagonal = start - item.cuts[piece]
            seen = done.setdefault((item.id, item.text), set())
            if diagonal in seen or out.get(item.id, (1,))[0] == 0:
                continue
            found = item.verify(doc, piece, start)
            if found:
                seen.add(diagonal)
                if item.id not in out or found < out[item.id]:
                    out[item.id] = found
                if any_one:
                    return out
    return out


@functools.lru_cache(maxsize=2)
def _machine(items: tuple[tuple[int, str], ...], percent: int, whole_words: bool):
    return matcher(list(items), percent, whole_words)


def _tables(benchmark: DataFrame, block_chars: int, item_col: str, item_text_col: str) -> Iterator:
    """Broadcasts of the items, each of at most a block."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    block, size, made = [], 0, 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield spark.sparkContext.broadcast(tuple(block))
            block, size, made = [], 0, made + 1
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block or not made:
        yield spark.sparkContext.broadcast(tuple(block))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS, whole_words: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item's best passage in each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for table in _tables(benchmark, block_chars, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            machine = _machine(table.value, percent, whole_words)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if text.is_valid:
                        found += [(doc_id, i, *v) for i, v in sorted(search(machine, text.as_py()).items())]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "end"])

        hits = rows.mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS, whole_words: bool = False, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; no shuffle."""
    at = docs.columns.index(text_col)
    for table in _tables(benchmark, block_chars, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            machine = _machine(table.value, percent, whole_words)
            for batch in batches:
                yield batch.filter(pa.array([not (x.is_valid and search(machine, x.as_py(), True)) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
