"""Substring dedup by seed and extend.

Seeds: winnowed anchors.  Of the nine 5-word runs in every 13-word window the one with the
least hash (the leftmost of equal ones) is the window's anchor, so equal windows have equal
anchors at the same place.  A first exchange joins documents on anchors and tells each
document which of its anchors another one holds too.

Extension: every occurrence of such an anchor brings the words to its left and right that its
windows reach (at most eight on either side) to a second exchange by anchor.  There the
matches are extended both ways, a word at a time, among all documents that hold the anchor:
the occurrences that agree on j words to the left and 8 - j to the right form a group for
each j, and all but those of the group's least document are repeats of it.  Neighbouring
anchors' windows overlap, so chained together they are the maximal repeats: runs of words in
which every window starts in an earlier document too, and the windows next to either end
don't.  No pair of documents is ever listed.

Skew: each batch sends an anchor with two of its documents at most, and of occurrences with
the same surroundings only the least document's, so what many copies share goes once a batch.
An anchor that still has over ``HOT`` entries is lengthened before it is joined: its
occurrences travel as whole windows, by keys of their own, which spreads what stands around it.

Keys are 64-bit hashes of word hashes; groups are told apart by two independent ones.

The removal rule, for each word: some window of ``LENGTH`` words over it also starts in a
document with a smaller id, both judged on the input.  Null and empty texts and texts with
fewer words lose nothing.  Rows with a null id are left as they are and count for nothing;
rows that share an id count as one document, so they don't remove each other's words.
Repeats inside one document stay.  Empty tables give empty results; long texts are whole;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import kernel as K
from .exchange import groups

LENGTH = 13
ANCHOR = 5
HOT = 1 << 20
_WIDTH = 5
_ENTRY, _SPAN = ["<u8", "id", "<u4", "<u2", "<u8"], ["id", "<u4", "<u4", "<u4"]
SEEDED, WINDOW = 0, 2  # kinds of entries: an anchor with its surroundings, a whole window


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each row's first word; and of every anchor its place, key and how far left of it its first and last window begin."""
    h, _, _, rows = K.hash_words(data, offsets)
    at = K.inside(rows, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return h, rows, none, np.zeros(0, K.U64), none, none
    small, reach = K.grams(h, anchor), len(h) - length + 1
    least, where = small[:reach].copy(), np.zeros(reach, np.int64)
    for k in range(1, length - anchor + 1):
        better = small[k : k + reach] < least
        np.minimum(least, small[k : k + reach], out=least)
        where[better] = k
    place = at + where[at]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    return h, rows, place, small[place], place - at[first], place - at[last]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.text_bytes(batch.column(1))
    for low, high in K.doc_blocks(offsets):
        off = offsets[low : high + 1]
        yield low, high, data[off[0] : off[-1]], off - off[0]


def _row_of(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(rows, at, "right") - 1


def _first_of(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Every entry's group's first value."""
    return values[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]


def shared_anchors(docs: DataFrame, length: int, anchor: int, hot: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, keys binary): anchors of each document that others hold too; and the hot ones."""

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column(0).to_numpy()
        keys, owners = [np.zeros(0, K.U64)], [np.zeros(0, np.int64)]
        for low, high, data, off in _blocks(batch):
            _, rows, place, key, _, _ = anchors(data, off, length, anchor)
            keys.append(key)
            owners.append(ids[low:high][_row_of(rows, place)])
        return np.concatenate(keys), np.concatenate(owners)

    return exchange.shared_keys(docs.where("doc_id is not null"), keys_of, hot, "anchors")


def repeated_windows(seeded: DataFrame, hot_keys: np.ndarray, length: int, anchor: int) -> DataFrame:
    """(doc_id, tags, places, windows): of each document the anchors (word numbers) in repeats.

    ``seeded`` has (doc_id, text, keys); bit j of ``windows`` tells that the window from j words
    left of the anchor on is a repeat; the tag tells rows of one id apart by their texts.
    """
    n_buckets, reach = exchange.buckets(seeded.sparkSession), length - anchor
    table = seeded.sparkSession.sparkContext.broadcast(hot_keys)
    span = lambda owner, tag, place, mask: exchange.pack(owner.view(K.U64), [exchange.narrow(owner), tag, place, mask], n_buckets, exchange.FOUND, _WIDTH)
    around = np.concatenate([np.arange(-reach, 0), np.arange(anchor, length)])
    distance = np.concatenate([np.arange(reach, 0, -1), np.arange(1, reach + 1)])
    left = np.arange(2 * reach) < reach

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(3).to_numpy().view(np.uint64)
            for low, high, data, off in _blocks(batch):
                have = [r for r in range(low, high) if batch.column(2)[r].is_valid]
                if not have:
                    continue
                h, rows, place, key, far, close = anchors(data, off, length, anchor)
                row = _row_of(rows, place)
                # seeds of all rows in one search; a chance hit brings an anchor too many, which changes nothing
                known = np.concatenate([K.mix(np.frombuffer(batch.column(2)[r].as_buffer(), np.uint64) ^ K.mix(np.full(1, r - low + 1, np.uint64))) for r in have])
                hit = np.isin(K.mix(key ^ K.mix(row.astype(np.uint64) + K.U64(1))), known)
                place, key, far, close, row = (x[hit] for x in (place, key, far, close, row))
                owner = np.array([i.as_py() if i.is_valid else 0 for i in ids.slice(low, high - low)], np.int64)[row]
                tag, word = (tags[low:high][row] >> K.U64(32)).astype("<u4"), (place - rows[row]).astype("<u4")
                is_hot = np.isin(key, table.value)
                if is_hot.any():
                    yield from windows(h, place[is_hot], far[is_hot], close[is_hot], owner[is_hot], tag[is_hot], word[is_hot])
                    place, key, far, close, owner, tag, word = (x[~is_hot] for x in (place, key, far, close, owner, tag, word))
                if not len(place):
                    continue
                need = distance[None, :] <= np.where(left[None, :], far[:, None], (reach - close)[:, None])
                words = np.where(need, h[np.clip(place[:, None] + around[None, :], 0, len(h) - 1)], K.U64(0))
                reaches = (far | close << 8).astype("<u2")
                a, b = digest(key, words, reaches)
                order, new = groups(a, b, owner)
                same = owner[order] == _first_of(new, owner[order])
                later, sent = order[~same], order[same]
                if len(later):
                    mask = ((2 << far[later]) - (1 << close[later])).astype("<u4")
                    yield span(owner[later], tag[later], word[later], mask)
                # place and tag in one column; words last
                yield exchange.pack(key[sent], [key[sent], exchange.narrow(owner[sent]), np.stack([tag[sent], word[sent]], 1), reaches[sent], words[sent]], n_buckets, SEEDED, _WIDTH)

    def digest(key: np.ndarray, words: np.ndarray, reaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for seed in (1, 2):
            x = K.mix(key + reaches.astype(np.uint64) * K.U64(seed))
            for k in range(words.shape[1]):
                x = K.mix(x ^ words[:, k])
            out.append(x)
        return out[0], out[1]

    def windows(h: np.ndarray, place: np.ndarray, far: np.ndarray, close: np.ndarray, owner: np.ndarray, tag: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Occurrences of hot anchors as whole windows."""
        size = far - close + 1
        of = np.repeat(np.arange(len(place)), size)
        j = far[of] - (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))
        begin = place[of] - j
        a, b = K.grams(h, length)[begin], K.grams(h, length, 1)[begin]
        order, new = groups(a, b, owner[of])
        same = owner[of][order] == _first_of(new, owner[of][order])
        later, sent = order[~same], order[same]
        if len(later):
            yield span(owner[of][later], tag[of][later], word[of][later], (1 << j[later]).astype("<u4"))
        yield exchange.pack(a[sent], [a[sent], exchange.narrow(owner[of][sent]), np.stack([tag[of][sent], word[of][sent]], 1), j[sent].astype("<u2"), b[sent]], n_buckets, WINDOW, _WIDTH)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i, (kind, bucket) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if kind == exchange.FOUND:
                    yield batch.slice(i, 1)
                    continue
                if (kind, bucket) != at and held:
                    yield from judged(at[0], held)
                    held = []
                at = kind, bucket
                n = batch.column(2)[i].as_py()
                # copies, so that an entry doesn't keep its whole batch
                held.append([exchange.parsed(batch.column(3 + c)[i].as_buffer(), n, k).copy() for c, k in enumerate(_ENTRY)])
        if held:
            yield from judged(at[0], held)

    def judged(kind: int, held: list) -> Iterator[pa.RecordBatch]:
        key, owner, where, reaches, words = (np.concatenate(x) for x in zip(*held, strict=True))
        where = where.reshape(-1, 2)
        mask = np.zeros(len(key), np.uint32)
        if kind == WINDOW:
            order, new = groups(key, words, owner)
            later = order[owner[order] > _first_of(new, owner[order])]
            mask[later] = 1 << reaches[later].astype(np.uint32)
        else:
            words = words.reshape(len(key), -1)
            far, close = reaches & 255, reaches >> 8
            sides = []
            for seed in (1, 2):  # chains of hashes to the left and to the right, a word at a time
                to_left, to_right = [K.mix(key + K.U64(seed))], [K.mix(key + K.U64(seed + 2))]
                for k in range(reach):
                    to_left.append(K.mix(to_left[-1] ^ words[:, reach - 1 - k]))
                    to_right.append(K.mix(to_right[-1] ^ words[:, reach + k]))
                sides.append((to_left, to_right))
            for j in range(reach + 1):
                some = np.flatnonzero((close <= j) & (j <= far))
                if len(some) < 2:
                    continue
                a, b = (K.mix(x[j][some] ^ (y[reach - j][some] << K.U64(1))) for x, y in sides)
                order, new = groups(a, b, owner[some])
                order = some[order]
                later = order[owner[order] > _first_of(new, owner[order])]
                mask[later] |= np.uint32(1 << j)
        hit = mask > 0
        if hit.any():
            yield span(owner[hit], where[hit, 0], where[hit, 1], mask[hit])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, tag, place, mask in exchange.by_bucket(batches, _SPAN):
            order, new = groups(owner, place)
            owner, tag, place, mask = (x[order] for x in (owner, tag, place, mask))
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(owner[starts]), *(K.split_binary(x, bounds) for x in (tag, place, mask))], names=["doc_id", "tags", "places", "windows"])

    sent = seeded.mapInArrow(send, exchange.schema(_WIDTH))
    found = exchange.received(sent).mapInArrow(settle, exchange.schema(_WIDTH))
    return exchange.received(found).mapInArrow(gather, "doc_id long, tags binary, places binary, windows binary")


def _spans(tag: int, tags: memoryview, places: memoryview, windows: memoryview, length: int, n: int) -> np.ndarray:
    """Which of a row's n words lie in a repeated window."""
    mine = np.frombuffer(tags, "<u4") == tag
    place, mask = np.frombuffer(places, "<u4")[mine].astype(np.int64), np.frombuffer(windows, "<u4")[mine]
    edge = np.zeros(n + 1, np.int32)
    for j in range(int(mask.max()).bit_length() if len(mask) else 0):
        begin = place[(mask >> np.uint32(j)) & np.uint32(1) > 0] - j
        np.add.at(edge, begin, 1)
        np.subtract.at(edge, begin + length, 1)
    return np.cumsum(edge[:-1]) > 0


def _found(docs: DataFrame, length: int, anchor: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tag, tags, places, windows): every row and its document's repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds, hot_keys = shared_anchors(rows, length, anchor, hot)
    # both joins read the documents alike, so one exchange of the texts serves both
    tag = F.xxhash64("text").alias("tag")
    seeded = rows.join(seeds.hint("merge"), "doc_id", "left").select("doc_id", "text", "keys", tag)
    repeats = repeated_windows(seeded, hot_keys, length, anchor)
    return rows.join(repeats.hint("merge"), "doc_id", "left").select("doc_id", "text", tag, "tags", "places", "windows")


def _covered(batch: pa.RecordBatch, r: int, n: int, length: int) -> np.ndarray | None:
    if not batch.column(3)[r].is_valid:
        return None
    tag = (batch.column(2)[r].as_py() & (1 << 64) - 1) >> 32
    return _spans(tag, *(batch.column(c)[r].as_buffer() for c in (3, 4, 5)), length, n)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words): the maximal repeats, in word numbers from 0."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r, text in enumerate(batch.column(1)):
                gone = _covered(batch, r, len((text.as_py() or "").encode().split()), length)
                if gone is not None and gone.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out += [(batch.column(0)[r].as_py(), int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_words"])

    return _found(docs, length, anchor, hot, id_col, text_col).mapInArrow(spans, "doc_id long, start long, n_words long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row; kept words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for r, text in enumerate(batch.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                gone = _covered(batch, r, len(words), length)
                n_words.append(len(words))
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return _found(docs, length, anchor, hot, id_col, text_col).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
