"""Token ids by the ``tokenizers`` library, each distinct piece of text encoded once.

Byte-pair merges never cross the boundaries that a tokenizer's own pattern sets, so a text
can be cut at those boundaries that bytes alone prove, and pieces met before need no second
encoding.  Ids equal those of one call over the whole text; rows where bytes alone can't
prove the boundaries (Unicode white space) or that hold an added token's string take that
one call.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import lean
from . import kernel as K

END_ID = 2
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_APOSTROPHE = 39
_SLOT_BITS = 21
_SLOTS = 1 << _SLOT_BITS
_LONG_BYTES = 1 << 24
_BLOCK_BYTES = 1 << 20  # arrays over the pieces of a block take some forty times its size
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that its pieces outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


class Encoder:
    """``encode(data, offsets)`` gives the ids of every row and the row bounds among them.

    With ``added``, strings of added tokens become those tokens, as in a plain call of the
    library; without, they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.added = [x["content"].encode() for x in spec["added_tokens"]] if added else []
        self.keeps_space = spec["normalizer"] is None  # byte-level with spaces, else lower case without
        spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        self.vocab = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self._clear()

    def _clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.held = 0
        self.first, self.second, self.size = (np.zeros(_SLOTS, t) for t in ("<u8", "<u8", np.uint8))
        self.entry = np.zeros(_SLOTS, np.int32)
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.n, self.used = np.zeros(1 << 18, self.dtype), 0, 0

    def _same(self, slot: np.ndarray, piece: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        return (self.size[slot] == piece[2]) & (self.first[slot] == piece[0]) & (self.second[slot] == piece[1])

    def _find(self, h: np.ndarray, pieces: tuple[np.ndarray, ...]) -> np.ndarray:
        """The entry of each piece, -1 if there is none; ``h`` says where to look, the bytes decide."""
        slot = (h >> K.U64(64 - _SLOT_BITS)).astype(np.int64)
        same = self._same(slot, pieces)
        out = np.where(same, self.entry[slot], -1)
        left = np.flatnonzero(~same & (self.size[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
            hit = self._same(slot[left], tuple(x[left] for x in pieces))
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (self.size[slot[left]] != 0)]
        return out

    def _store(self, flat: np.ndarray, count: np.ndarray) -> int:
        """Keep the ids of new pieces; returns the first one's entry."""
        n, m = self.n, len(count)
        while n + m > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[n : n + m], self.count[n : n + m] = self.used + np.cumsum(count) - count, count
        self.used, self.n = self.used + len(flat), n + m
        return n

    def _enter(self, h: np.ndarray, pieces: tuple[np.ndarray, ...], entries: np.ndarray) -> None:
        """Distinct new short pieces go to the table."""
        slot, left = (h >> K.U64(64 - _SLOT_BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            take = left[self.size[slot[left]] == 0]
            _, first = np.unique(slot[take], return_index=True)
            take = take[first]
            at = slot[take]
            self.first[at], self.second[at], self.size[at], self.entry[at] = pieces[0][take], pieces[1][take], pieces[2][take], entries[take]
            placed = np.zeros(len(h), bool)
            placed[take] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every piece; new ones are encoded and kept.

        Pieces of up to 16 bytes are compared as two numbers and a size, longer ones as bytes.
        """
        size = ends - starts
        short, out = np.flatnonzero(size <= 16), np.full(len(size), -1, np.int32)
        words = K.eights(data)
        a = words[starts[short]] & K._LOW_BYTES[np.minimum(size[short], 8)]
        b = np.where(size[short] > 8, words[np.minimum(starts[short] + 8, len(data))], K.U64(0)) & K._LOW_BYTES[np.clip(size[short] - 8, 0, 8)]
        pieces = a, b, size[short].astype(np.uint8)
        h = K.mix(a * K.U64(K._BASE) ^ K.mix(b + pieces[2]))
        out[short] = self._find(h, pieces)
        buffer = data.tobytes() if len(short) < len(size) or (out[short] < 0).any() else b""
        rest: dict[bytes, int] = {}
        far = [(i, buffer[starts[i] : ends[i]]) for i in np.flatnonzero(size > 16).tolist()]
        for _, x in far:
            if x not in self.long and x not in rest:
                rest[x] = len(rest)
        miss = np.flatnonzero(out[short] < 0)
        if len(miss) or rest:
            order = miss[np.lexsort([x[miss] for x in pieces])]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in pieces])
            new = order[new]
            if self.n and (self.n + len(new) + len(rest) > _SLOTS * 6 // 10 or self.held + sum(map(len, rest)) > _LONG_BYTES):
                self._clear()
                return self._entries(data, starts, ends)
            at = short[new]
            texts = [buffer[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)] + [x.decode() for x in rest]
            base = self._store(*self._encode_pieces(texts))
            self._enter(h[new], tuple(x[new] for x in pieces), base + np.arange(len(new), dtype=np.int32))
            self.long |= {x: base + len(new) + i for x, i in rest.items()}
            self.held += sum(map(len, rest))
            out[short[miss]] = self._find(h[miss], tuple(x[miss] for x in pieces))
        for i, x in far:
            out[i] = self.long[x]
        return out

    def _plain(self, piece: str) -> bool:
        """Letters only or punctuation only, perhaps after one space: one piece of the tokenizer's own."""
        body = piece[1:] if len(piece) > 1 and piece[0] == " " else piece
        if body.isalpha():
            return self.keeps_space or body.isascii() or max(body) < "\u0250" and body == body.lower()
        return body.isascii() and body.isprintable() and not any(c.isalnum() or c in " '" for c in body)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each piece's number of them."""
        plain = [self._plain(x) for x in pieces]
        words = [x.encode().decode("latin-1").translate(_BYTE_CHARS) for x, ok in zip(pieces, plain, strict=True) if ok]
        lists = [words[i : i + 512] for i in range(0, len(words), 512)]
        count, ids, flags = np.zeros(len(pieces), np.int32), [], np.array(plain, bool)
        counts = []
        for block, enc in zip(lists, self.merges.encode_batch(lists, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids.append(np.array(enc.ids, self.dtype))
            counts.append(np.bincount(np.array(enc.word_ids, np.int64), minlength=len(block)))
        if counts:
            count[flags] = np.concatenate(counts)
        hard = [x for x, ok in zip(pieces, plain, strict=True) if not ok]
        more = [enc.ids for enc in self.whole.encode_batch_fast(hard, add_special_tokens=False)]
        count[~flags] = list(map(len, more))
        flat = np.concatenate([*ids, np.fromiter((x for row in more for x in row), self.dtype)])
        # flat has the plain pieces first: back into the order of the pieces
        turn = np.argsort(np.concatenate([np.flatnonzero(flags), np.flatnonzero(~flags)]), kind="stable")
        stored = np.concatenate([count[flags], count[~flags]])
        begin = (np.cumsum(stored) - stored)[turn]
        total = np.cumsum(count) - count
        return flat[np.repeat(begin - total, count) + np.arange(len(flat))], count

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces that make up all rows."""
        n = len(data)
        space = K.SEPARATOR[data]
        cut = np.zeros(n + 1, bool)
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = 32, data[:-1]
        before = K.SEPARATOR[prev]
        letter = _LETTER[data]
        wide = np.flatnonzero(data == 0xC3)  # Latin-1 letters, but for two signs
        wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        cut[1:-1] = letter[:-1] & _PUNCT[data[1:]]
        cut[:-1] |= letter & _PUNCT[prev] & (prev != _APOSTROPHE)
        cut[:-1] |= space & ~before
        begins = before & ~space  # a word after white space: a space before it is its own
        if self.keeps_space:
            cut[:-1] |= begins & (prev != 32)
            at = np.flatnonzero(begins[1:])  # the run's last character
            cut[at] = True
        else:
            cut[:-1] |= begins
        cut[offsets] = True
        if self.keeps_space and len(first := offsets[:-1][(offsets[:-1] < offsets[1:]) & (offsets[:-1] > 0)]):
            # the character before belongs to another row: that row ends in one run of white space
            last = first - 1
            run = last[space[last] & ~space[first]]
            keep = (run == 0) | ~space[np.maximum(run - 1, 0)] | np.isin(run, offsets)
            cut[run[~keep]] = False
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        if not self.keeps_space:
            ok = ~space[starts]
            starts, ends = starts[ok], ends[ok]
        return starts, ends

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with white space beyond ASCII, or letters of which lower case may join neighbours."""
        at = np.flatnonzero(data[:-1] >= 0xC2)
        a, b = data[at], data[at + 1]
        c = data[np.minimum(at + 2, len(data) - 1)]
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        return np.unique(np.searchsorted(offsets, at[odd], "right") - 1)

    def _added_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with the string of an added token."""
        buffer, at = data.tobytes(), []
        for token in self.added:
            i = buffer.find(token)
            while i >= 0:
                at.append(i)
                i = buffer.find(token, i + 1)
        return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(rows + 1, np.int64)
        raw, odd = data, np.union1d(self._odd_rows(data, offsets), self._added_rows(data, offsets))
        if not self.keeps_space:
            data = K.LOWER[data]
        starts, ends = self._pieces(data, offsets)
        if len(odd):
            skip = np.isin(np.searchsorted(offsets, starts, "right") - 1, odd)
            starts, ends = starts[~skip], ends[~skip]
        flat, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), _SLOTS // 4):  # never more new pieces than the table holds
            entry = self._entries(data, starts[k : k + _SLOTS // 4], ends[k : k + _SLOTS // 4])
            count, at = self.count[entry].astype(np.int64), self.at[entry]
            before = np.cumsum(count) - count
            flat.append(self.pool[np.repeat(at - before, count) + np.arange(int(count.sum()))])
            counts.append(count)
        ids, before = np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        bounds = before[np.searchsorted(starts, offsets)]
        if len(odd):
            buffer = raw.tobytes()
            parts, last = [], 0
            extra = np.zeros(rows + 1, np.int64)
            for r in odd.tolist():
                enc = np.array(self.whole.encode(buffer[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, self.dtype)
                parts += [ids[last : bounds[r]], enc]
                last = bounds[r]
                extra[r + 1] = len(enc)
            ids, bounds = np.concatenate([*parts, ids[last:]]), bounds + np.cumsum(extra)
        return ids, bounds


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each followed by the end id."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def token_rows(docs: DataFrame, tokenizer: str, histogram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, start, n_tokens, ids binary, counts binary): one row a document, end id included.

    ``part`` is the task that made the row and ``start`` the ids before it in that task;
    ids are little-endian, of two bytes where the vocabulary allows.  With ``histogram``
    each task adds one row without id whose ``counts`` hold (symbol, count) pairs.
    """
    schema = "doc_id long, part int, start long, n_tokens long, ids binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        seen = np.zeros(enc.vocab + END_ID + 1, np.int64)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for low, high in K.doc_blocks(offsets, _BLOCK_BYTES):
                off = offsets[low : high + 1]
                ids, bounds = with_end(*enc.encode(data[off[0] : off[-1]], off - off[0]))
                if histogram:
                    seen += np.bincount(ids, minlength=len(seen))
                m = high - low
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, m), pa.array(np.full(m, part, np.int32)), pa.array(done + bounds[:-1]), pa.array(np.diff(bounds)), K.split_binary(ids, bounds), pa.nulls(m, pa.binary())], names=names)
                done += int(bounds[-1])
        if histogram and done:
            some = np.flatnonzero(seen)
            pairs = np.stack([some, seen[some]], 1).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([done]), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([pairs.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "part", "start", "n_tokens", "ids", "counts"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)
