"""Phrase collocation mining over vertical positional inverted lists.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into
words.  The texts of one language form blocks of bounded size.  In a block every
word has the list of its positions, numbered so that neighbours in a piece are one apart and pieces
are not; these lists are the index, a table of one row a block.  A phrase's list holds where it
starts.  Frequent phrases grow by a word: the list of a phrase merges with the lists of what starts
one place on, a position that both have is an occurrence of the longer phrase, and the
lists' lengths add up over the blocks to its exact frequency.  Only phrases whose first and last words
but one are frequent can be so themselves, so only their lists are merged.

Between levels, blocks send each phrase's identity and length once; it is summed up with
the other blocks' in one of many buckets, and a frequent phrase's number goes back to those blocks.  So
a phrase that a third of all texts hold is a row a block, and no list leaves its block.
Words are compared as strings between blocks and by 64-bit hashes within one; phrases by
the numbers of their parts, exactly.

Null texts count as empty, a null language as ``und``; repeated rows count each; ids aren't read;
texts of any length are whole, each within one block; an empty table gives an empty result; other columns are
never read.  Equal scores go by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import kernel as K
from . import store

LEAST = 10
MAX_WORDS = 3
LIMIT = 2000
CONTAINED_PERCENT = 50
SCALE = 1_000_000
BLOCK_BYTES = 1 << 23
_BITS = 33  # of a row's number within its partition, in monotonically_increasing_id

_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _CUT.copy()
_GAP[list(b" \t")] = True
_INDEX = "block long, lang string, n_words long, words array<string>, lengths array<int>, positions binary"


def positions_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of a block of texts: the distinct words, how long their lists are, and all lists on end."""
    starts, ends, rows = K.word_spans(data, offsets, _GAP[data])
    hashes = K.hash_spans(data, starts, ends)
    cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
    apart = cuts[starts[1:]] != cuts[ends[:-1]]
    first = rows[1:-1]
    apart[first[(first > 0) & (first < len(starts))] - 1] = True
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(apart)])[: len(starts)]
    _, one, length = np.unique(hashes, return_index=True, return_counts=True)
    raw = data.tobytes()
    return [raw[starts[i] : ends[i]] for i in one.tolist()], length, at[np.argsort(hashes, kind="stable")]


def index(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted lists of every block: a row a block, its positions by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _BITS
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = K.text_bytes(batch.column(1).take(pa.array(np.flatnonzero(langs.indices.to_numpy() == code))))
                data = K.LOWER[data]
                for low, high in K.doc_blocks(offsets, block_bytes):
                    own = offsets[low : high + 1]
                    words, length, at = positions_of(data[own[0] : own[-1]], own - own[0])
                    if not len(at):
                        continue
                    columns = [[block], [lang], [len(at)], pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([length.tolist()], pa.list_(pa.int32())), [at.astype("<u4").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["block", "lang", "n_words", "words", "lengths", "positions"])
                    block += 1

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table, with ``id`` from 1 without gaps."""
    kept = store.keep(rows.withColumn("sg_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("sg_row", _BITS)
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a task
    before = np.concatenate([[0], np.cumsum([r["count"] for r in sizes])]).tolist()
    starts = kept.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "sg_part long, sg_before long")
    local = F.col("sg_row").bitwiseAND((1 << _BITS) - 1)
    return kept.join(F.broadcast(starts), part == F.col("sg_part")).withColumn("id", F.col("sg_before") + local + 1).drop("sg_row", "sg_part", "sg_before")


def _vocabulary(lists: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words (id, lang, word, f), and for each block the numbers of its words (block, slots, ids)."""
    words = lists.select("block", "lang", F.posexplode(F.arrays_zip("words", "lengths")).alias("slot", "x")).select("block", "lang", "slot", F.col("x.words").alias("word"), F.col("x.lengths").alias("n"))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    vocabulary = store.keep(_numbered(frequent, "frequent-words"), "vocabulary")
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    known = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "id"))).alias("x"))
    return vocabulary, store.keep(known.select("block", F.col("x.slot").alias("slots"), F.col("x.id").alias("ids")), "word-numbers")


def _buckets(prefix: np.ndarray, suffix: np.ndarray, n: int) -> np.ndarray:
    return ((K.mix(K.mix(prefix.astype(K.U64)) ^ suffix.astype(K.U64)) >> K.U64(33)) % K.U64(n)).astype(np.int64)


def grown(at: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge the lists with those one place on.

    ``at`` is ascending, ``phrase`` what starts there.  Returns the distinct longer phrases as
    (prefix, suffix), which of them each occurrence is, and where it starts.
    """
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    names, local = np.unique(phrase, return_inverse=True)
    pair, which = np.unique(local[here] * len(names) + local[here + 1], return_inverse=True)
    return names[pair // max(1, len(names))], names[pair % max(1, len(names))], which, at[here]


def _lists(row: dict, n_buckets: int, offsets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """A block's occurrences of frequent phrases of the longest length known so far, by position."""
    length = np.asarray(row["lengths"], np.int64)
    ids = np.zeros(len(length), np.int64)
    ids[np.asarray(row["slots"], np.int64)] = row["ids"]
    at, phrase = np.frombuffer(row["positions"], "<u4").astype(np.int64), np.repeat(ids, length)
    order = np.argsort(at)
    order = order[phrase[order] > 0]
    at, phrase = at[order], phrase[order]
    for level, before in enumerate(offsets):
        prefix, suffix, which, at = grown(at, phrase)
        number = np.zeros(len(prefix), np.int64)
        by = np.argsort(_buckets(prefix, suffix, n_buckets), kind="stable")
        replies = sorted(row[f"r{level}"] or [], key=lambda x: x["bucket"])
        local = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["local"], "<u4").astype(np.int64) for x in replies)])
        shift = np.concatenate([np.zeros(0, np.int64), *(np.full(len(x["local"]) // 4, before[x["bucket"]], np.int64) for x in replies)])
        number[by] = np.where(local > 0, shift + local, 0)
        phrase = number[which]
        at, phrase = at[phrase > 0], phrase[phrase > 0]
    return at, phrase


def _level(blocks: DataFrame, n_buckets: int, offsets: list[list[int]], least: int, name: str) -> DataFrame:
    """What the buckets find: frequent phrases (kind 0: prefix, suffix, f), replies to blocks (kind 1: local)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                prefix, suffix, which, _ = grown(*_lists(row, n_buckets, offsets))
                if not len(prefix):
                    continue
                bucket = _buckets(prefix, suffix, n_buckets)
                order = np.argsort(bucket, kind="stable")
                some, first = np.unique(bucket[order], return_index=True)
                bounds = np.append(first, len(order))
                sent = [X.narrow(prefix)[order], X.narrow(suffix)[order], np.bincount(which, minlength=len(prefix)).astype("<u4")[order]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"], np.int64)), pa.array(some.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), *(K.split_binary(c, bounds) for c in sent)], names=["block", "bucket", "n", "prefix", "suffix", "count"])

    def settle(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        prefix, suffix, count = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        order = np.lexsort((suffix, prefix))
        p, s = prefix[order], suffix[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(new)
        f = np.add.reduceat(count[order], starts)
        local = np.where(f >= least, np.cumsum(f >= least), 0)
        back = np.empty(len(order), np.int64)
        back[order] = local[np.cumsum(new) - 1]
        bounds = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
        blocks = pa.array([h[0] for h in held], pa.int64())
        rows = len(held)
        nothing = pa.nulls(rows, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows, np.int32)), blocks, pa.array(np.full(rows, bucket, np.int32)), pa.array(np.diff(bounds).astype(np.int32)), nothing, nothing, nothing, K.split_binary(back.astype("<u4"), bounds)], names=names)
        at = starts[f >= least]
        if len(at):
            own = [pa.array([x.astype("<i8").tobytes()]) for x in (p[at], s[at], f[f >= least])]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([len(at)], pa.int32()), *own, pa.nulls(1, pa.binary())], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, (block, bucket, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)):
                if bucket != now and held:
                    yield from settle(now, held)
                    held = []
                now = bucket
                held.append((block, *(X.parsed(batch.column(k)[i].as_buffer(), n, "id") for k in (3, 4)), np.frombuffer(batch.column(5)[i].as_buffer(), "<u4").astype(np.int64)))
        if held:
            yield from settle(now, held)

    names = ["kind", "block", "bucket", "n", "prefix", "suffix", "f", "local"]
    sent = blocks.mapInArrow(send, "block long, bucket int, n int, prefix binary, suffix binary, count binary")
    dealt = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block")
    return store.keep(dealt.mapInArrow(gather, "kind int, block long, bucket int, n int, prefix binary, suffix binary, f binary, local binary"), name)


def _unpacked(found: DataFrame, offsets: list[int]) -> DataFrame:
    """(id, prefix, suffix, f) of the frequent phrases of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                prefix, suffix, f = (np.frombuffer(batch.column(k)[i].as_buffer(), "<i8") for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(offsets[bucket] + 1 + np.arange(len(f))), *map(pa.array, (prefix, suffix, f))], names=["id", "prefix", "suffix", "f"])

    return found.where("kind = 0").select("bucket", "prefix", "suffix", "f").mapInArrow(run, "id long, prefix long, suffix long, f long")


def _named(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases with their language, words, and the frequencies of their beginnings and ends."""
    p = parts.select(F.col("id").alias("prefix"), "lang", "phrase", F.array_append("firsts", F.col("f")).alias("firsts"))
    s = parts.select(F.col("id").alias("suffix"), F.col("last"), F.array_append("lasts", F.col("f")).alias("lasts"))
    return rows.join(p, "prefix").join(s, "suffix").select("id", "prefix", "suffix", "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "firsts", "lasts")


def mine(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, limit: int = LIMIT, contained_percent: int = CONTAINED_PERCENT, scale: int = SCALE, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``limit`` collocations of each language."""
    spark = docs.sparkSession
    n_buckets = X.partitions(spark)
    lists = store.keep(index(docs, text_col, lang_col, block_bytes), "inverted-lists")
    vocabulary, numbers = _vocabulary(lists, least)
    blocks = lists.select("block", "lengths", "positions").join(numbers.hint("merge"), "block")
    nothing = F.array().cast("array<bigint>")
    parts = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", nothing.alias("firsts"), nothing.alias("lasts"))
    offsets: list[list[int]] = []
    candidates, left = None, []
    for words in range(2, max_words + 1):
        found = _level(blocks, n_buckets, offsets, least, f"phrases-{words}")
        sizes = {r["bucket"]: r["n"] for r in found.where("kind = 0").select("bucket", "n").collect()}  # a row a bucket
        offsets.append(np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(n_buckets)])[:-1]]).tolist())
        phrases = store.keep(_named(_unpacked(found, offsets[-1]), parts), f"named-{words}")
        left.append(phrases)
        if words < max_words:
            replies = found.where("kind = 1").groupBy("block").agg(F.collect_list(F.struct("bucket", "local")).alias(f"r{words - 2}"))
            blocks = blocks.join(replies.hint("merge"), "block")
        parts = phrases
    for words, phrases in enumerate(left, 2):
        rows = _scored(phrases, words, scale)
        if words < max_words:
            # whatever longer candidate holds a phrase, one a word longer that does is no less frequent
            longer = left[words - 1].select(F.explode(F.array_distinct(F.array("prefix", "suffix"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            rows = rows.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a")))
        rows = rows.select("lang", "phrase", "a", "l", "r", "score")
        candidates = rows if candidates is None else candidates.unionByName(rows)
    ranked = _first(candidates, limit)
    totals = lists.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, words: int, scale: int) -> DataFrame:
    """Phrases with the cut that has the least score, the first of several."""
    wide = lambda c: c.cast("decimal(38,0)")
    rows, cuts = phrases.withColumn("a", F.col("f")), []
    for k in range(1, words):
        l, r = F.get("firsts", F.lit(k - 1)), F.get("lasts", F.lit(words - k - 1))
        rows = rows.withColumns({f"l{k}": l, f"r{k}": r, f"top{k}": wide(F.lit(scale)) * wide(F.col("a")) * wide(F.col("a")), f"under{k}": wide(l) * wide(r)})
        cuts.append(F.struct(F.expr(f"top{k} div under{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return rows.withColumn("best", best).select("id", "lang", "phrase", "a", "best.l", "best.r", "best.score")


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each language with their rank.

    First among parts of a language, then among parts of parts: no task sorts a whole language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for parts in (4096, 128, 4):
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= limit)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
