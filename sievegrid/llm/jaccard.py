"""N-gram Jaccard join in the metric space of shingle sets.

Distance is d = 1 - J; documents link where d <= r (r = 0.2).  d is a metric.

Pivots.  Unrelated texts lie at distance 1 from each other, so pivots drawn at random would
leave every document in everybody's window.  Instead documents choose pivots among those they
can be near to.  Each brings its shingles of least hash, 20 + ``EXTRA`` percent of them, to an
exchange that tells it which of them others bring too.  As two linked sets differ in at most
20 percent of either, they share at least ``EXTRA`` percent of the smaller one there: documents
with fewer shared ones have no links and go no further, so passages and lines that stand in
otherwise different texts don't bring these together.  Of the documents that hold a shingle
then, the most central one (with the largest part of its shingles shared) is the pivot that
they have in common.  A document's pivots are few, its region and those it borders on: it
leaves out those that stand for less than half of what it must share with a linked one, as two
documents still have a pivot in common then.  In every region those without a partner, judged
by the shingles that were brought, leave before whole sets travel.

Regions.  Every pivot is a Voronoi region with the documents that chose it.  Inside, members'
exact distances to pivots decide: those within r of a pivot are in its component at once;
others get pivots of their own, homes with the nearest one, and triangle-inequality windows
that replicate boundary documents, and these regions join recursively (``regions``).  Pairs
within a component are never listed, and no cap is set.

Large regions.  A region of more than ``CHUNK`` sets is dealt out in chunks that all know the
pivot.  Each chunk is resolved by itself.  What is still apart from the pivot then may link with what lies in other
chunks; all of these compare what they have beyond the pivot.  A set of n lacks at most a fifth of n in one that it
links with, so if it has more than that beyond the pivot, one of any fifth and one of these is in the other.  Each
brings its rarest ones, those that have a partner among them choose new pivots, and these regions are joined as before,
level by level, until they are small.  So what a site's pages have in common divides them no more, and only what they
have beyond it brings them together.  Sets with less than that beyond their pivot, which are nearly parts of it, are met
in blocks.

Equal sets are one set for the join, found by digest.

Null and empty texts have no shingles and are linked with nothing; fewer than n words make
one shingle of all.  Rows with a null id keep a null component and link with nothing; rows
that share an id are one document, linked by any of their texts.  Empty tables give empty
results; texts of any length are whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, exchange, store
from . import kernel as K
from .regions import Region, drawn, least_shared, with_partners

WORDS = 5
PERCENT = 80
EXTRA = 10
CHUNK = 2048
CHUNK_BYTES = 1 << 24
BROADCAST_ROWS = 1 << 20  # of four numbers each: 32 MB
LEVELS = 8
SIFT_BYTES = 1 << 26


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the rows' bounds among them."""
    h, _, _, rows = K.hash_words(K.LOWER[data], offsets)
    at = K.inside(rows, n)
    row = np.searchsorted(rows, at, "right") - 1
    keys = K.grams(h, n)[at]
    size = np.diff(rows)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):  # the whole sequence as one; its length keeps it apart from longer ones
        whole = np.array([K.grams(h[rows[r] : rows[r + 1]], int(size[r]))[0] for r in short.tolist()], np.uint64) ^ K.mix(size[short].astype(np.uint64))
        keys, row = np.concatenate([keys, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        keys[a:b].sort()
    if len(keys):
        new = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))
        keys, bounds = keys[new], np.append(0, np.cumsum(new))[bounds]
    return keys, bounds


def _digests(keys: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = memoryview(keys.tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.text_bytes(batch.column(1))
    for low, high in K.doc_blocks(offsets):
        off = offsets[low : high + 1]
        yield low, high, *shingle_sets(data[off[0] : off[-1]], off - off[0])


def _survey(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, keys, bounds in _blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(bounds)), pa.array(_digests(keys, bounds), pa.binary())], names=["doc_id", "n", "digest"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary")


def candidates(docs: DataFrame, percent: int = PERCENT, extra: int = EXTRA) -> DataFrame:
    """(doc_id, keys binary): the shingles of least hash that each document shares with others."""
    share = 100 - percent + extra

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, found, owners = batch.column(0).to_numpy(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high, keys, bounds in _blocks(batch):
            # keys ascend within a row
            size = np.diff(bounds)
            take = drawn(size, share)
            row = np.repeat(np.arange(len(size)), take)
            found.append(keys[bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)])
            owners.append(ids[low:high][row])
        return np.concatenate(found), np.concatenate(owners)

    return exchange.shared_keys(docs.where("doc_id is not null"), keys_of, 1 << 62, "shingles")[0]


def chosen_pivots(found: DataFrame, sizes: DataFrame, percent: int = PERCENT, extra: int = EXTRA, chunk: int = 2 * CHUNK) -> DataFrame:
    """(doc_id, pivot): the documents that may have links, with the pivots in whose regions they may.

    ``sizes`` has (doc_id, n): the documents to regard and their set size, 0 for an id with several
    texts, which is spared all tests by size.  Regions of more than ``chunk`` documents, or of more than
    ``SIFT_BYTES`` of brought shingles, are not looked into.
    """
    share = 100 - percent + extra

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            size, n = np.array([len(k) for k in keys], np.int64), batch.column(2).to_numpy()
            spare = (least_shared(n, percent, share) - 1) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(1 - size / np.maximum(n, 1), size)), pa.array(np.repeat(spare, size))], names=["doc_id", "key", "apart", "spare"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def one() -> pa.RecordBatch:
            ids, n = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            keys = [h[2] for h in held]
            # rows of one id are told apart by nothing here, and none has its partner in another
            some = with_partners(np.concatenate(keys), np.append(0, np.cumsum([len(k) for k in keys])), n, ids, percent, share)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(int(some.sum()), at))], names=["doc_id", "pivot"])

        for batch in batches:
            for pivot, doc, n, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if pivot != at and held:
                    yield one()
                    held = []
                at = pivot
                held.append((doc, n, np.frombuffer(keys.as_buffer(), np.uint64).copy()))
        if held:
            yield one()

    enough = F.octet_length("keys") / 8 >= F.floor(F.lit(extra * percent) * F.col("n") / 10000) + 1
    kept = store.keep(found.join(sizes, "doc_id").where(enough).select("doc_id", "keys", "n"), "candidates", "none")
    entries = kept.mapInArrow(spread, "doc_id long, key long, apart double, spare long")
    # the least is found before it shuffles, and the join's skewed side can be split
    least = entries.groupBy("key").agg(F.min(F.struct("apart", F.xxhash64("doc_id").alias("h"), "doc_id")).alias("p"), F.count("*").alias("m")).where("m > 1")
    shared = entries.join(least.select("key", F.col("p.doc_id").alias("pivot")), "key").groupBy("doc_id", "pivot").agg(F.count("*").alias("m"), F.first("spare").alias("spare"))
    rising = Window.partitionBy("doc_id").orderBy("m", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    chosen = store.keep(shared.withColumn("sum", F.sum("m").over(rising)).where("sum > spare or doc_id = pivot").select("doc_id", "pivot"), "chosen")
    weighed = chosen.join(kept.select("doc_id", F.octet_length("keys").alias("bytes")), "doc_id")
    counts = weighed.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes")).where("m > 1")
    fits = (F.col("m") <= chunk) & (F.col("bytes") <= SIFT_BYTES)
    large = chosen.join(counts.where(~fits).select("pivot"), "pivot", "left_semi")
    small = chosen.join(counts.where(fits).select("pivot"), "pivot", "left_semi").join(kept, "doc_id").select("pivot", "doc_id", "n", "keys")
    sifted = small.repartition(exchange.partitions(kept.sparkSession), "pivot").sortWithinPartitions("pivot").mapInArrow(sift, "doc_id long, pivot long")
    return sifted.unionByName(large.select("doc_id", "pivot"))


def _joined(units: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each unit; of wide ones also their members (a) with what they have beyond the pivot.

    ``units`` has (region, unit, doc_id, s, role, wide): the pivot has role 0, members 1, and if there are
    queries (2) only they are compared, with the members.  Members have a null ``b``, whether they are apart from
    the pivot, ``rest`` (shingles beyond it) and ``lack`` (how many shingles a set that they link with may lack of theirs).
    """
    schema = "a long, b long, region long, apart boolean, rest binary, lack int"
    names = ["a", "b", "region", "apart", "rest", "lack"]

    def links(work: Region, ids: np.ndarray, region: int) -> pa.RecordBatch:
        a, b = (pa.array([int(ids[r[k]]) for r in work.links.found], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, pa.array([region] * len(a), pa.int64()), pa.nulls(len(a), pa.bool_()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int32())], names=names)

    def one(region: int, ids: np.ndarray, role: np.ndarray, sets: list[np.ndarray], wide: bool) -> Iterator[pa.RecordBatch]:
        # equal rows (a repeated document) are one
        work = Region(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), ids, percent)
        rows, queries = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
        if len(queries):
            work.against(queries, rows)
            yield links(work, ids, region)
            return
        # of a pivot's several texts the same one in every unit
        first = min(np.flatnonzero(role == role.min()).tolist(), key=lambda i: sets[i].tobytes())
        work.resolve(rows, first)
        yield links(work, ids, region)
        if not wide:
            return
        root = work.links.roots(np.arange(len(ids)))
        some = np.flatnonzero(role == 1)
        rest = [np.setdiff1d(sets[i], sets[first], assume_unique=True) for i in some.tolist()]
        size = work.size[some]
        lack = size - -(-percent * size // 100)
        packed = K.split_binary(np.concatenate([*rest, np.zeros(0, np.uint64)]), np.append(0, np.cumsum([len(x) for x in rest])))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(np.full(len(some), region)), pa.array(root[some] != root[first]), packed, pa.array(lack.astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, wide = None, [], False
        for batch in batches:
            for region, unit, doc, role, s, w in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if (region, unit) != at and held:
                    yield from one(at[0], np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], wide)
                    held = []
                at, wide = (region, unit), w
                # a copy, so that a row doesn't keep its whole batch
                held.append((doc, role, np.frombuffer(s.as_buffer(), np.uint64).copy()))
        if held:
            yield from one(at[0], np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], wide)

    parts = exchange.partitions(units.sparkSession)
    return units.select("region", "unit", "doc_id", "role", "s", "wide").repartition(parts, "region", "unit").sortWithinPartitions("region", "unit", "role", "doc_id").mapInArrow(run, schema)


def _with_sets(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(region, unit, doc_id, role, wide, s): every row of ``units`` with the shingle sets of its document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, keys, bounds in _blocks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), K.split_binary(keys, bounds), batch.column(2).slice(low, high - low)], names=["doc_id", "s", "us"])

    units = store.keep(units.groupBy("doc_id").agg(F.collect_list(F.struct("region", "unit", "role", "wide")).alias("us")), "units")
    few = units.select(F.coalesce(F.sum(F.size("us")), F.lit(0))).first()[0] <= BROADCAST_ROWS  # beyond it both sides shuffle
    kind = units.schema["us"].dataType.simpleString()
    made = docs.join(F.broadcast(units) if few else units, "doc_id").select("doc_id", "text", "us").mapInArrow(sets, f"doc_id long, s binary, us {kind}")
    return made.where(F.octet_length("s") > 0).select("doc_id", "s", F.inline("us"))


def _below(rests: DataFrame) -> DataFrame:
    """(region, doc_id, lead): new regions of members of wide ones that share something rare beyond their pivot.

    Where two sets share more beyond it than either may do without, they share one of the rarest ``lack`` + 1 of
    both, in one order for all of the region; those that no other has, or none that is apart, come first in it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]
            size = np.array([len(k) for k in keys], np.int64)
            repeated = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), size)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(np.repeat(size, size)), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.repeat(batch.column(5).to_numpy(), size))], names=["region", "doc_id", "apart", "lack", "n", "key", "text"])

    rows = rests.select("region", F.col("a").alias("doc_id"), "apart", F.col("lack").cast("long"), "rest", F.xxhash64("rest").alias("text")).distinct()
    keyed = rows.mapInArrow(spread, "region long, doc_id long, apart boolean, lack long, n long, key long, text long")
    shared = keyed.groupBy("region", "key").agg(F.count("*").alias("m"), F.max("apart").alias("some")).where("m > 1 and some").select("region", "key", "m")
    own = Window.partitionBy("region", "doc_id", "text", "lack")
    ranked = keyed.join(shared, ["region", "key"]).withColumn("c", F.count("*").over(own)).withColumn("rn", F.row_number().over(own.orderBy("m", "key")))
    brought = store.keep(ranked.where("rn <= least(n, lack + 1) - (n - c)").select("region", "key", "doc_id", "apart"), "beyond-pivots")
    leads = brought.groupBy("region", "key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("p"), F.count("*").alias("m"), F.max("apart").alias("some")).where("m > 1 and some")
    dealt = brought.join(leads.select("region", "key", F.col("p.doc_id").alias("lead")), ["region", "key"])
    return dealt.select(F.xxhash64("region", "lead").alias("region"), "doc_id", (F.col("doc_id") == F.col("lead")).alias("lead")).distinct()


def _met(docs: DataFrame, near: DataFrame, large: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(a, b): links of those apart among ``near`` (region, doc_id, apart) with the others, in blocks of other chunks."""
    near = near.join(large, "region")
    apart = near.where("apart")
    blocks = store.keep(apart.groupBy("region", "k").agg(F.ceil(F.count("*") / chunk).cast("int").alias("q")), "blocks")
    unit = lambda c, q: (c * F.col("q") + q).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("k"))
    asked = apart.join(blocks, ["region", "k"]).select("region", "doc_id", F.lit(2).alias("role"), F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda c: c != own), lambda c: unit(c, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("q"))))).alias("unit"))
    there = near.join(blocks, ["region", "k"]).select("region", "doc_id", F.lit(1).alias("role"), F.explode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda q: unit(own, q))).alias("unit"))
    found = _joined(_with_sets(docs, asked.unionByName(there).withColumn("wide", F.lit(False))), percent)
    return found.where("b is not null").select("a", "b")


def _links(docs: DataFrame, pivots: DataFrame, sizes: DataFrame, percent: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """(a, b) links that make up the components of all documents with pivots."""
    # a pivot that has no partner itself still tells its region's distances apart
    members = store.keep(pivots.unionByName(pivots.select(F.col("pivot").alias("doc_id"), "pivot")).distinct().select(F.col("pivot").alias("region"), "doc_id", (F.col("doc_id") == F.col("pivot")).alias("lead")), "members")
    out, before = None, 0
    for level in range(LEVELS):
        totals = members.join(sizes, "doc_id").groupBy("region").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes"))
        chunks = F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
        large = store.keep(totals.select("region", chunks.alias("k"), "m").where("k > 1"), "large-regions")
        dealt = members.join(large.select("region", "k"), "region", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
        # the pivot goes to every chunk of its region
        units = dealt.select("region", "doc_id", F.when(F.col("lead"), 0).otherwise(1).alias("role"), (F.col("k") > 1).alias("wide"), F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(own)).alias("unit"))
        first = store.keep(_joined(_with_sets(docs, units), percent), "links")
        found = first.where("b is not null").select("a", "b")
        out = found if out is None else out.unionByName(found)
        size = large.agg(F.sum("m")).first()[0]
        if not size:
            return out
        # new pivots that hardly divide what the last ones left are no help: then blocks
        last, before = level == LEVELS - 1 or level > 0 and 4 * size > 3 * before, size
        rests = first.where("b is null")
        near = rests if last else rests.where(F.octet_length("rest") <= 8 * F.col("lack"))
        near = store.keep(near.select("region", F.col("a").alias("doc_id"), "apart").distinct(), "near-pivots")
        if not near.where("apart").isEmpty():
            out = out.unionByName(_met(docs, near, large.select("region", "k"), percent, chunk))
        if last:
            return out
        members = store.keep(_below(rests), "members")
        if members.isEmpty():
            return out
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = store.keep(_survey(rows), "survey")
    known = facts.where("n > 0 and doc_id is not null")
    # of equal sets the one with the least id stands for all
    least = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    named = known.join(least, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n")
    # a row a document: the representatives of its texts (several if rows share an id)
    reps = store.keep(named.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.array_sort(F.collect_set("rep")).alias("all"), F.min("n").alias("n"), F.max("n").alias("most")), "representatives")
    stands = reps.where(F.array_contains("all", F.col("doc_id")))
    pivots = store.keep(chosen_pivots(candidates(rows, percent), stands.select("doc_id", F.when(F.size("all") == 1, F.col("n")).otherwise(0).alias("n")), percent), "pivots")
    links = _links(rows, pivots, stands.select("doc_id", F.col("most").alias("n")), percent, chunk, chunk_bytes)
    same = reps.where("size(all) > 1").select(F.explode("all").alias("a"), F.col("rep").alias("b")).where("a != b")
    labels = store.keep(components.components(links.unionByName(same)), "labels")
    # copies hang on their representative, that on its component
    named = reps.select("doc_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return facts.join(named, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
