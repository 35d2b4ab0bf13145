"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's features are hashed counts of byte trigrams (with digits and white space folded)
and of word shapes, damped, weighted by inverse document frequency over the labelled sample
and of unit length.  A truncated singular value decomposition of the labelled rows gives the
latent space.  The labelled vectors are broadcast (at most ``MAX_LABELLED`` rows, a stated
bound: the smallest by hash of the id in each class), every document's exact cosines with
all of them come from blocked matrix products, and the neighbours at the ``k`` largest vote
with their similarities.

Learning uses only rows with labels that ``labels`` gives; ids, language, source and labels
are never inputs of a score.  Null labels and labels whose document is absent are left out.
Null and empty texts have a zero vector, to which nothing is similar: no neighbour votes, and
their score is 0; repeated ids are scored each; with fewer labels than neighbours all
labelled rows vote; with no labels every score is the neutral 0.5; ties among neighbours are
settled by their fixed order; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import lean
from . import kernel as K

DIMENSIONS = 4096
LATENT = 48
NEIGHBOURS = 15
MAX_LABELLED = 2000
THRESHOLD = 0.5
_BLOCK_ROWS = 512

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[48:58] = 48
_FOLD[[9, 11, 12, 13, 32]] = 32
_CLASS = np.full(256, 6, np.uint64)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 stop, 5 other sign, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5
_CLASS[list(b"#*$%&|<>@^~=+_\\/{}[]")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4


def features(data: np.ndarray, offsets: np.ndarray, dim: int = DIMENSIONS) -> np.ndarray:
    """Damped counts, one row a text: trigrams of bytes, then shapes of word ends and sizes."""
    n = len(offsets) - 1
    out = np.zeros((n, dim), np.float32)
    for low, high in K.doc_blocks(offsets, 1 << 20):
        part, off = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        if not len(part):
            continue
        row = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(off))
        f = _FOLD[part]
        gram = (f[:-2] << K.U64(16)) | (f[1:-1] << K.U64(8)) | f[2:]
        gram *= K.U64(0x9E3779B97F4A7C15)
        same = row[:-2] == row[2:]
        bucket = (gram >> K.U64(40)).astype(np.int64) % (dim - 64)
        flat = (row[:-2] * dim + bucket)[same]
        kinds = row * dim + (dim - 64) + _CLASS[part].astype(np.int64)
        pairs = (row[:-1] * dim + (dim - 57) + (_CLASS[part[:-1]] * K.U64(7) + _CLASS[part[1:]]).astype(np.int64))[row[:-1] == row[1:]]
        counts = np.bincount(np.concatenate([flat, kinds, pairs]), minlength=(high - low) * dim)
        out[low:high] = counts.reshape(high - low, dim)
    # shares of the text, so that length plays no part
    total = np.maximum(np.diff(offsets), 1).astype(np.float32)[:, None]
    return np.sqrt(out / total)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voter:
    """The latent space and the labelled vectors in it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, latent: int = LATENT, k: int = NEIGHBOURS):
        self.k, self.labels = min(k, len(labels)), labels.astype(np.float32)
        if not len(labels):
            return
        df = (rows > 0).sum(0)
        self.idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
        x = _unit(rows * self.idf)
        # leading right singular vectors by subspace iteration: a few thin matrices beside the sample
        thin = np.random.default_rng(1).standard_normal((x.shape[1], min(latent + 16, len(x)))).astype(np.float32)
        for _ in range(12):
            thin = x.T @ np.linalg.qr(x @ np.linalg.qr(thin)[0])[0]
        base = np.linalg.qr(thin)[0]
        turn = np.linalg.svd(x @ base, full_matrices=False)[2]
        self.axes = base @ turn[:latent].T
        self.vectors = _unit(x @ self.axes)
        # each class has the same say: votes are weighted by one over its size
        size = np.array([max(1.0, (labels == c).sum()) for c in (0, 1)], np.float32)
        self.weight = np.where(labels == 1, 1 / size[1], 1 / size[0]).astype(np.float32)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out = np.zeros(len(rows))
        for low in range(0, len(rows), _BLOCK_ROWS):
            x = rows[low : low + _BLOCK_ROWS]
            cos = _unit(_unit(x * self.idf) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cos, self.k - 1, axis=1)[:, : self.k]
            sim = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 4 * self.weight[near]
            total = sim.sum(1)
            out[low : low + len(x)] = np.where(total > 0, (sim * self.labels[near]).sum(1) / np.maximum(total, 1e-12), 0)
        out[~rows.any(1)] = 0.0
        return out


def _vectors(docs: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*K.text_bytes(batch.column(2)), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), K.split_binary(x.ravel(), np.arange(len(x) + 1) * dim)], names=["doc_id", "label", "x"])

    return docs.mapInArrow(run, "doc_id long, label int, x binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = MAX_LABELLED, dim: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> Voter:
    """Learn from at most ``bound`` labelled rows, half of each class if there are as many.

    Of several texts with one id that with the least hash is learnt.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == c).orderBy(order, "doc_id").limit(bound // 2) for c in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "label", "text")  # at most ``bound`` ids
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "label", "x.text")
    got = _vectors(sample, dim).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])  # at most ``bound`` rows
    x = np.zeros((got.num_rows, dim), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), np.float32)
    return Voter(x, got.column("label").to_numpy().astype(np.int64))


def _scores(voter: Voter, column: pa.Array, dim: int) -> np.ndarray:
    data, offsets = K.text_bytes(column)
    out = np.zeros(len(column))
    for low, high in K.doc_blocks(offsets, 1 << 21):
        for a in range(low, high, _BLOCK_ROWS):
            b = min(high, a + _BLOCK_ROWS)
            off = offsets[a : b + 1]
            out[a:b] = voter.score(features(data[off[0] : off[-1]], off - off[0], dim))
    return np.clip(out, 0, 1)


def score(docs: DataFrame, voter: Voter, dim: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every document."""
    model = docs.sparkSession.sparkContext.broadcast(voter)  # bounded by the sample's bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model.value, batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, voter: Voter, dim: int = DIMENSIONS, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects; no shuffle."""
    model, at = docs.sparkSession.sparkContext.broadcast(voter), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(at), dim) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(doc_id: F.Column, third: int = 1) -> F.Column:
    """Rows whose crc32 of the id as text leaves ``third`` modulo 3; never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == third, F.lit(False))
