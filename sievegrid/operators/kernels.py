"""Pluggable array kernels: named batch functions for work that expressions can't do.

A kernel takes a float array of shape (rows, values) and returns one of (rows, results); all
rows of a call have the same length, and rows of different lengths go in separate calls.
Models would be plugged in here; none is installed, so the built-in kernels are numeric.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import lists

Kernel = Callable[[np.ndarray], np.ndarray]
# architectures that half precision breaks, by a part of the kernel's name
SINGLE_ONLY = ("dat",)


@dataclasses.dataclass(frozen=True)
class Model:
    """A kernel with the scale it declares; ``load`` makes it, once for each worker and precision."""

    name: str
    load: Callable[[str], Kernel]
    scale: float = 1.0


_models: dict[str, Model] = {}
_loaded: dict[tuple[str, str], Kernel] = {}


def register(name: str, kernel: Kernel, scale: float = 1.0) -> None:
    """A kernel that is the same at any precision."""
    register_model(Model(name, lambda precision: kernel, scale))


def register_model(model: Model) -> None:
    _models[model.name] = model


def names() -> list[str]:
    return sorted(_models)


def scale_of(name: str) -> float:
    return _models[name].scale


def precision_of(name: str, half: bool | None, has_half: bool = True) -> str:
    """fp16 or fp32: as asked for, by what there is if nothing is, and never half where that breaks."""
    if any(x in name.lower() for x in SINGLE_ONLY) or not has_half:
        return "fp32"
    return "fp32" if half is False else "fp16"


def loaded(model: Model, precision: str) -> Kernel:
    """The kernel, from this worker's cache if it was loaded before."""
    key = model.name, precision
    if key not in _loaded:
        _loaded[key] = model.load(precision)
    return _loaded[key]


def unload() -> None:
    """Empty this process's cache."""
    _loaded.clear()


def box_down(x: np.ndarray, factor: int = 4) -> np.ndarray:
    """Means of runs of ``factor`` values."""
    n = x.shape[1] // factor * factor
    return x[:, :n].reshape(len(x), -1, factor).mean(2)


def nearest_up(x: np.ndarray, factor: int = 2) -> np.ndarray:
    return np.repeat(x, factor, 1)


register("box_down", box_down, 0.25)
register("nearest_up", nearest_up, 2.0)


def apply(rows: DataFrame, kernel: str, id_col: str, value_col: str, out: str = "result", precision: str = "fp32") -> DataFrame:
    """(id, result, error): a failing row reports its error and the others go on."""
    model = _models[kernel]
    field = rows.schema[id_col]
    schema = T.StructType([field, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def one_size(x: np.ndarray) -> tuple[np.ndarray | None, str | None]:
        try:
            return np.asarray(loaded(model, precision)(x), float)[:, :], None
        except Exception as e:  # a kernel's own failure is data
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, whole = lists.flat(batch.column(1))
            length = np.diff(offsets)
            results: list[np.ndarray | None] = [None] * batch.num_rows
            errors: list[str | None] = [None if ok else "null input" for ok in whole.tolist()]
            for n in np.unique(length[whole]).tolist():
                at = np.flatnonzero(whole & (length == n))
                got, error = one_size(lists.rows_of(flat, offsets, at, n))
                if got is not None and len(got) == len(at):
                    for i, r in zip(at.tolist(), got, strict=True):
                        results[i] = r
                    continue
                for i in at.tolist():  # find the rows that fail
                    got, errors[i] = one_size(lists.rows_of(flat, offsets, np.array([i]), n))
                    results[i] = got[0] if got is not None else None
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.column(results), pa.array(errors, pa.string())], names=[id_col, out, "error"])

    return rows.select(id_col, A.doubles(F.col(value_col)).alias(value_col)).mapInArrow(run, schema)
