"""Histogram edges and binned rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import col
from .quantiles import cuts_between

# The default; a byte holds up to ``MOST_BINS`` beside the mark of a missing value.
MAX_BINS = 64
MOST_BINS = 255


def bin_edges(df: DataFrame, features: Sequence[str], label: str | None = None, max_bins: int = MAX_BINS) -> dict[str, list[float]]:
    """Up to ``max_bins - 1`` edges per feature, halfway between neighbouring values.

    Few-valued features get an edge between all values, others at exact quantiles of all rows that have a
    ``label``: the same rule at every size.  Quantiles come from radix selection, so neither the shuffle nor
    the driver sees the distinct values.
    """
    if not 2 <= max_bins <= MOST_BINS:
        raise ValueError(f"max_bins must be from 2 to {MOST_BINS}")
    if not features:
        return {}
    rows = df if label is None else df.where(col(label).isNotNull())
    found = {name: sorted({(a + b) / 2 for a, b in pairs}) for name, pairs in cuts_between(rows, features, max_bins).items()}
    assert all(len(e) < max_bins for e in found.values())
    return found


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns of a batch as doubles, one row per record, NULL as NaN."""
    if not names:
        return np.empty((batch.num_rows, 0))
    columns = [batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in names]
    return np.column_stack(columns)


def packed(array: pa.Array, dtype, rows: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix, without copying values one by one."""
    if not rows:
        return np.empty((0, 0), dtype)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + rows + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(rows, -1)


def pack(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    rows = len(values)
    data = np.ascontiguousarray(values).view(np.uint8).reshape(rows, -1)
    offsets = np.arange(rows + 1, dtype=np.int32) * data.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def binned(
    df: DataFrame,
    features: Sequence[str],
    edges: Mapping[str, Sequence[float]],
    row_id: str,
    label: str,
    fold: str | None,
    max_bins: int = MAX_BINS,
) -> DataFrame:
    """Training rows: id hash, label, fold, one byte per feature.

    The byte counts the edges at or below the value; ``max_bins`` marks a missing value.
    """
    features = list(features)
    renamed = {name: f"x{i}" for i, name in enumerate(features)}
    source = df.where(F.col(label).isNotNull()).select(
        F.xxhash64(row_id).alias("key"),
        F.col(label).cast("int").alias("y"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
        *[col(name).cast("double").alias(short) for name, short in renamed.items()],
    )
    cuts = [np.asarray(edges[name], np.float64) for name in features]
    names = list(renamed.values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch, names)
            codes = np.empty(values.shape, np.uint8)
            for j, edge in enumerate(cuts):
                codes[:, j] = np.searchsorted(edge, values[:, j], side="right")
            codes[np.isnan(values)] = max_bins
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("y"), batch.column("fold"), pack(codes)],
                    names=["key", "y", "fold", "bins"],
                )

    return source.mapInArrow(encode, "key bigint, y int, fold int, bins binary")


BLOCK_FIELDS = {"key": np.int64, "y": np.int32, "fold": np.int32, "bins": np.uint8, "margin": np.float64}
BLOCK_SCHEMA = ", ".join(f"{name} binary" for name in BLOCK_FIELDS)


# Rows of one block at most; sums over a block count on it.
BLOCK_ROWS = 1 << 15


def block(*parts: np.ndarray, fields: Mapping[str, type] = BLOCK_FIELDS) -> pa.RecordBatch:
    """The rows of one block as one record of byte strings."""
    arrays = [pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in zip(parts, fields.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def unpacked(batches: Iterator[pa.RecordBatch], fields: Mapping[str, type]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in fields.items())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Block by block: keys, labels, folds, bins by (feature, row) and margins by (model, row)."""
    for key, y, fold, bins, margin in unpacked(batches, BLOCK_FIELDS):
        yield key, y, fold, bins.reshape(-1, len(y)), margin.reshape(-1, len(y))


def blocked(rows: DataFrame, models: int, keyed: bool = True, folded: bool = True) -> DataFrame:
    """Binned rows with a margin of zero per model, a block of them in one record: a pass then moves bytes, not rows.

    Keys and folds that nothing reads may be left out.
    """

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches(BLOCK_ROWS):
            n = batch.num_rows
            key, y, fold = (batch.column(name).to_numpy() for name in ("key", "y", "fold"))
            yield block(key if keyed else key[:0], y, fold if folded else fold[:0], packed(batch.column("bins"), np.uint8, n).T, np.zeros((models, n)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= BLOCK_ROWS:
                yield from whole(held)
                held, waiting = [], 0
        if held:
            yield from whole(held)

    return rows.mapInArrow(gather, BLOCK_SCHEMA)
