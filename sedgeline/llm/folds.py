"""Sums of large arrays over partitions, merged slice by slice."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix that travel together, and into how many groups partial sums are first added up.
SLICE_ROWS, FIRST_SUMS = 1024, 64
#: Partial matrices at most, so that they stay a small part of what is read: each is of a task of its own,
#: and a table of more partitions is read by tasks of several.
MOST_PARTS = 4096


def total(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int], dtype=np.float64) -> np.ndarray:
    """The sum over partitions of partial(batches), a matrix of a fixed shape.

    Tasks are those of the table's scan. Each partial matrix is cut into slices; slices are added
    up in groups, then the groups' sums, and the sum, of known size, comes to the driver.
    """
    width, schema = shape[1], "k bigint, grp int, part binary"

    def run(batches):
        whole = partial(batches)
        group = os.getpid() % FIRST_SUMS
        for k in range(0, shape[0], SLICE_ROWS):
            part = whole[k : k + SLICE_ROWS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int64()), pa.array([group], type=pa.int32()), pa.array([part.astype(dtype).tobytes()], type=pa.binary())], names=["k", "grp", "part"])

    def merge(batches):
        at, whole = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], type=pa.int64()), pa.array([at[1]], type=pa.int32()), pa.array([whole.astype(dtype).tobytes()], type=pa.binary())], names=["k", "grp", "part"])
        for batch in batches:
            for k, group, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw, dtype).astype(np.float64)
                if (k, group) != at:
                    if at is not None:
                        yield out()
                    at, whole = (k, group), part
                else:
                    whole = whole + part
        if at is not None:
            yield out()

    parts = df.rdd.getNumPartitions()
    few = df.coalesce(MOST_PARTS) if parts > MOST_PARTS else df
    sums = few.mapInArrow(run, schema)
    if parts > FIRST_SUMS:  # else one level has as few
        sums = sums.repartition("k", "grp").sortWithinPartitions("k", "grp").mapInArrow(merge, schema)
    merged = sums.withColumn("grp", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(merge, schema)
    result = np.zeros(shape)
    for row in merged.toLocalIterator():
        part = np.frombuffer(bytes(row.part), dtype).reshape(-1, width)
        result[row.k : row.k + len(part)] = part
    return result
