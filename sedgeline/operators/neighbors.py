"""Nearest neighbors of stated queries by cosine, exact, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.scratch import stored

#: Queries compared at once; bounds what is broadcast.
QUERIES_A_BLOCK = 4096


def _matrix(column: pa.Array, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the vectors of a length that hold no null and aren't zero."""
    n = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    kept = np.flatnonzero(n == width)
    flat = column.take(pa.array(kept)).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return ids[kept][good], x[good] / norm[good, None]


def cosine_neighbors(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, neighbor_id, cosine): of each query the k rows nearest to it, rows of its own id left out.

    Queries are compared with the rows of their own length only, block by block, in any order with the same
    result. Each partition of rows keeps its k best for each query of a block, these are ranked again and
    written before the next block is read; ties go to smaller ids. Null and zero vectors, and such with nulls, are near nothing.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("width")).where("id is not null and width > 0")
    widths = sorted(r.width for r in asked.select("width").distinct().collect())  # the lengths of the queries' vectors
    out = None
    for width in widths:
        ids, vectors = [], []
        for r in asked.where(F.col("width") == width).toLocalIterator():
            ids.append(r.id)
            vectors.append(r.v)
            if len(ids) == QUERIES_A_BLOCK:
                part = _block(rows, ids, vectors, width, k, id_col, vector)
                out = part if out is None else out.unionByName(part)
                ids, vectors = [], []
        if ids:
            part = _block(rows, ids, vectors, width, k, id_col, vector)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id bigint, neighbor_id bigint, cosine double") if out is None else out


def _block(rows: DataFrame, ids: list[int], vectors: list, width: int, k: int, id_col: str, vector: str) -> DataFrame:
    """The neighbors of one block of queries, written."""
    own, q = _matrix(pa.array(vectors, type=pa.list_(pa.float64())), np.array(ids, np.int64), width)
    held = rows.sparkSession.sparkContext.broadcast((own, q))

    def run(batches):
        ids, q = held.value
        best_s, best_i = np.full((len(ids), 0), -2.0), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column(0)))
            others, x = _matrix(known.column(1), known.column(0).to_numpy(zero_copy_only=False), width)
            if not len(others) or not len(ids):
                continue
            s = q @ x.T
            s[np.equal.outer(ids, others)] = -2.0
            s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(others, s.shape)], 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        a, b = np.nonzero(best_s > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best_i[a, b]), pa.array(best_s[a, b])], names=["query_id", "neighbor_id", "cosine"])

    near = rows.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "query_id bigint, neighbor_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "neighbor_id")
    ranked = stored(near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), "neighbors")
    held.destroy()
    return ranked
