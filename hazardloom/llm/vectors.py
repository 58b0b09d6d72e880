"""What the two vector searches share: which vectors take part, stacked arrays, work units and the final ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = 2.0**53  # doubles hold all integers up to here
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, vec as doubles), their number and dimension.

    Rows without id, null vectors, vectors with null or non-finite components, and vectors of another length than
    the most frequent one (of equally frequent lengths the smallest) are left out.
    """
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & whole & (F.size("vec") > 0)
    )
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (rows.where(F.size("vec") == top["dim"]), top["count"], top["dim"]) if top else (rows, 0, 0)


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``, one for each id."""
    return rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))


def stacked(table: pa.Table, column: str = "vec") -> np.ndarray:
    """A column of equally long lists as a matrix with a row for each."""
    if not table.num_rows:
        return np.zeros((0, 0))
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks]).reshape(table.num_rows, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows, exact; those beyond 64 bits are bound to them."""
    rough = q @ x.T
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return rough.astype(np.int64)
    wrap = [np.fmod(v, 2.0**64) for v in (q, x)]  # whole numbers modulo 2^64, whose products wrap to the right 64 bits
    a, b = [np.where(v < 0, v + 2.0**64, v).astype(np.uint64) if (np.abs(v) >= 2.0**63).any() else v.astype(np.int64).view(np.uint64) for v in wrap]
    exact = (a @ b.T).view(np.int64)
    return np.where(rough >= 2.0**63, HIGHEST, np.where(rough < -(2.0**63), LOWEST, exact))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's finds: query_id, rank, vec_id, score; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]
