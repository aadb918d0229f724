"""Whitening of embeddings by principal components.

Entries become integers, so their sums over all rows are exact. Rows are centred on exact integers
(n x - S) before they become doubles; RowMatrix adds up their Gramian over the executors, and the
driver, which holds nothing but matrices of one vector's width, takes the eigenvectors. The
whitening matrix is broadcast and applied in mapInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches, materialize
from .vectors import matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Integers below this are added and multiplied as 64-bit numbers, others as Python's.
SAFE = 1 << 62


def usable(vector):
    """Whether a vector is not null and holds no null or non-finite entry."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def steps(rows: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry: 64-bit integers, or Python's where entries leave 2^53."""
    scaled = np.floor(rows * SCALE)
    if not scaled.size or np.abs(scaled).max() < 1 << 53:
        return scaled.astype(np.int64)
    return np.array([[min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in row] for row in np.clip(scaled, -1e19, 1e19)], object)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly. ``sums`` are of floor(64 c): the offset of x cancels."""
    y = steps(rows)
    largest = max([abs(int(y.max())), abs(int(y.min()))]) * n + max(map(abs, sums)) if y.size else 0
    if largest < SAFE and y.dtype != object:
        return y * n - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; null where it exceeds 64 bits."""
    most = int(max(abs(z.max()), abs(z.min()))) if z.size else 0
    if z.dtype != object and most * most * max(z.shape[1], 1) < SAFE:
        return (z * z).sum(1).tolist()
    out = [int((row * row).sum()) for row in z.astype(object)]
    return [x if x < 1 << 63 else None for x in out]


def _sums(df: DataFrame) -> tuple[int, list[int]]:
    """Rows, and sums of floor(64 c) by place; one row a batch and place leaves a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = steps(matrix(batch.column(0)))
                whole = y.dtype == object or np.abs(y).max(initial=0) * len(y) >= SAFE
                totals = y.astype(object).sum(0) if whole else y.sum(0)
                places = [-1, *range(y.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([str(int(t)) for t in (len(y), *totals)])], ["place", "total"])

    found = df.select("v").mapInArrow(add, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r.place: int(r.total) for r in found.collect()}  # as many rows as a vector has places
    return totals.pop(-1, 0), [totals[i] for i in range(len(totals))]


def _covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Gramian of a column of arrays, divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of all vectors without null or non-finite entries; others are dropped.

    With x = floor(64 c) + 1000000, n rows and sums S, returns for each row and component: ``key``,
    ``component`` (from 1, by falling eigenvalue of the covariance of x), ``n``, ``deviation`` (sum
    over places of (n x - S)^2, exact; null beyond 64 bits), ``whitened`` (x - S/n on the component's
    unit eigenvector, divided by the root of its eigenvalue), ``explained`` (eigenvalue over trace)
    and ``identity_error`` (largest absolute entry of the covariance of ``whitened`` minus identity).

    Vectors of different length compare as if padded with zeros. A component whose eigenvalue is
    nothing but rounding (repeated rows only, fewer rows than places) cannot be whitened: its
    ``whitened`` is null and it takes no part in ``identity_error``. Repeated rows are rows of their
    own; null keys stay. Tables that are empty or hold only empty vectors give an empty result.
    floor(64 c) saturates at 64 bits. Other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    n, sums = _sums(rows)
    kind = df.schema[key].dataType.simpleString()
    width, out = len(sums), f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], out)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = centred(_matrix(batch["v"], width), n, sums)
            yield pd.DataFrame({"k": batch["k"], "deviation": pd.array(deviations(z), "Int64"), "c": list((z / n).astype(float))})

    middle = rows.mapInPandas(centre, f"k {kind}, deviation long, c array<double>")
    covariance = _covariance(middle, "c", n)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    real = values > max(values[0], 0) * width * np.finfo(float).eps * 4
    weights = spark.sparkContext.broadcast(vectors[:, real] / np.sqrt(values[real]))  # a vector's width by at most ``components``

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "deviation": batch["deviation"].astype("Int64"), "w": list(_matrix(batch["c"], width) @ weights.value)})

    done = materialize(middle.mapInPandas(project, f"k {kind}, deviation long, w array<double>"), "whitened")
    count = int(real.sum())
    error = None
    if count:
        mean = np.array(done.agg(*(F.avg(F.col("w")[i]) for i in range(count))).first())
        error = float(np.abs(_covariance(done, "w", n) - np.outer(mean, mean) - np.eye(count)).max())
    trace = float(np.trace(covariance))
    shares = F.array(*(F.lit(float(e / trace) if trace > 0 else 0.0) for e in np.maximum(values, 0)))
    out_rows = done.select("k", "deviation", "w", F.posexplode(shares).alias("i", "explained"))
    return out_rows.select(
        F.col("k").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("i")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"),
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows.withColumn("vec_id", F.col("vec_id").cast("long")))
