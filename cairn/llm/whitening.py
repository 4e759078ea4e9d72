"""Embedding whitening with block matrices: centred rows in distributed blocks, scatter by transposed multiplication, local eigenvectors, projection by multiplication.

Entries become whole numbers (``floor(256 * c)``), so that equal vectors are found exactly, and sums and deviations have no rounding. The fit list is every distinct
vector once. Its centred rows are a ``BlockMatrix``; transposed and multiplied with itself it gives the scatter matrix, width by width, which is small. The
multiplication is split along the rows, so that a task gets a few blocks. The driver knows the blocks' places, a pair of numbers for some thousands
of rows, and never the rows. All rows, copies as well, are then a second ``BlockMatrix`` that is multiplied with the whitening matrix.

Defined results: rows are left out if the vector is null, empty, or holds a null or non-finite entry or one whose whole number passes 2^53; and, as they fit no
covariance, rows of another width than most (the larger one of a tie). Null ids and repeated rows stay rows. Directions without variance (eigenvalue at most width * 2^-50
of the largest) have no component: equal vectors only give no rows, as does an empty table. Other columns are ignored. ``deviation`` is null if it passes 64 bits.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from .common import has, written

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 4096
BLOCK_COLUMNS = 256
#: Blocks of a task in a multiplication.
BLOCKS_A_TASK = 4
_LARGEST = float(2**53)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers): the rows that can be whitened."""
    has(vectors, "vec_id", "embedding")
    floors = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < _LARGEST))
    whole = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), floors.cast("array<long>").alias("x"))
    most = whole.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    return whole.join(F.broadcast(most.select("width")), F.size("x") == F.col("width"), "left_semi")


def numbered(rows: DataFrame, what: str) -> tuple[DataFrame, int]:
    """The rows with ``at``: 0, 1, 2 ... over all. From a table and the counts of its partitions, of which there are as many as tasks."""
    placed = written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth")), what)
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    starts, n = {}, 0
    for part, count in counts:
        starts[part] = n
        n += count
    first = rows.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    return placed.join(F.broadcast(first), "_part").select("*", (F.col("_start") + F.col("_nth")).alias("at")).drop("_part", "_nth", "_start"), n


def sums(fit: DataFrame) -> list[int]:
    got = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    return [int(r["s"]) for r in got.orderBy("k").collect()]


def _off(n: int, total: list[int]) -> Column:
    """``n * x - S``, exact."""
    s = F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in total])
    return F.zip_with("x", s, lambda x, y: (x.cast("decimal(19,0)") * F.lit(str(n)).cast("decimal(18,0)")).cast("decimal(38,0)") - y)


def deviation(n: int, total: list[int]) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    one = lambda d: d.try_cast("decimal(16,0)")  # noqa: E731  the square of any larger one passes 64 bits by itself
    return F.aggregate(_off(n, total), zero, lambda a, d: (a + one(d) * one(d)).cast("decimal(38,0)")).try_cast("long")


def blocks(rows: DataFrame, n: int, centre: list[float], count: int) -> BlockMatrix:
    """The centred rows (``at``, ``x``) as blocks."""
    middle = F.array(*[F.lit(c) for c in centre])
    centred = F.zip_with("x", middle, lambda x, c: x.cast("double") - c)
    frame = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector(centred).alias("row")), "row")
    return IndexedRowMatrix(frame, count, len(centre)).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left`` times ``right``; ``splits`` deals the sum over the middle dimension to so many tasks (an argument that Spark's Scala method has)."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The matrix transposed times itself, which is as large as a row is wide, squared."""
    splits = max(1, -(-m.numRowBlocks // BLOCKS_A_TASK))
    return product(m.transpose(), m, splits).toLocalMatrix().toArray()


def small(spark, m: np.ndarray) -> BlockMatrix:
    """A matrix that the driver holds, cut as the columns of ``blocks``."""
    wide = m.shape[1]
    cut = [((k, 0), Matrices.dense(len(p := m[at : at + BLOCK_COLUMNS]), wide, p.flatten(order="F"))) for k, at in enumerate(range(0, m.shape[0], BLOCK_COLUMNS))]
    return BlockMatrix(spark.sparkContext.parallelize(cut, 1), BLOCK_COLUMNS, wide, m.shape[0], wide)


def rows_of(m: BlockMatrix) -> DataFrame:
    """at, y (array of doubles)."""
    got = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return got.select(F.col("index").alias("at"), vector_to_array("vector").alias("y"))


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit vectors, as columns, without those of no variance."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > max(0.0, e.max(initial=0.0)) * len(e) * 2.0**-50]
    return e[order], u[:, order]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component."""
    spark = vectors.sparkSession
    rows, count = numbered(usable(vectors), "vectors")
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not count:
        return none
    fit, n = numbered(rows.select("x").distinct(), "distinct-vectors")
    total = sums(fit)
    centre = [float(Fraction(s, n)) for s in total]
    fitted = blocks(fit, n, centre, n)
    v = scatter(fitted) / n
    e, u = eigen(v, components)
    if not len(e):
        return none
    basis = small(spark, u / np.sqrt(e))
    spread = scatter(product(fitted, basis)) / n
    error = float(np.abs(spread - np.eye(len(e))).max())
    explained = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    found = rows_of(product(blocks(rows, n, centre, count), basis))
    told = rows.select("at", "vec_id", deviation(n, total).alias("deviation")).join(found, "at")
    each = told.select("vec_id", "deviation", F.posexplode("y").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
