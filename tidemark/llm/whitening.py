"""Whitening of embeddings by a covariance that is made in tiles.

Entries c become whole numbers x = floor(64 c) + 1000000. The fit list is every usable vector, nothing is sampled.

*Covariance.* Tasks sum each dimension exactly. Then the centred rows are cut into row-blocks (at most ``ROWS``
consecutive rows of a task) and each row-block into column blocks of ``TILE`` dimensions. A pair of column
blocks is the key of a tile of the covariance. The column blocks are shuffled by row-block; a task that has all of a
row-block multiplies its pairs of column blocks and adds each product to the tile's sum; the sums of all
tasks are added per tile and assembled. No task holds more than one row-block and the tiles of d x d numbers; the
driver holds the tiles alone, whatever the number of rows.

*Whitening.* The eigenvectors of the assembled matrix are numbered by falling eigenvalue; the sign is that which
makes the entry of largest magnitude positive. A centred row's projection over the root of the eigenvalue
is ``whitened``. The same tiles, made of the whitened rows, say how far their covariance is from the identity.

Not usable, hence in no result: a null vector, one with a null or non-finite entry or one of 2^46 or more in
magnitude (its x would not be exact), an empty one, and one whose length is not the commonest (the longest of equally common
ones). Components whose eigenvalue is not above ``NO_VARIANCE`` times the largest do not vary and are left out, so equal
vectors, a single one or an empty table give no rows. Repeated rows count and come back as often as they stand; a null vec_id
stays null. ``deviation`` is null where it does not fit 64 bits. Vectors may have at most ``MOST_DIMS``
dimensions (an error says so). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import n_partitions

#: Dimensions of a column block, rows of a row-block.
TILE, ROWS = 32, 4096
COMPONENTS, MOST_DIMS = 32, 4096
NO_VARIANCE = 1e-12
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**46

PIECE = "row_block long, column_block int, piece binary"
TILES = "one int, other int, tile binary"
_TILES = pa.schema([("one", pa.int32()), ("other", pa.int32()), ("tile", pa.binary())])


class Vectors(NamedTuple):
    """Rows with ``embedding`` (array of double, all of ``dims`` entries)."""

    rows: DataFrame
    dims: int


class Covariance(NamedTuple):
    n: int
    sums: np.ndarray
    matrix: np.ndarray


class Whitening(NamedTuple):
    fit: Covariance
    vectors: np.ndarray  # one component a column
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.fit.sums, self.fit.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - sum)^2, in whole numbers; null where it does not fit."""
        about = ((centred(x, self.fit.sums, self.fit.n) * self.fit.n) ** 2).sum(1)
        exact = ((x * np.int64(self.fit.n) - self.fit.sums) ** 2).sum(1)
        return pa.array(exact, mask=about > 9.2e18)


def usable(embeddings: DataFrame) -> Vectors:
    """The usable rows of ``embeddings`` (vec_id, embedding)."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))) & (F.size("embedding") > 0))  # NaN is above all numbers
    length = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = length["dims"] if length else 0
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MOST_DIMS}")
    return Vectors(rows.where(F.size("embedding") == dims), dims)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n; of whole numbers the whole part is taken off exactly first."""
    if x.dtype == np.int64:
        return (x - sums // n) - (sums % n) / n
    return x - sums / n


def column_sums(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], dims: int, kind: type) -> tuple[int, np.ndarray]:
    """How many rows there are and the sum of each column of ``values``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, kind)
        for batch in batches:
            if len(batch):
                x = values(batch)
                n, total = n + len(x), total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total)], names=["dim", "n", "total"])

    found = rows.mapInArrow(add, f"dim int, n long, total {'long' if kind is np.int64 else 'double'}").groupBy("dim").agg(F.sum("n"), F.sum("total")).collect()
    sums, n = np.zeros(dims, kind), 0
    for dim, n, total in found:
        sums[dim] = total
    return n, sums


def covariance(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], dims: int, kind: type = np.float64, tile: int = TILE, block_rows: int = ROWS) -> Covariance:
    """Covariance (divisor n) of the columns of ``values`` over all ``rows``, by tiles."""
    n, sums = column_sums(rows, values, dims, kind)
    if not n:
        return Covariance(0, sums, np.zeros((dims, dims)))
    edges = list(range(0, dims, tile)) + [dims]
    blocks = len(edges) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                x = centred(values(batch.slice(at, block_rows)), sums, n)
                pieces = [x[:, a:b].astype("<f8").tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([row_block] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array(pieces, pa.binary())], names=["row_block", "column_block", "piece"])
                row_block += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sum_of: dict[tuple[int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for column_block, piece in zip(batch.column("column_block").to_pylist(), batch.column("piece")):
                held.append(np.frombuffer(piece.as_buffer(), "<f8").reshape(-1, edges[column_block + 1] - edges[column_block]))
                if column_block == blocks - 1:  # the last of its row-block
                    for i in range(blocks):
                        for j in range(i, blocks):
                            product = held[i].T @ held[j]
                            sum_of[i, j] = sum_of[i, j] + product if (i, j) in sum_of else product
                    held = []
        columns = [[i for i, _ in sum_of], [j for _, j in sum_of], [t.astype("<f8").tobytes() for t in sum_of.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TILES)], schema=_TILES)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t.as_buffer(), "<f8") for t in table["tile"])
        return table.slice(0, 1).set_column(2, "tile", pa.array([total.astype("<f8").tobytes()], pa.binary()))

    dealt = rows.mapInArrow(cut, PIECE).repartition(n_partitions(rows.sparkSession), "row_block").sortWithinPartitions("row_block", "column_block")
    matrix = np.zeros((dims, dims))
    for i, j, t in dealt.mapInArrow(multiply, TILES).groupBy("one", "other").applyInArrow(add, TILES).toLocalIterator():
        own, other = slice(edges[i], edges[i + 1]), slice(edges[j], edges[j + 1])
        matrix[own, other] = np.frombuffer(t, "<f8").reshape(edges[i + 1] - edges[i], -1)
        matrix[other, own] = matrix[own, other].T
    return Covariance(n, sums, matrix / n)


def fitted(vectors: Vectors, components: int = COMPONENTS, tile: int = TILE, block_rows: int = ROWS) -> Whitening:
    fit = covariance(vectors.rows, numbers, vectors.dims, np.int64, tile, block_rows)
    values, directions = np.linalg.eigh(fit.matrix) if vectors.dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    order = [i for i in order[:components] if values[i] > max(0.0, NO_VARIANCE * values[order[0]])]
    directions, values = directions[:, order], values[order]
    if len(order):
        directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(len(order))])
    return Whitening(fit, directions, values, values / np.trace(fit.matrix) if len(order) else values)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, tile: int = TILE, block_rows: int = ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    vectors = usable(embeddings)
    model = fitted(vectors, components, tile, block_rows)
    shared, k = vectors.rows.sparkSession.sparkContext.broadcast(model), len(model.values)
    error = np.abs(covariance(vectors.rows, lambda b: shared.value.project(numbers(b)), k, np.float64, tile, block_rows).matrix - np.eye(k)).max() if k else 0.0
    n, explained = model.fit.n, model.explained

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch) if k else 0, block_rows):
                rows = batch.slice(at, block_rows)
                x = numbers(rows)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), shared.value.deviations(x).take(each),
                        pa.array(shared.value.project(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return vectors.rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
