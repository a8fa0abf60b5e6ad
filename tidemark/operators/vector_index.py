"""Cosine search in blocks: exact, and by an inverted file of cells.

Rows and queries meet in blocks: both are dealt into blocks of at most about ``BLOCK`` within their cell, a block of
rows and one of queries is one group, and its scores are one matrix product of which the best ``k`` of each query go on.
The exact search is that of one cell. The inverted file has the cells of a k-means fit on a
sample (at most ``SAMPLE`` vectors, those of the smallest hash of their id; the fit is Spark's own); every row
is assigned to the nearest centre, and a query meets the rows of its ``probes`` nearest cells only. Scores are those of
the vectors themselves, so what is found is ranked exactly. Payload conditions are filters before the
blocks are made, so they reach the scan.

Scores are rounded to 9 places for order; equal ones go by id. A null vector, an empty one, one with a null or a
number that is not finite, and one without a direction (all zeros) is neither found nor finds anything. Vectors and
queries of different lengths do not meet. Repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SAMPLE = 2048, 100_000
#: All pairs: how many blocks a block meets before blocks grow, and the most numbers of one.
MEETINGS, WIDEST = 24, 2**21


class Cells(NamedTuple):
    """``rows`` are all searchable vectors with their ``cell``; ``centres`` have length 1."""

    rows: DataFrame
    centres: np.ndarray


def unit(vector: str | Column) -> Column:
    """The vector over its length, as doubles; null where it has none."""
    x = F.col(vector) if isinstance(vector, str) else vector
    x = x.cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (length > 0), F.transform(x, lambda v: v / length))


def searchable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The rows with ``_x``, their unit vector, where there is one."""
    return vectors.withColumn("_x", unit(column)).where("_x is not null")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def in_blocks(rows: DataFrame, queries: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = BLOCK) -> DataFrame:
    """``score`` of each block of ``rows`` with each block of ``queries`` of the same ``cell`` (both have cell, id and _x).

    A cell of any size is many groups: the numbers of rows and queries of each cell say into how many blocks they are dealt.
    """
    blocks = lambda side, name: side.groupBy("cell", F.size("_x").alias("dims")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    n = blocks(rows, "n_rows").join(blocks(queries, "n_queries"), ["cell", "dims"])

    def dealt(side: DataFrame, own: str, other: str, b: str, c: str) -> DataFrame:
        known = side.select([F.col(c).alias(c) for c in side.columns]).withColumn("dims", F.size("_x")).join(n, ["cell", "dims"])
        return known.withColumn(b, F.pmod(F.xxhash64("id", "_x"), F.col(own)).cast("int")).withColumn(c, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("n_rows", "n_queries")

    by = ["cell", "dims", "block", "chunk"]
    left, right = dealt(rows, "n_rows", "n_queries", "block", "chunk"), dealt(queries, "n_queries", "n_rows", "chunk", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)


def best_of_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``k`` largest of each row, by their value rounded to 9 places and then by column. Only what reaches the k-th largest is sorted."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        query, at = np.nonzero(score >= least[:, None] - 2e-9)  # all that may round to the k-th or more
    else:
        query, at = (x.reshape(-1) for x in np.indices(score.shape))
    value = np.round(score[query, at], 9)
    order = np.lexsort((at, -value, query))
    query, at, value = query[order], at[order], value[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], at[kept], value[kept]


def _best_of(k: int, threshold: float, row_type: pa.DataType, query_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["query_id", "vec_id", "score"]

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (query_type, row_type, pa.float64())], names)
        rows = rows.sort_by("id")
        query, at, value = best_of_rows(matrix(queries["_x"]) @ matrix(rows["_x"]).T, k)  # of equal scores the smaller id first
        good = value >= threshold
        query, at, value = query[good], at[good], value[good]
        return pa.table([queries["id"].combine_chunks().take(pa.array(query)), rows["id"].combine_chunks().take(pa.array(at)), pa.array(value)], names)

    return best


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _types(rows: DataFrame, queries: DataFrame) -> tuple[str, pa.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    row, query = (d.schema["id"].dataType for d in (rows, queries))
    return f"query_id {query.simpleString()}, vec_id {row.simpleString()}, score double", to_arrow_type(row), to_arrow_type(query)


def matching(vectors: DataFrame, payload: dict[str, object] | None) -> DataFrame:
    for column, value in (payload or {}).items():
        vectors = vectors.where(F.col(column) == value)
    return vectors


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = -1.0, payload: dict[str, object] | None = None, size: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: for each query (query_id, query) the ``k`` vectors of the largest cosine, at least ``threshold``, of those with the payload."""
    rows = searchable(matching(vectors, payload)).select(F.lit(0).alias("cell"), F.col("vec_id").alias("id"), "_x")
    asked = searchable(queries, "query_id", "query").select(F.lit(0).alias("cell"), F.col("query_id").alias("id"), "_x")
    schema, row, query = _types(rows, asked)
    return _ranked(in_blocks(rows, asked, _best_of(k, threshold, row, query), schema, size), k).select("query_id", "vec_id", "score", "rank")


def cells(vectors: DataFrame, n_cells: int, sample: int = SAMPLE, seed: int = 42) -> Cells:
    """Fit the centres on a sample and assign every searchable row. Rows of another length than the sample's commonest get no cell and are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = searchable(vectors)
    few = rows.select(F.xxhash64("vec_id").alias("h"), "_x").orderBy("h").limit(sample)
    dims = few.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return Cells(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)))
    found = KMeans(featuresCol="v", k=n_cells, seed=seed, maxIter=15).fit(few.where(F.size("_x") == dims["d"]).select(array_to_vector("_x").alias("v"))).clusterCenters()
    centres = np.array(found)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return Cells(_near(rows.where(F.size("_x") == dims["d"]), centres, 1).select(*vectors.columns, "_x", F.explode("cells").alias("cell")), centres)


def _near(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """With ``cells``: the numbers of the ``n`` nearest centres, the nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(-(matrix(batch.column("_x")) @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(range(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "cells"])

    from pyspark.sql import types as T

    return rows.mapInArrow(nearest, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def probed_top_k(index: Cells, queries: DataFrame, k: int = 10, probes: int = 8, threshold: float = -1.0, payload: dict[str, object] | None = None, size: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank, n_read: as the exact search, of the rows of the ``probes`` nearest cells; n_read rows with the payload are in these."""
    rows = matching(index.rows, payload).select("cell", F.col("vec_id").alias("id"), "_x")
    asked = searchable(queries, "query_id", "query").where(F.size("_x") == index.centres.shape[-1])
    asked = _near(asked.select(F.col("query_id").alias("id"), "_x"), index.centres, probes).select(F.explode("cells").alias("cell"), "id", "_x")
    schema, row, query = _types(rows, asked)
    read = asked.join(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell").groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("n_read"))
    return _ranked(in_blocks(rows, asked, _best_of(k, threshold, row, query), schema, size), k).join(read, "query_id").select("query_id", "vec_id", "score", "rank", "n_read")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, n_hit, recall: how many of the exact results of each query were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    done = hits.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_hit"))
    return done.withColumn("recall", F.col("n_hit") / F.col("n_exact"))


def alike(vectors: DataFrame, threshold: float, size: int = BLOCK, same: str | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of at least ``threshold``, with ``known`` whether they have the same value of the column ``same``, if given (a null has not).

    Two blocks meet once. There are blocks of ``size`` rows until these are ``MEETINGS``, then larger ones up to ``WIDEST`` numbers,
    so each vector is shuffled ``MEETINGS`` times, as it came; a task scores ``size`` times ``size`` pairs at once. The pairs themselves are as many as there are.
    """
    kind = vectors.schema["embedding"].dataType
    given = F.col("embedding") if kind.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    tag = F.lit(None).cast("int") if same is None else F.col(same)
    rows = vectors.where(unit("embedding").isNotNull()).select(F.col("vec_id").alias("id"), given.alias("_x"), tag.alias("_tag"), F.size("embedding").alias("dims"))
    most = F.greatest(F.lit(size), F.floor(F.lit(WIDEST) / F.col("dims")))
    n = rows.groupBy("dims").agg(F.count("*").alias("_rows")).select("dims", F.greatest(F.ceil(F.col("_rows") / most), F.least(F.ceil(F.col("_rows") / size), F.lit(MEETINGS))).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(n), "dims").withColumn("own", F.pmod(F.xxhash64("id", "_x"), F.col("n")).cast("int")).withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = dealt.select("id", "_x", "_tag", "dims", "own", F.least("own", "_met").alias("i"), F.greatest("own", "_met").alias("j"))
    id_type, names = rows.schema["id"].dataType.simpleString(), ["a", "b", "cosine", *(["known"] if same else [])]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches).combine_chunks()
        x = matrix(found["_x"]).astype(np.float64)
        x /= np.sqrt(np.sum(x * x, axis=1, keepdims=True))
        ids, tags, own, i, j = found["id"].combine_chunks(), found["_tag"].combine_chunks(), found["own"].to_numpy(), found["i"][0].as_py(), found["j"][0].as_py()
        one, other = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for p in range(0, len(one), size):
            for q in range(p if i == j else 0, len(other), size):
                at, to = np.nonzero(x[one[p : p + size]] @ x[other[q : q + size]].T >= threshold)
                at, to = one[p : p + size][at], other[q : q + size][to]
                if i != j or p != q:  # a square with itself has each pair both ways
                    turned = pc.greater(ids.take(pa.array(at)), ids.take(pa.array(to))).to_numpy(zero_copy_only=False)
                    at, to = np.where(turned, to, at), np.where(turned, at, to)
                kept = pc.less(ids.take(pa.array(at)), ids.take(pa.array(to))).to_numpy(zero_copy_only=False).astype(bool)
                at, to = at[kept], to[kept]
                if len(at):
                    left, right = pa.array(at), pa.array(to)
                    columns = [ids.take(left), ids.take(right), pa.array(np.einsum("ij,ij->i", x[at], x[to]))]
                    if same:
                        columns.append(pc.fill_null(pc.equal(tags.take(left), tags.take(right)), False))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.groupBy("dims", "i", "j").applyInArrow(near, f"a {id_type}, b {id_type}, cosine double" + (", known boolean" if same else ""))
