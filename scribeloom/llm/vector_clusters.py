"""Centroid clustering over a vector approximation file.

Each component is also kept as the number of one of a few cells, so a vector has
a short approximation beside it. For a round, tables give the least and the
greatest squared difference from each centroid for each dimension and cell; their
sums over the dimensions are an interval for the distance to each centroid. What
the distances have in common, the distance to a point amid the centroids, is
taken off first, which makes the intervals narrower and leaves their order. If
the interval of one centroid ends before all others begin, the vector is decided.
Only for the others full vectors are fetched, and compared with the centroids
whose intervals overlap. All numbers are whole, and intervals that touch count as
overlapping, so clusters are those of a full search.

Centroids have a fixed size and travel with the tasks; a task adds up its
vectors by cluster, and Spark adds up the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeloom.llm.vectors import floor_mean, integers, matrix
from scribeloom.scale import materialize

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
DIM = 64
BITS = 6
SEED = 1

ACCURACY = 1000  # of the quantiles that cells end at
PAIRS = 1 << 16  # vectors and centroids compared at once

FILE = "vec_id long, values array<int>, cells binary"
FILE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("values", pa.list_(pa.int32())), ("cells", pa.binary())])
SUMS = "cluster int, n long, fetched long, sums array<long>"
FOUND = "vec_id long, cluster int, distance long"
FOUND_SCHEMA = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


class Grid(NamedTuple):
    """Cells of each dimension: dimension, cell. A value lies in cell c if
    low[c] <= value <= high[c]; the outer cells end at the extremes."""

    low: np.ndarray
    high: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.low[d, 1:], x[:, d], "right") for d in range(x.shape[1])], 1).astype(np.uint8)


def grid_of(rows: DataFrame, dim: int, bits: int) -> Grid:
    """Cells that hold about equal shares of the values of a dimension."""
    n = 1 << bits
    shares = [i / n for i in range(1, n)]
    value = lambda d: F.col("values")[d]
    found = rows.agg(*[
        f for d in range(dim)
        for f in (F.min(value(d)).alias(f"a{d}"), F.max(value(d)).alias(f"b{d}"), F.percentile_approx(value(d), shares, ACCURACY).alias(f"q{d}"))
    ]).first()  # one row of dim * (cells + 1) numbers
    low = np.array([[found[f"a{d}"], *found[f"q{d}"]] for d in range(dim)], np.int64)
    top = np.array([[found[f"b{d}"]] for d in range(dim)], np.int64)
    # A cell between equal quantiles holds nothing; its bounds meet.
    high = np.concatenate([np.maximum(low[:, 1:] - 1, low[:, :-1]), np.maximum(top, low[:, -1:])], 1)
    return Grid(low, high)


def pack_cells(cells: np.ndarray, bits: int) -> np.ndarray:
    """`bits` bits a cell, the high ones first, in dimension order."""
    return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(cells), -1), axis=1)


def unpack_cells(packed: np.ndarray, dim: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(packed, axis=1, count=dim * bits).reshape(len(packed), dim, bits)
    return np.packbits(np.concatenate([np.zeros((len(packed), dim, 8 - bits), np.uint8), flat], 2), axis=2)[:, :, 0]


def tables(grid: Grid, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared difference less that from a point amid the
    centroids: dimension, cell, centroid. It is linear in the component, so its
    bounds are at the ends of the cell."""
    amid = centroids.sum(0) // len(centroids)
    slope = 2 * (amid - centroids).T[:, None, :]
    rest = (centroids * centroids - amid * amid).T[:, None, :]
    ends = rest + slope * grid.low[:, :, None], rest + slope * grid.high[:, :, None]
    return np.minimum(*ends), np.maximum(*ends)


def nearest(x: Callable[[np.ndarray], np.ndarray], cells: np.ndarray, least: np.ndarray, most: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number on ties, and
    which vectors had to be fetched. `x` gives the full vectors of some rows."""
    n, k = len(cells), len(centroids)
    low, high = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    for d in range(cells.shape[1]):
        low += least[d][cells[:, d]]
        high += most[d][cells[:, d]]
    open_ = low <= high.min(1)[:, None]
    cluster = open_.argmax(1)
    fetched = np.flatnonzero(open_.sum(1) > 1)
    step = max(1, PAIRS // k)
    for a in range(0, len(fetched), step):
        rows = fetched[a : a + step]
        full = x(rows)
        row, at = np.nonzero(open_[rows])
        diff = full[row] - centroids[at]
        d = np.full((len(rows), k), np.iinfo(np.int64).max)
        d[row, at] = (diff * diff).sum(1)
        cluster[rows] = d.argmin(1)
    return cluster, fetched


def _write_cells(grid: Grid, dim: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pack_cells(grid.cells(matrix(batch.column("values"), dim)), bits)
            rows = [batch.column("vec_id"), batch.column("values"), pa.array([c.tobytes() for c in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows, FILE_SCHEMA)], schema=FILE_SCHEMA)

    return run


def _assigned(batch: pa.RecordBatch, dim: int, bits: int, least: np.ndarray, most: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(batch), -1)
    values = batch.column("values")
    fetch = lambda rows: matrix(values.take(pa.array(rows)), dim)
    return nearest(fetch, unpack_cells(packed, dim, bits), least, most, centroids)


def _sum_clusters(grid: Grid, dim: int, bits: int, centroids: np.ndarray) -> Callable:
    """Members, fetched members and sum of each cluster, one row for each
    cluster and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        least, most = tables(grid, centroids)
        n, fetched, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            cluster, rows = _assigned(batch, dim, bits, least, most, centroids)
            n += np.bincount(cluster, minlength=k)
            fetched += np.bincount(cluster[rows], minlength=k)
            np.add.at(sums, cluster, matrix(batch.column("values"), dim))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "fetched": pa.array(fetched[some]),
            "sums": pa.array(list(sums[some]), pa.list_(pa.int64())),
        })

    return run


def _distances(grid: Grid, dim: int, bits: int, centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = tables(grid, centroids)
        for batch in batches:
            cluster, _ = _assigned(batch, dim, bits, least, most, centroids)
            diff = matrix(batch.column("values"), dim) - centroids[cluster]
            columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array((diff * diff).sum(1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, FOUND_SCHEMA)], schema=FOUND_SCHEMA)

    return run


class Clusters(NamedTuple):
    rows: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray  # centroid, component
    fetched: list[int]  # full vectors compared in each round


def cluster(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    scale: int = SCALE, dim: int = DIM, bits: int = BITS, seed: int = SEED,
) -> Clusters:
    """The cluster of each vector of exactly `dim` components, none null or
    non-finite; components become floor(scale * x), within +-2**24.

    The first centroids are the k vectors of least SHA-256 of `seed:id`, fewer
    if there are fewer; vectors without an id come last, and vectors of one id
    in order of components. Rows that repeat are clustered one by one. A
    cluster without members keeps its centroid. No row at all gives none.
    """
    spark = rows.sparkSession
    whole = integers(rows.where(F.size(F.col(f"`{vector}`")) == dim), vector, scale, F.col(f"`{id_}`").cast("long").alias("vec_id"))
    whole = materialize(whole, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(F.asc_nulls_last(name), "vec_id", "values").limit(k).collect()  # k rows
    if not first:
        return Clusters(spark.createDataFrame([], FOUND), np.zeros((0, dim), np.int64), [])
    centroids = np.array([r["values"] for r in first], np.int64)
    grid = grid_of(whole, dim, bits)
    file = materialize(whole.mapInArrow(_write_cells(grid, dim, bits), FILE), "approximations")
    fetched = []
    for _ in range(rounds):
        partial = file.select("values", "cells").mapInArrow(_sum_clusters(grid, dim, bits, centroids), SUMS)
        total = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dim)]
        found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("fetched").alias("fetched"), *total).collect()  # k rows
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for r in found:
            n[r["cluster"]] = r["n"]
            sums[r["cluster"]] = [r[f"s{d}"] for d in range(dim)]
        centroids = floor_mean(sums, n, centroids)
        fetched.append(sum(r["fetched"] for r in found))
    return Clusters(file.mapInArrow(_distances(grid, dim, bits, centroids), FOUND), centroids, fetched)


def op13(rows: DataFrame) -> DataFrame:
    """The digest of every vector: vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256. A sum that no long can hold is null."""
    found = cluster(rows)
    spark = rows.sparkSession
    each = materialize(found.rows, "clusters")
    parts = each.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()  # a row for each centroid
    sums = {r["cluster"]: r["s"] for r in parts}
    total = None if None in sums.values() or sum(sums.values()) >> 63 else sum(sums.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    known = [(c, s, total, sha[c]) for c, s in sums.items()]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(table), "cluster").select(  # no more rows than centroids
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_sql(k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> str:
    """The same by full search."""
    ctes = [f"""kept AS (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT vec_id, unnest(generate_series(1, {dim})) AS j, unnest(v) AS x FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS e FROM kept ORDER BY e LIMIT {k}),
b0 AS (SELECT e, j, x AS c FROM cells JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""d{r} AS (SELECT vec_id, e, sum((x - c) * (x - c))::BIGINT AS d FROM cells JOIN b{r} USING (j) GROUP BY ALL),
a{r} AS (SELECT vec_id, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            ctes.append(f"""m{r} AS (SELECT e, j, floor(sum(x) / count(*))::BIGINT AS c FROM a{r} JOIN cells USING (vec_id) GROUP BY ALL),
b{r + 1} AS (SELECT e, j, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (e, j))""")
    return "WITH " + ",\n".join(ctes) + f""",
named AS (SELECT e, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM b{rounds} GROUP BY e)
SELECT vec_id, e::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY e))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (e)"""


OP13_SQL = op13_sql()
