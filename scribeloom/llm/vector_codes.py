"""Vector codes: each part of a vector becomes the index of its nearest entry,
found by ball k-means.

An entry and its parts form a ball around the entry. Only entries whose distance
is at most twice the ball's radius are its neighbours; no part of the ball
can be nearer to another. Parts in the stable core, nearer to their entry than
half the way to the nearest neighbour, are not looked at again. The others lie in
rings around the entry, and a part in the n-th ring is compared with the first n
neighbours only. A ball that stands still, with neighbours that stand still, has
no rings at all. All comparisons are of squared distances in whole numbers, and
those that tie are made, so the codes are those of a full search.

Codebooks have a fixed size and travel with the tasks; sums over the parts of an
entry are made in the tasks and added up by Spark.
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
from scribeloom.scale import find_hot, materialize, skew_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

FAR = np.iinfo(np.int64).max
ROWS = 4096  # vectors searched in full at once

CODED_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.int64()), ("values", pa.list_(pa.int32())), ("codes", pa.binary()), ("error", pa.int64()),
])
CODED = "vec_id long, label long, values array<int>, codes binary, error long"
SUMS = "part int, entry int, n long, far long, sums array<long>"


class Balls(NamedTuple):
    """Entries of all parts, and the neighbours of each entry by distance.

    entries: part, entry, component. near, gaps: part, entry, place; a place
    without a neighbour has the gap FAR.
    """

    entries: np.ndarray
    near: np.ndarray
    gaps: np.ndarray


def balls_of(entries: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Balls:
    """radius: a bound on the squared radius of each ball; moved: whether the
    entry changed since its parts were assigned."""
    step = entries[:, :, None, :] - entries[:, None, :, :]
    gaps = (step * step).sum(3)
    n = entries.shape[1]
    gaps[:, np.arange(n), np.arange(n)] = FAR
    gaps[gaps > 4 * radius[:, :, None]] = FAR
    neighbour_moved = ((gaps < FAR) & moved[:, None, :]).any(2)
    gaps[~(moved | neighbour_moved)] = FAR
    near = np.argsort(gaps, axis=2, kind="stable")
    return Balls(entries, near, np.take_along_axis(gaps, near, 2))


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, the lower index on ties, and its squared distance."""
    code, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        step = x[a : a + ROWS, None, :] - entries[None]
        d = (step * step).sum(2)
        code[a : a + ROWS] = d.argmin(1)
        best[a : a + ROWS] = d.min(1)
    return code, best


def ring_search(x: np.ndarray, own: np.ndarray, entries: np.ndarray, near: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the codes of the round before, ring by ring, and the
    number of comparisons made."""
    step = x - entries[own]
    best = (step * step).sum(1)
    reach, code, compared = 4 * best, own.copy(), 0
    rest = np.arange(len(x))
    for place in range(near.shape[1]):
        gap = gaps[own[rest], place]
        rest = rest[(gap <= reach[rest]) & (gap < FAR)]  # parts of this ring and those outside it
        if not len(rest):
            break
        rival = near[own[rest], place]
        step = x[rest] - entries[rival]
        d = (step * step).sum(1)
        compared += len(rest)
        better = (d < best[rest]) | ((d == best[rest]) & (rival < code[rest]))
        hit = rest[better]
        best[hit], code[hit] = d[better], rival[better]
    return code, best, compared


def _assign(dim: int, parts: int, entries: np.ndarray, balls: Balls | None) -> Callable:
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("values"), dim)
            old = None if balls is None else np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                piece = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                if balls is None:
                    code, best = full_search(piece, entries[p])
                else:
                    code, best, _ = ring_search(piece, old[:, p].astype(np.int64), balls.entries[p], balls.near[p], balls.gaps[p])
                codes[:, p] = code
                error += best
            rows = [batch.column("vec_id"), batch.column("label"), batch.column("values"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows, CODED_SCHEMA)], schema=CODED_SCHEMA)

    return run


def _sum_parts(dim: int, parts: int, entries: np.ndarray) -> Callable:
    """Members, sum and greatest squared distance of each entry, one row for
    each entry and task at most."""
    width, k = dim // parts, entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros((parts, k), np.int64), np.zeros((parts, k), np.int64)
        sums = np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = matrix(batch.column("values"), dim)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                piece, own = x[:, p * width : (p + 1) * width], codes[:, p]
                n[p] += np.bincount(own, minlength=k)
                np.add.at(sums[p], own, piece)
                step = piece - entries[p][own]
                np.maximum.at(far[p], own, (step * step).sum(1))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(n[part, entry]),
            "far": pa.array(far[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        })

    return run


def _first_vectors(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the n smallest ids, null last; of rows that share an id
    the least one. At most n rows are fetched at a time."""
    found: dict = {}
    rest = rows.select("vec_id", "values")
    while True:
        top = rest.orderBy(F.asc_nulls_last("vec_id"), "values").limit(n).collect()
        for r in top:
            found.setdefault(r["vec_id"], r["values"])
        last = top[-1]["vec_id"] if top else None
        if len(top) < n or len(found) >= n or last is None:
            return list(found.values())[:n]
        rest = rows.select("vec_id", "values").where((F.col("vec_id") > last) | F.col("vec_id").isNull())


class Codes(NamedTuple):
    rows: DataFrame  # vec_id, label, values, codes (a byte for each part), error
    entries: np.ndarray  # part, entry, component


def encode(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Codes and codebooks of all vectors.

    Components become floor(scale * x), within +-2**24. Rows whose vector is
    null, empty or holds null or non-finite components are left out, as are
    vectors that cannot be cut into `parts` equal parts or are not as long as
    the one of the smallest id. The codebook starts with the `n_entries` (256
    at most) smallest ids, fewer if there are fewer; null counts as the
    greatest id, and of rows that share an id the least vector is taken. Rows
    that repeat are coded one by one. No row at all gives no codes.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("an index takes a byte: 1 to 256 entries")
    whole = integers(rows, vector, scale, F.col(f"`{id_}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"))
    whole = materialize(whole.where((F.size("values") > 0) & (F.size("values") % parts == 0)), "vectors")
    spark = rows.sparkSession
    lead = whole.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.size("values").alias("dim"))).alias("m")).first()["m"]
    if lead is None:
        return Codes(spark.createDataFrame([], CODED), np.zeros((parts, 0, 0), np.int64))
    dim = lead["dim"]
    whole = whole.where(F.size("values") == dim)
    first = np.array(_first_vectors(whole, n_entries), np.int64)
    entries = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).swapaxes(0, 1))
    coded = materialize(whole.mapInArrow(_assign(dim, parts, entries, None), CODED), "codes")
    for _ in range(rounds):
        entries, balls = _update(coded, dim, parts, entries)
        coded = materialize(coded.mapInArrow(_assign(dim, parts, entries, balls), CODED), "codes")
    return Codes(coded, entries)


def _update(coded: DataFrame, dim: int, parts: int, entries: np.ndarray) -> tuple[np.ndarray, Balls]:
    """New entries, and their balls. A radius is bounded by the old one and the
    way that the entry went."""
    partial = coded.select("values", "codes").mapInArrow(_sum_parts(dim, parts, entries), SUMS)
    width = dim // parts
    total = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *total).collect()  # parts x entries rows
    n, far = (np.zeros(entries.shape[:2], np.int64) for _ in range(2))
    sums = np.zeros(entries.shape, np.int64)
    for r in found:
        n[r["part"], r["entry"]], far[r["part"], r["entry"]] = r["n"], r["far"]
        sums[r["part"], r["entry"]] = [r[f"s{j}"] for j in range(width)]
    new = np.stack([floor_mean(sums[p], n[p], entries[p]) for p in range(parts)])
    went = ((new - entries) ** 2).sum(2)
    radius = np.ceil((np.sqrt(far.astype(float)) + np.sqrt(went.astype(float))) ** 2 * (1 + 1e-9) + 1).astype(np.int64)
    return new, balls_of(new, radius, went > 0)


def codebooks_sha256(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def op12(rows: DataFrame) -> DataFrame:
    """The digest of every vector: vec_id, code, error, label_error, codebooks_sha256."""
    found = encode(rows)
    each = found.rows.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("label")
    )
    key = ["no_label", "label"]
    # Stored, so that its size is known; a label may hold any share of the rows.
    sums = materialize(each.groupBy(*key).agg(F.try_sum("error").alias("label_error")), "labels")
    joined = skew_join(each, sums, key, "left", hot_left=find_hot(each, key))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(found.entries)).alias("codebooks_sha256"))


def op12_sql(parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by full search."""
    ctes = [f"""kept AS (SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT vec_id, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS j, v[i] AS x
  FROM (SELECT vec_id, v, len(v) AS n, unnest(generate_series(1, len(v))) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {n_entries}),
b0 AS (SELECT p, e, j, x AS c FROM cells JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""d{r} AS (SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM cells JOIN b{r} USING (p, j) GROUP BY ALL),
a{r} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            ctes.append(f"""m{r} AS (SELECT p, e, j, floor(sum(x) / count(*))::BIGINT AS c FROM a{r} JOIN cells USING (vec_id, p) GROUP BY ALL),
b{r + 1} AS (SELECT p, e, j, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e, j))""")
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


OP12_SQL = op12_sql()
