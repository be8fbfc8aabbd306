"""Lines that many documents share, dropped by bitmaps.

The hashes of all lines are range-partitioned together with their documents,
and sorted by hash, document and position. A task streams its range: the first
lines of a hash wait until enough documents have been seen, then all of its
lines go, and each document gets one compressed bitmap of the lines it keeps.
Texts are neither shuffled nor sorted for that.

A range may end within the lines of a hash, so a line of any number of
documents is spread over tasks. What a task knows of the first and the last hash
of its range, at most two rows, is added up over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from scribeloom.scale import materialize

MIN_DOCS = 10
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"

LINES = "high long, low long, doc_id long, version long, n_lines int, pos int"
MARKS = LINES + ", docs int"
LINE_SCHEMA = pa.schema([
    ("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("n_lines", pa.int32()),
    ("pos", pa.int32()),
])
MARK_SCHEMA = LINE_SCHEMA.append(pa.field("docs", pa.int32()))


def version(text: Column) -> Column:
    """Tells texts of one doc_id, or of none, apart."""
    return F.xxhash64(text)


def _pairs(digests: list[bytes]) -> np.ndarray:
    """128-bit hashes as two signed numbers each."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without a hash for each document, and a row for each line that has a key."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        found, places, per_doc, n_lines = [], [], [], []
        for text in batch.column("text").to_pylist():
            keys = [line.strip(BLANK) for line in (text or "").encode().lower().split(b"\n")]
            at = [i for i, key in enumerate(keys) if key]
            found += [digest(keys[i]) for i in at]
            places += at
            per_doc.append(len(at))
            n_lines.append(len(keys))
        if not n_lines:
            continue
        row = np.repeat(np.arange(len(per_doc)), per_doc)
        hashes, all_lines = _pairs(found), np.array(n_lines, np.int32)
        ids, versions = batch.column("doc_id"), batch.column("version")
        none = pa.nulls(len(n_lines), pa.int64())
        heads = [none, none, ids, versions, pa.array(all_lines), pa.array(np.full(len(n_lines), -1, np.int32))]
        yield pa.RecordBatch.from_arrays(heads, schema=LINE_SCHEMA)
        if len(row):
            take = pa.array(row)
            body = [
                pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), ids.take(take), versions.take(take),
                pa.array(all_lines[row]), pa.array(np.array(places, np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(body, schema=LINE_SCHEMA)


class Range:
    """One sorted range of lines, streamed.

    `feed` gives the lines that go; lines of the range's first and last hash
    may be left open, with the number of documents seen. At most `least` - 1
    documents wait at a time.
    """

    def __init__(self, least: int):
        self.least = least
        self.held: pa.Table | None = None  # lines of the last hash, while its documents are too few
        self.gone: tuple[int, int] | None = None  # the last hash, once its lines go
        self.edge: tuple[int, int] | None = None  # the first hash, once its number is given
        self.begun = False

    def _row(self, lines: pa.Table, open_: bool) -> pa.Table:
        n = len(lines)
        columns = [lines[name] for name in LINE_SCHEMA.names]
        if not open_:
            columns[:2] = [pa.nulls(n, pa.int64())] * 2
        return pa.Table.from_arrays([*columns, pa.nulls(n, pa.int32())], schema=MARK_SCHEMA)

    def _count(self, key: tuple[int, int], docs: int) -> pa.Table:
        return pa.Table.from_pylist([{"high": key[0], "low": key[1], "docs": docs}], schema=MARK_SCHEMA)

    def feed(self, lines: pa.Table) -> Iterator[pa.Table]:
        if self.gone is not None:
            n = self._prefix(lines, self.gone)
            if n:
                yield self._row(lines.slice(0, n), False)
            lines = lines.slice(n)
            if not len(lines):
                return
            self.gone = None
        if self.held is not None:
            lines = pa.concat_tables([self.held, lines])
            self.held = None
        if not len(lines):
            return
        high, low = lines["high"].to_numpy(), lines["low"].to_numpy()
        ids, versions = lines["doc_id"], lines["version"].to_numpy()
        known, number = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        new_key = np.ones(len(high), bool)
        new_key[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        new_doc = new_key.copy()
        # Rows without an id are told apart by their texts.
        new_doc[1:] |= (known[1:] != known[:-1]) | (number[1:] != number[:-1]) | (~known[1:] & (versions[1:] != versions[:-1]))
        starts = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        sizes = np.diff(np.append(starts, len(high)))
        go = docs >= self.least
        key = lambda i: (int(high[starts[i]]), int(low[starts[i]]))
        last = len(starts) - 1
        if not self.begun and (last > 0 or go[0]):  # all there is to know of the first hash
            self.begun, self.edge = True, key(0)
            yield self._count(key(0), int(min(docs[0], self.least)))
            if not go[0]:
                yield self._row(lines.slice(0, sizes[0]), True)
        dropped = np.repeat(go, sizes)
        if dropped.any():
            yield self._row(lines.filter(pa.array(dropped)), False)
        if go[last]:
            self.gone = key(last)
        else:
            self.held = lines.slice(starts[last]).combine_chunks()

    @staticmethod
    def _prefix(lines: pa.Table, key: tuple[int, int]) -> int:
        other = (lines["high"].to_numpy() != key[0]) | (lines["low"].to_numpy() != key[1])
        return int(other.argmax()) if other.any() else len(lines)

    def end(self) -> Iterator[pa.Table]:
        """What is left of the last hash."""
        if self.held is not None:
            key = (self.held["high"][0].as_py(), self.held["low"][0].as_py())
            docs = len(set(zip(self.held["doc_id"].to_pylist(), (
                v if d is None else None for d, v in zip(self.held["doc_id"].to_pylist(), self.held["version"].to_pylist())
            ))))
            yield self._count(key, docs)
            yield self._row(self.held, True)
        elif self.gone is not None and self.gone != self.edge:
            yield self._count(self.gone, self.least)


def _stream(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Range(least)
        for batch in batches:
            for table in state.feed(pa.Table.from_batches([batch])):
                yield from table.to_batches()
        for table in state.end():
            yield from table.to_batches()

    return run


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    """A keep bitmap as its run lengths, kept and dropped by turns, kept first;
    each number takes seven bits a byte, the low ones first."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    edges = np.flatnonzero(np.diff(keep)) + 1
    runs = np.diff(np.concatenate(([0], edges, [n_lines]))).tolist()
    out = bytearray()
    for n in runs if keep[0] else [0, *runs]:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def unpack(bitmap: bytes) -> np.ndarray:
    """One boolean for each line: whether it is kept."""
    runs, n, shift = [], 0, 0
    for b in bitmap:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            runs.append(n)
            n, shift = 0, 0
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


@F.pandas_udf(BinaryType())
def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([pack(n, np.asarray(d, np.int64)) for n, d in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _kept_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(body: str | None, bits: bytes) -> str | None:
        keep = unpack(bits)
        if body is None or keep.all():
            return body
        return "\n".join([line for line, k in zip(body.split("\n"), keep.tolist(), strict=True) if k])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, least: int = MIN_DOCS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, version, n_lines, n_dropped, keep: one row for each text of an id.

    A line goes if its key (stripped, A-Z as a-z, not empty) is in at least
    `least` documents. Rows of one doc_id count as one document, rows without
    an id as one for each different text; repeated rows share a bitmap. A null
    or empty text is one empty line, which is kept. An empty table gives none.
    Keys are compared by 128-bit hashes.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), version(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text")
    )
    lines = materialize(rows.mapInArrow(_lines, LINES), "lines")
    without_id = F.when(F.col("doc_id").isNull(), F.col("version"))
    order = (
        lines.where("pos >= 0").repartitionByRange("high", "low", "doc_id", without_id)
        .sortWithinPartitions("high", "low", "doc_id", "version", "pos")
    )
    found = materialize(order.mapInArrow(_stream(least), MARKS), "marks")
    many = found.where("docs IS NOT NULL").groupBy("high", "low").agg(F.sum("docs").alias("n")).where(F.col("n") >= least)
    late = found.where("high IS NOT NULL AND docs IS NULL").join(many, ["high", "low"], "left_semi")
    columns = ("doc_id", "version", "n_lines", "pos")
    heads = lines.where("pos < 0").select("doc_id", "version", "n_lines", F.lit(None).cast("int").alias("pos"))
    gone = found.where("high IS NULL").select(*columns).unionByName(late.select(*columns))
    packed = heads.unionByName(gone).groupBy("doc_id", "version").agg(
        F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped")
    )
    return packed.select(
        "doc_id", "version", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        _bitmaps("n_lines", "dropped").alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with the lines that are kept, their other columns as they
    are, and `lines`: a struct of n_lines and n_dropped (a column of that name
    is replaced)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("_id"), version(F.col(f"`{text}`")).alias("_version"))
    marks = bitmaps.hint("shuffle_hash")  # the side of short rows, one for each text
    joined = rows.join(marks, rows["_id"].eqNullSafe(marks["doc_id"]) & (rows["_version"] == marks["version"]))
    joined = joined.withColumn("_text", _kept_lines(F.col("_row")[text], F.col("keep")))
    columns = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c != "lines"]
    return joined.select(*columns, F.struct("n_lines", "n_dropped").alias("lines"))


def op11(docs: DataFrame) -> DataFrame:
    """The digest of every document: doc_id, n_lines, n_dropped, kept_sha256."""
    rows = docs.select("doc_id", "text")
    kept = apply_bitmaps(rows, materialize(keep_bitmaps(rows), "bitmaps"))
    return kept.select("doc_id", "lines.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_STRIPPED = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS i FROM split),
keyed AS (SELECT doc_id, i, l, {_STRIPPED} AS k FROM lines),
many AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT doc_id, i, l, k IN (SELECT k FROM many) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
