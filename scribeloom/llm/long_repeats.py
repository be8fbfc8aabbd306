"""Removal of long repeated strings with a run-length index.

Every string of LENGTH bytes holds a sampled k-gram, the least by hash, and
equal strings hold the same one at the same place. So strings are dealt by that
k-gram, and only pieces of text around k-grams that occur again are looked at.
Each bucket of pieces gets an index of its own: the Burrows-Wheeler transform
of its distinct pieces kept as runs, with sampled positions where the runs end,
and the first position of each group of rows that match over LENGTH bytes or
more. The pieces are streamed through the index from right to left, which gives
the matching statistics: at each place, the row of the index and whether it
matches for LENGTH bytes a place that comes earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeloom.llm.common import parts_for
from scribeloom.llm.shingles import P, mix, power
from scribeloom.scale import find_hot, materialize, release

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # k-grams in a string
CHUNK = 1 << 20             # bytes sampled at once
PLACE = np.uint64((1 << 22) - 1)
FLUSH = 400_000
BUCKET_BYTES = 24 << 20     # text whose samples meet in one task
INDEX_BYTES = 2 << 20       # pieces in one index
HOT_SHARE, HOT_RUNS = 64, 20_000
BLOCK = 8                   # places of a hot k-gram in a string that are dealt together

_CASED = mix(np.arange(1, 257, dtype=np.uint64) * P)


def sample(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, ahead, gram): runs of n string starts from `first` on that
    share their sampled k-gram, which stands `ahead` bytes after `first`; `gram`
    is the hash of its bytes. Strings do not cross the bounds of texts."""
    size = len(data)
    if size < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_CASED[data] * power(size + 1)[:size], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * power(size + 1, True)[: size - GRAM + 1])
    n = len(grams)
    keys = np.full(-(-n // WINDOW) * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:n] = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
    blocks = keys.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = size - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[WINDOW - 1 : WINDOW - 1 + starts])
    place = (least & PLACE).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(starts), "right")
    whole = np.arange(starts) + LENGTH <= bounds[np.minimum(text, len(bounds) - 1)]
    fresh = np.ones(starts, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & whole)
    run = np.cumsum(fresh) - 1
    count = np.bincount(run[whole], minlength=run[-1] + 1 if starts else 0)
    return first, count[run[first]], place[first] - first, grams[place[first]]


class RunIndex:
    """The run-length index of pieces, which stand in order of their places."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.zeros(int(sizes.sum()) + len(pieces), np.int64)  # 0 ends a piece
        inside = np.ones(len(text), bool)
        inside[self.begins + sizes] = False
        text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        self.text, self.size = text, len(text)
        left = np.repeat(self.begins + sizes, sizes + 1) - np.arange(len(text))  # bytes up to the end of the piece
        rows, match = self._sorted(left)
        before = text[rows - 1]  # of the first row: the end mark of the last piece
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.starts, self.heads = heads, before[heads]
        self.samples = rows[np.append(heads[1:], len(rows)) - 1]  # positions where runs end
        lengths = np.diff(np.append(heads, len(rows)))
        order = np.argsort(self.heads, kind="stable")
        target = np.empty(len(heads), np.int64)
        target[order] = np.cumsum(lengths[order]) - lengths[order]
        self.target = target  # the row that the first row of a run leads to
        # Groups of rows that match over LENGTH bytes, and the first place of each.
        self.groups = np.flatnonzero(~match)
        self.earliest = np.minimum.reduceat(rows, self.groups)

    def _sorted(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of what follows in their piece, ties by place, and
        whether a row matches the row before it over LENGTH bytes."""
        size, text = self.size, self.text
        key, known = np.zeros(size, np.int64), 7
        for k in range(known):
            key = key * 257 + np.where(left >= k, text[np.minimum(np.arange(size) + k, size - 1)], 0)
        longest, alike = int(left.max()) + 1, None
        at = np.arange(size)

        def rank(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            out = np.empty(size, np.int64)
            out[order] = new
            return out

        def beside(ranks: np.ndarray, k: int) -> np.ndarray:
            """Pairs of the ranks of a place and of the one k further."""
            return ranks * (size + 1) + np.where(left >= k, ranks[np.minimum(at + k, size - 1)] + 1, 0)

        ranks = rank(key)
        while known < longest or alike is None:
            if alike is None and 2 * known >= LENGTH:
                alike = beside(ranks, LENGTH - known)
            ranks = rank(beside(ranks, known))
            known *= 2
        rows = np.argsort(ranks * size + at)
        same = alike[rows]
        match = np.concatenate([[False], same[1:] == same[:-1]]) & (left[rows] >= LENGTH)
        return rows, match

    def stream(self, pieces: list[bytes]) -> list[np.ndarray]:
        """For each place of each piece whether the LENGTH bytes from there on
        match an earlier place. All pieces take their steps side by side, by
        the runs alone; a piece starts at the row of its own end."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        row = np.arange(len(pieces), dtype=np.int64)  # rows of end marks come first, in order of place
        out = [np.zeros(max(0, n - LENGTH + 1), bool) for n in sizes]
        alive = np.argsort(-sizes, kind="stable")
        flags = np.zeros((len(pieces), int(sizes.max()) + 1 if len(sizes) else 1), bool)
        for step in range(1, flags.shape[1]):
            alive = alive[sizes[alive] >= step]
            run = np.searchsorted(self.starts, row[alive], "right") - 1
            row[alive] = self.target[run] + row[alive] - self.starts[run]
            if step >= LENGTH:
                group = np.searchsorted(self.groups, row[alive], "right") - 1
                flags[alive, step] = self.earliest[group] < self.begins[alive] + sizes[alive] - step
        for k, n in enumerate(sizes):
            if n >= LENGTH:
                out[k] = flags[k, n : LENGTH - 1 : -1]
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """d, x, text: documents by id, nulls first, then by a hash of the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    ).withColumn("x", F.xxhash64("text"))


def _pieces_of(d: int, x: int, text: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """A text in parts of at most CHUNK string starts, with their place."""
    for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
        yield d, x, text[at : at + CHUNK + LENGTH - 1], at


def _finer(first: int, n: int, ahead: int, text: bytes) -> Iterator[tuple[int, int, int]]:
    """Key, first start and number of starts of the parts of a run whose k-gram
    is hot. Strings with their k-gram in the same BLOCK places of them share the
    bytes in between, so these are the key of equal strings."""
    gram_at = first + ahead
    for block in range((ahead - n + 1) // BLOCK, ahead // BLOCK + 1):
        last = gram_at - block * BLOCK
        core = text[max(0, last) : last - BLOCK + 1 + LENGTH]
        a, b = max(first, last - BLOCK + 1), min(first + n - 1, last)
        if a <= b:
            key = xxhash.xxh3_64_intdigest(core, seed=block)
            yield key - (1 << 64 if key >> 63 else 0), a, b - a + 1


def repeated_samples(keyed: DataFrame, buckets: int) -> DataFrame:
    """d, x, first, n, ahead, gram of runs whose sampled k-gram occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def packed() -> pa.RecordBatch:
            *other, gram = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = (gram >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [[int(bucket[order[at]]) for at in [0, *cuts]]]
            rows += [[part.tobytes() for part in np.split(c[order], cuts)] for c in (*other, gram)]
            kinds = [pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["bucket", "d", "x", "first", "n", "ahead", "gram"])

        def sampled(group: list[tuple[int, int, bytes, int]]) -> None:
            nonlocal total
            bounds = np.cumsum([len(t) for _, _, t, _ in group])
            first, n, ahead, gram = sample(np.frombuffer(b"".join(t for _, _, t, _ in group), np.uint8), bounds)
            text = np.searchsorted(bounds, first, "right")
            begin = np.concatenate([[0], bounds[:-1]])
            at = np.array([p for *_, p in group], np.int64)
            held.append((
                np.array([g[0] for g in group], np.int64)[text], np.array([g[1] for g in group], np.int64)[text],
                first - begin[text] + at[text], n.astype(np.uint8), ahead.astype(np.uint8), gram,
            ))
            total += len(first)

        for batch in batches:
            group, size = [], 0
            for d, x, text in zip(batch.column("d"), batch.column("x"), batch.column("text"), strict=True):
                for piece in _pieces_of(d.as_py(), x.as_py(), text.as_py()):
                    if group and size + len(piece[2]) > CHUNK:
                        sampled(group)
                        group, size = [], 0
                        if total >= FLUSH:
                            yield packed()
                            held.clear()
                            total = 0
                    group.append(piece)
                    size += len(piece[2])
            if group:
                sampled(group)
        if total:
            yield packed()

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {"d": np.int64, "x": np.int64, "first": np.int64, "n": np.uint8, "ahead": np.uint8, "gram": np.uint64}
        cols = {c: np.frombuffer(b"".join(rows[c]), k) for c, k in kinds.items()}
        order = np.argsort(cols["gram"], kind="stable")
        gram = cols["gram"][order]
        same = gram[1:] == gram[:-1]
        keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return pd.DataFrame({c: v[keep].view(np.int64) if c == "gram" else v[keep].astype(np.int64) for c, v in cols.items()})

    packed = keyed.select("d", "x", "text").mapInArrow(run, "bucket long, d binary, x binary, first binary, n binary, ahead binary, gram binary")
    return packed.groupBy("bucket").applyInPandas(again, "d long, x long, first long, n long, ahead long, gram long")


def earlier_ranges(keyed: DataFrame, samples: DataFrame, buckets: int) -> DataFrame:
    """d, x, begin, end: ranges covered by strings that start earlier as well."""
    hot = find_hot(samples, ["gram"], max(HOT_SHARE, buckets), HOT_RUNS)
    if hot is None:
        samples = samples.withColumn("hot", F.lit(False))
    else:  # fewer grams than buckets
        flagged = F.broadcast(hot.select("gram", F.lit(True).alias("hot")))
        samples = samples.join(flagged, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    runs = samples.groupBy("d", "x").agg(F.collect_list(F.struct("first", "n", "ahead", "gram", "hot")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of text by bucket; equal pieces of a batch travel once."""
        for batch in batches:
            places: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            found = batch.column("runs")
            ends, fields = found.offsets.to_pylist(), found.values
            first, n, ahead, gram, hot = (fields.field(c).to_pylist() for c in ("first", "n", "ahead", "gram", "hot"))
            ds, xs = batch.column("d").to_pylist(), batch.column("x").to_pylist()
            for k, text in enumerate(batch.column("text")):
                d, x, text = ds[k], xs[k], text.as_py()
                for j in range(ends[k], ends[k + 1]):
                    run = [(gram[j], first[j], n[j])]
                    for key, a, m in _finer(first[j], n[j], ahead[j], text) if hot[j] else run:
                        places.setdefault((key, text[a : a + m + LENGTH - 1]), []).append((d, x, a))
            grams, pieces = [k[0] for k in places], [k[1] for k in places]
            column = lambda i: pa.array([[p[i] for p in v] for v in places.values()], pa.list_(pa.int64()))
            bucket = (np.array(grams, np.int64).view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            arrays = [pa.array(bucket.astype(np.int64)), pa.array(grams, pa.int64()), pa.array(pieces, pa.binary()), column(0), column(1), column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "gram", "piece", "d", "x", "first"])

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        times = rows["d"].map(len).to_numpy()
        flat = pd.DataFrame({
            "gram": np.repeat(rows["gram"].to_numpy(), times), "piece": np.repeat(rows["piece"].to_numpy(), times),
            "d": np.concatenate(rows["d"].tolist()), "x": np.concatenate(rows["x"].tolist()), "first": np.concatenate(rows["first"].tolist()),
        }).drop_duplicates(["d", "x", "first"]).sort_values(["d", "x", "first"], kind="stable", ignore_index=True)
        new = ~flat.duplicated(["gram", "piece"]).to_numpy()
        copies, own = flat[~new], flat[new]
        out = [pd.DataFrame({"d": copies["d"], "x": copies["x"], "begin": copies["first"], "end": copies["first"] + copies["piece"].map(len)})]
        # A piece alone with its k-gram matches nothing: within a piece the
        # k-gram stands at another place in every string.
        own = own[own.groupby("gram")["gram"].transform("size") > 1].sort_values("gram", kind="stable")
        # One index for about INDEX_BYTES of pieces; those of one k-gram stay together.
        part = (own["piece"].map(len).astype("int64").cumsum() // INDEX_BYTES).groupby(own["gram"]).transform("min")
        own = own.sort_index()
        found = []
        for _, some in own.groupby(part):
            pieces = some["piece"].tolist()
            d, x, first = (some[c].to_numpy() for c in ("d", "x", "first"))
            for k, hit in enumerate(RunIndex(pieces).stream(pieces)):
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    found += [(d[k], x[k], first[k] + a, first[k] + b - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out.append(pd.DataFrame(found, columns=["d", "x", "begin", "end"]))
        return pd.concat(out).astype("int64")

    joined = keyed.join(runs, ["d", "x"]).select("d", "x", "text", "runs")
    pieces = joined.mapInArrow(cut, "bucket long, gram long, piece binary, d array<long>, x array<long>, first array<long>")
    return pieces.groupBy("bucket").applyInPandas(mark, "d long, x long, begin long, end long")


def spans(docs: DataFrame) -> DataFrame:
    """d, x, spans: per document the maximal runs of bytes to remove."""
    keyed = _keyed(docs)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts_for(docs.sparkSession, total, BUCKET_BYTES)
    samples = materialize(repeated_samples(keyed, buckets), "samples")
    release(docs.sparkSession)
    ranges = materialize(earlier_ranges(keyed, samples, buckets), "ranges")
    release(docs.sparkSession)
    return ranges.groupBy("d", "x").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), removed (spans), n_bytes for every row.

    Documents are ordered by doc_id, nulls first; rows of one id and text are
    one document and are cut alike; rows of one id with other texts are ordered
    by a hash. Null and empty texts have no bytes. Strings are judged on the
    input, and matches never cross documents.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                text, merged, parts, at = text.as_py(), [], [], 0
                for r in ranges.as_py() or []:
                    if merged and r["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                    else:
                        merged.append(dict(r))
                for r in merged:
                    parts.append(text[at : r["begin"]])
                    at = r["end"]
                kept.append(b"".join(parts) + text[at:] if merged else text)
                removed.append(merged)
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(removed, kind), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kept", "removed", "n_bytes"])

    found = spans(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = _keyed(named).withColumn("doc_id", F.when(F.col("d") != -(1 << 63), F.col("d")))
    joined = keyed.join(found, ["d", "x"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, kept binary, removed array<struct<begin:long,end:long>>, n_bytes long")


def op2(docs: DataFrame) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    return remove(docs).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
