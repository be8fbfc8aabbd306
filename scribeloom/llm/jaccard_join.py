"""N-gram Jaccard join by PartEnum signatures.

A set links only if PERCENT of its shingles stand in other sets as well. Rows are
counted by shingle first, and sets with fewer such shingles are left out.

Sets are put in bands of size; a set takes part in its own band and the next,
so any two sets that can be similar meet in one band. There the domain of
shingles is cut into groups of partitions by a hash. Two sets of the band that
link differ in at most `k` shingles. With groups of three partitions, at most
k / 2 groups hold two differences; any other group has two partitions with the
same shingles in both sets. So a set signs every two partitions of each group,
and linked sets share a signature. Bands of small sets, where this costs much
more, have groups of one partition. A group is weak if a subset to sign is
empty; a set with so many weak groups that a linked set might agree in these
alone signs its empty subsets as well.

Sets that share a signature are candidates. A signature has a few leaders, the
first of its sets in several orders. Each set is compared with the leader of
each order that it shares most signatures with. In a few turns, each set of a
large group is held against one block of it by a sketch that bounds their
difference, and compared with the nearest set. This joins groups of near copies
by few pairs. Then all sets of different components that still share a signature
are held against each other by the sketch, in blocks, and each is compared with
its nearest ones by all shingles; sets with more than these go on, until none is
left that may link and was not compared. So no link between different sets is
lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeloom.llm.common import NOT_SPACE, parts_for
from scribeloom.llm.components import components
from scribeloom.llm.shingles import mix, shingle_sets
from scribeloom.scale import few_files, find_hot, materialize, release, skew_join

PERCENT = 80
CHUNK_SHINGLES = 1_000_000
BUCKET_SHINGLES = 2_000_000
CHUNK_SIGNATURES = 1_000_000
BUCKET_SIGNATURES = 1_500_000
SKETCH_BITS = 1024, 16384  # of the smallest and the largest sets
BLOCK = 256  # sets of a key compared with as many others at once
FEW_NODES = 200_000  # names that are broadcast
SETS = 2_000  # sets, or pairs of them, in a task
MEMBERS = 100_000  # rows of sets in a task
PAIRS = 125_000  # pairs of sets in memory at once
PAIR_BYTES = 8 << 20  # of sketches compared at once
LEADERS = 3  # of a signature
TURNS = 2  # at most, in which sets of large keys are compared with one block
NEAREST = 4  # sets that each set is compared with by all shingles, at first
TWO_OF_THREE = np.array([[0, 1], [0, 2], [1, 2]])
_INSTANCE, _PART = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=None)
def band_ends(band: int) -> tuple[int, int]:
    """Least and greatest size of a band; sizes of a band are within the
    similarity, so sets of bands two apart never link."""
    low = 1 if band == 0 else band_ends(band - 1)[1] + 1
    return low, low * 100 // PERCENT


def band_of(size: int) -> int:
    band = 0
    while band_ends(band)[1] < size:
        band += 1
    return band


def _groups(band: int, size: int) -> tuple[int, int]:
    """(most, n) for groups of `size` partitions: the most groups that two
    linked sets of the band and the one below may disagree in, and groups enough
    for the smallest set to have more than that many which are not weak, but for
    one set in about a thousand."""
    smallest, largest = band_ends(max(band - 1, 0))[0], band_ends(band)[1]
    k = 2 * largest * (100 - PERCENT) // (100 + PERCENT)
    most = k if size == 1 else k // 2
    n = most + 1
    while n * size < 4 * largest:
        empty = math.exp(-smallest / (n * size))
        if size == 1:
            weak, spread = empty, math.sqrt(max(0.0, n * empty * (1 - (1 + smallest / n) * empty)))
        else:  # two of three are empty
            weak = empty * empty * (3 - 2 * empty)
            spread = math.sqrt(n * weak * (1 - weak))
        if n * (1 - weak) - 3 * spread >= most + 1:
            break
        n += max(1, n // 64)
    return most, n


@lru_cache(maxsize=None)
def partitions(band: int) -> tuple[int, int, int]:
    """(most, n, size) of the band: two partitions of three are signed unless
    one of one costs less than half as many signatures."""
    one, three = _groups(band, 1), _groups(band, 3)
    return (*three, 3) if 3 * three[1] <= 2 * one[1] else (*one, 1)


def signatures(shingles: np.ndarray) -> np.ndarray:
    """The signatures of one set in its band and the next."""
    found, band = [], band_of(len(shingles))
    for b in (band, band + 1):
        most, n, size = partitions(b)
        if most == 0 and size == 1:
            continue  # only equal sets link, and those are one node
        salt = np.full(1, b, np.uint64) * _INSTANCE
        spread = mix(shingles + salt)
        part = (spread % np.uint64(n * size)).astype(np.int64)
        sums = np.zeros(n * size, np.uint64)
        np.add.at(sums, part, mix(spread))
        filled = np.bincount(part, minlength=n * size).reshape(n, size) > 0
        cells = mix(sums + mix(np.arange(n * size, dtype=np.uint64) * _PART + salt)).reshape(n, size)
        if size == 3:
            first, second = TWO_OF_THREE.T
            cells = mix(cells[:, first] + mix(cells[:, second]))
            filled = filled[:, first] | filled[:, second]
        weak = n - int(filled.all(axis=1).sum())
        found.append(cells[filled] if weak < n - most else cells.ravel())
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def node_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix(shingles ^ _PART)
    b = mix(shingles * _INSTANCE + np.uint64(len(shingles)))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], np.uint64).tobytes()


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by bit: two sets differ in as many shingles as
    bits, or more. Larger sets have more bits."""
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << int(2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: bytes, width: int) -> np.ndarray:
    """The sketch of the same set in `width` bytes, as words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, width // 8), axis=0)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    return enumerate(shingle_sets(batch.column("text")))  # a batch at a time


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `key`, 128 bits that name the text of a row; ids may be null or repeat."""
    return docs.withColumn("key", F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))))


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, node of every row with doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for _, s in _texts(batch):
                sizes.append(len(s))
                nodes.append(node_of(s))
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_shingles", "node"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType())])
    return _keyed(docs.select("doc_id", "text")).mapInArrow(run, schema)


def linkable(docs: DataFrame, buckets: int) -> DataFrame:
    """The nodes that may link: PERCENT of their shingles or more stand in other
    rows of docs as well.

    Documents are packed in chunks. A shingle goes as its bucket and 32 bits of
    its hash, with the place of its document in the chunk. A bucket gives the
    places of shingles that it holds once; a chunk adds them up. Shingles that
    share these bits, equal sets and lost rows keep a node, they never drop one.
    """
    columns = {"bucket": pa.int64(), "chunk": pa.int64(), "shingles": pa.binary(), "places": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        found, nodes, held = [], [], 0

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in found], np.uint32)
            names = b"".join(nodes)
            chunk = int.from_bytes(hashlib.md5(names).digest()[:8], "little", signed=True)
            spread = mix(np.concatenate(found))
            bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            place = np.repeat(np.arange(len(found), dtype=np.uint16), sizes)[order]
            low, bucket = spread.astype(np.uint32)[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = [*starts.tolist(), len(bucket)]
            rows = [(int(bucket[i]), chunk, low[i:j].tobytes(), place[i:j].tobytes(), None, None) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
            rows.append((chunk % buckets, chunk, b"", b"", names, sizes.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))

        for batch in batches:
            for _, s in _texts(batch):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                found.append(s)
                nodes.append(node)
                held += len(s)
                if held >= CHUNK_SHINGLES or len(found) == 1 << 16:
                    yield packed()
                    found, nodes, held = [], [], 0
        if found:
            yield packed()

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(rows["shingles"]), np.uint32)
        order = np.argsort(values)
        fresh = np.ones(len(values) + 1, bool)
        fresh[1:-1] = np.diff(values[order]) != 0
        once = np.empty(len(values), bool)
        once[order] = fresh[:-1] & fresh[1:]
        ends = np.cumsum([len(r) // 4 for r in rows["shingles"]])[:-1]
        places = [np.frombuffer(p, np.uint16)[o].tobytes() for p, o in zip(rows["places"], np.split(once, ends), strict=True)]
        return pd.DataFrame({"chunk": rows["chunk"], "places": places, "nodes": rows["nodes"], "sizes": rows["sizes"]})

    def may_link(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["nodes"].notna()].iloc[:1]
        if not len(head):
            return pd.DataFrame({"node": []})
        names, sizes = head["nodes"].iloc[0], np.frombuffer(head["sizes"].iloc[0], np.uint32).astype(np.int64)
        once = np.bincount(np.frombuffer(b"".join(rows["places"]), np.uint16), minlength=len(sizes))
        keep = np.flatnonzero(100 * (sizes - once) >= PERCENT * sizes)
        return pd.DataFrame({"node": [names[16 * i : 16 * i + 16] for i in keep]})

    cells = docs.select("text").mapInArrow(pack, "bucket long, chunk long, shingles binary, places binary, nodes binary, sizes binary")
    once = cells.groupBy("bucket").applyInPandas(alone, "chunk long, places binary, nodes binary, sizes binary")
    return once.groupBy("chunk").applyInPandas(may_link, "node binary").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, sketch, shingles of the wanted nodes, from one document of each."""
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row")
    chosen = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(row).select(F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key"))
    rows = wanted.count()
    if rows <= FEW_NODES:  # texts need not be shuffled to find these
        chosen = F.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(node_of(s), len(s), sketch_of(s), s.tobytes()) for _, s in _texts(batch)]
            kinds = {"node": pa.binary(), "n": pa.int64(), "sketch": pa.binary(), "shingles": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = _keyed(docs.select("doc_id", "text")).join(chosen, same, "left_semi")
    # Rows of one id and text may repeat; they are told apart before they are made.
    return few_files(texts.dropDuplicates(["doc_id", "key"]), rows, SETS).select("text").mapInArrow(run, "node binary, n long, sketch binary, shingles binary")


def shared_signatures(sets: DataFrame, buckets: int) -> DataFrame:
    """signature, node, leaders, times for signatures of two sets or more. Each
    of the leaders is a set of the signature, the first one in an order by hash.

    Signatures travel in packed rows, one per bucket and chunk of sets.
    Signatures that the very same sets share say the same, so each such group is
    given once, under its hash, with the number of times.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, nodes, held = [], [], 0

        def packed() -> pa.RecordBatch:
            values = np.concatenate(found)
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
            bucket = (values >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            values, owner, bucket = values[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = {"bucket": [], "signatures": [], "counts": [], "nodes": []}
            table = np.frombuffer(b"".join(nodes), "V16")
            for part, who, at in zip(np.split(values, cuts), np.split(owner, cuts), [0, *cuts], strict=True):
                mine, counts = np.unique(who, return_counts=True)  # `who` ascends
                rows["bucket"].append(int(bucket[at]))
                rows["signatures"].append(part.tobytes())
                rows["counts"].append(counts.astype(np.uint32).tobytes())
                rows["nodes"].append(table[mine].tobytes())
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

        for batch in batches:
            for node, s in zip(batch.column("node"), batch.column("shingles"), strict=True):
                own = signatures(np.frombuffer(s.as_py(), np.uint64))
                if len(own):
                    found.append(own)
                    nodes.append(node.as_py())
                    held += len(own)
                    if held >= CHUNK_SIGNATURES:
                        yield packed()
                        found, nodes, held = [], [], 0
        if found:
            yield packed()

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(rows["signatures"]), np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"]), np.uint32)
        table = b"".join(rows["nodes"])
        names, place = np.unique(np.frombuffer(table, ">u8").reshape(-1, 2), axis=0, return_inverse=True)
        owner = np.repeat(place.reshape(-1), counts)
        order = np.lexsort((owner, values))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sizes = np.diff(np.append(starts, len(values)))
        marks = mix(names[:, 0].astype(np.uint64) ^ mix(names[:, 1].astype(np.uint64)))
        group = mix(np.add.reduceat(marks[owner], starts) + sizes.astype(np.uint64))
        times = np.zeros(len(starts), np.int64)
        _, at, n = np.unique(group, return_index=True, return_counts=True)
        times[at] = n
        shared = np.repeat((sizes > 1) & (times > 0), sizes)
        leaders = []
        for salt in np.arange(LEADERS, dtype=np.uint64)[:, None] * _PART:
            by_hash = mix(marks + salt)
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(by_hash)] = np.arange(len(names))
            ranked = np.argsort(rank)  # the set of each rank
            leaders.append(np.repeat(ranked[np.minimum.reduceat(rank[owner], starts)], sizes)[shared])
        values, owner, times = np.repeat(group, sizes)[shared], owner[shared], np.repeat(times, sizes)[shared]
        raw = [names[i].tobytes() for i in range(len(names))]
        return pd.DataFrame({
            "signature": values.view(np.int64), "node": [raw[i] for i in owner], "leaders": [[raw[i] for i in row] for row in np.column_stack(leaders)], "times": times,
        })

    packed = sets.select("node", "shingles").mapInArrow(sign, "bucket long, signatures binary, counts binary, nodes binary")
    return packed.groupBy("bucket").applyInPandas(match, "signature long, node binary, leaders array<binary>, times long").groupBy("signature", "node").agg(
        F.first("leaders").alias("leaders"), F.sum("times").alias("times")
    )


@F.pandas_udf(T.BooleanType())
def _near(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether sizes and sketches let two sets link."""
    if not len(n_a):
        return pd.Series([], dtype=bool)
    differ = _differences([*a, *b], np.arange(len(a)), np.arange(len(a)) + len(a))
    return pd.Series(_may_link(n_a.to_numpy(), n_b.to_numpy(), differ))


def _may_link(n_a, n_b, differ):
    """100 |a & b| >= PERCENT |a | b| asks for (100 + P) d <= (100 - P) (|a| + |b|)."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= PERCENT * large) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n_a + n_b))


@F.pandas_udf(T.BooleanType())
def _links(a: pd.Series, b: pd.Series) -> pd.Series:
    found = []
    for x, y in zip(a, b, strict=True):
        s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(s, t, assume_unique=True))
        found.append(100 * both >= PERCENT * (len(s) + len(t) - both))
    return pd.Series(found, dtype=bool)


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b that link, by all their shingles."""
    rows = pairs.count()
    if not rows:
        return pairs.select("a", "b")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    with_b = pairs.select("a", "b").join(side("b"), "b")
    with_a = skew_join(with_b, side("a"), ["a"], hot_left=find_hot(pairs, ["a"], rows=rows), spread_by=["b"])
    found = materialize(few_files(with_a, rows, SETS).where(_links("set_a", "set_b")).select("a", "b"), "links")
    release(sets.sparkSession)
    return found


def _differences(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of places in `sketches`, a number their sets differ in at least."""
    width = np.array([len(s) for s in sketches])
    least = np.minimum(width[a], width[b])
    found = np.empty(len(a), np.int64)
    for w in np.unique(least):
        here = np.flatnonzero(least == w)
        used = np.unique(np.concatenate([a[here], b[here]]))
        folded = np.stack([_folded(sketches[i], w) for i in used])
        step = max(1, PAIR_BYTES // int(w))
        for some in (here[i : i + step] for i in range(0, len(here), step)):
            x, y = np.searchsorted(used, a[some]), np.searchsorted(used, b[some])
            found[some] = np.bitwise_count(folded[x] ^ folded[y]).sum(axis=1, dtype=np.int64)
    return found


def _nearest(pairs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b, difference) less those beyond the k nearest of both sets,
    and the sets that had more than k."""
    pairs = np.unique(pairs, axis=0)
    ends = np.concatenate([pairs[:, 0], pairs[:, 1]])
    order = np.lexsort((np.tile(pairs[:, 2], 2), ends))
    starts = np.flatnonzero(np.diff(ends[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(ends)))
    place = np.empty(len(ends), np.int64)
    place[order] = np.arange(len(ends)) - np.repeat(starts, sizes)
    keep = (place[: len(pairs)] < k) | (place[len(pairs) :] < k)
    return pairs[keep], ends[order][starts[sizes > k]]


def _open(members: DataFrame) -> DataFrame:
    """key, node, label, others, majors for sets to compare: those of one key are.

    A key is a signature shared by several components, or, where this makes
    fewer pairs, the largest component of signatures, the major one, with all
    sets that share them: near copies meet in many signatures. `majors` counts
    the sets of the key in the major component, `others` all others.
    """
    by_label = members.groupBy("signature", "label").agg(F.count("*").alias("c"))
    sizes = by_label.groupBy("signature").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("major")).where("m > major.c")
    sizes = materialize(sizes.select("signature", F.col("major.label").alias("major"), (F.col("m") - F.col("major.c")).alias("others"), F.col("major.c").alias("majors")), "sizes")
    cost = F.col("others").cast("double") * (F.col("others") / 2 + F.col("majors"))
    open_ = materialize(members.join(sizes, "signature"), "meeting")
    rows = open_.count()
    open_ = few_files(open_, rows)
    whole = open_.groupBy("major", "node").agg(F.first("label").alias("label"))
    is_major = (F.col("label") == F.col("major")).cast("long")
    counts = whole.groupBy("major").agg(F.sum(1 - is_major).alias("others"), F.sum(is_major).alias("majors"))
    fewer = counts.join(sizes.groupBy("major").agg(F.sum(cost).alias("apart")), "major").where(cost <= F.col("apart")).drop("apart")
    fewer = materialize(few_files(fewer, rows), "fewer")
    hot = find_hot(whole, ["major"], rows=rows)
    together = skew_join(whole, fewer, ["major"], hot_left=hot).select(F.col("major").alias("key"), "major", "node", "label", "others", "majors")
    signature = F.unhex(F.lpad(F.hex("signature"), 16, "0"))  # eight bytes; a component has sixteen
    apart = open_.join(fewer.select("major"), "major", "left_anti").select(signature.alias("key"), "major", "node", "label", "others", "majors")
    return materialize(few_files(together.union(apart).withColumn("is_major", F.col("label") == F.col("major")).drop("major"), rows), "open")


def _compared(dealt: DataFrame, rows: int, k: int) -> DataFrame:
    """a, b, cut_a, cut_b: pairs of sets of one key in different components that
    may link. A task holds blocks low and high of a key and gives the k nearest
    of each set; a pair it leaves out has two sets that are marked as cut."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "low", "high"], kind="stable", ignore_index=True)
        key = np.column_stack([pd.factorize(rows["key"])[0], rows["low"], rows["high"]])
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(rows)))
        node, names = pd.factorize(rows["node"])
        sketches = [rows["sketch"].iloc[i] for i in np.unique(node, return_index=True)[1]]
        label = pd.factorize(rows["label"])[0]
        n, block, low, high = (rows[c].to_numpy() for c in ("n", "block", "low", "high"))
        found, held, cut = [np.empty((0, 3), np.int64)], 0, [np.empty(0, np.int64)]

        def thin() -> None:
            nonlocal found, held
            pairs, more = _nearest(np.concatenate(found), k)
            found, held = [pairs], 0
            cut.append(more)

        for m in np.unique(sizes):  # all groups of one size at once
            x, y = np.triu_indices(m, 1)
            groups = starts[sizes == m]
            step = max(1, PAIRS // max(1, len(x)))
            for some in (groups[i : i + step] for i in range(0, len(groups), step)):
                a, b = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                here = np.minimum(block[a], block[b]) == low[a]
                here &= (np.maximum(block[a], block[b]) == high[a]) & (label[a] != label[b]) & _may_link(n[a], n[b], 0)
                a, b = a[here], b[here]
                differ = _differences(sketches, node[a], node[b])
                here = _may_link(n[a], n[b], differ)
                a, b = node[a[here]], node[b[here]]
                found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b), differ[here]]))
                held += len(a)
                if held > PAIRS:
                    thin()
        thin()
        more = np.zeros(len(names), bool)
        more[np.concatenate(cut)] = True
        out = [(names[i], names[j], bool(more[i]), bool(more[j])) for i, j in found[0][:, :2]]
        return pd.DataFrame([r if r[0] < r[1] else (r[1], r[0], r[3], r[2]) for r in out], columns=["a", "b", "cut_a", "cut_b"])

    tasks = parts_for(dealt.sparkSession, rows, MEMBERS)
    spread = F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks))
    return dealt.withColumn("task", spread).groupBy("task").applyInPandas(compare, "a binary, b binary, cut_a boolean, cut_b boolean").groupBy("a", "b").agg(
        F.max("cut_a").alias("cut_a"), F.max("cut_b").alias("cut_b")
    )


def _probed(open_: DataFrame, facts: DataFrame, turn: int) -> DataFrame:
    """As `_compared`, but only sets of large keys, each with one block of its
    largest key, another one each turn, and the nearest set only."""
    size = F.col("others") + F.col("majors")
    each = open_.where(size > BLOCK).groupBy("node").agg(F.max(F.struct(size.alias("m"), "key", "label")).alias("one")).select("node", "one.*")
    blocks = F.ceil(F.col("m") / BLOCK)
    each = each.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), blocks).cast("int")).join(facts, "node")
    return _compared(each.withColumn("low", F.col("block")).withColumn("high", F.col("block")).drop("m"), 0, 1)


def _across(open_: DataFrame, facts: DataFrame, rows: int, k: int) -> DataFrame:
    """As `_compared`, for all pairs of sets of one key. Sets of a key are cut into
    blocks. Members of the major component are in blocks of their own, which
    meet the others' blocks only: m of them and one other make about m rows."""
    counts = [F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("others", "majors")]
    placed = open_.select("key", "node", "label", "is_major", *counts).join(facts, "node")
    # Blocks by hash: no window over a whole key is needed.
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    block = F.when(F.col("is_major"), F.col("others") + place("majors")).otherwise(place("others"))
    last = F.when(F.col("is_major"), F.col("others")).otherwise(F.col("others") + F.col("majors")) - 1
    pairs = F.transform(
        F.sequence(F.lit(0), last),
        lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")),
    )
    dealt = placed.withColumn("block", block).withColumn("p", F.explode(pairs)).select("key", "node", "label", "n", "sketch", "block", "p.*")
    return _compared(dealt, rows, k)


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label of the nodes that links lead to others.

    Every pair of linked sets is either compared or joined by other links.
    """
    spark = docs.sparkSession
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    wanted = materialize(linkable(docs, parts_for(spark, total, BUCKET_SHINGLES)), "linkable")
    sets = materialize(sets_of(docs, nodes, wanted), "sets")
    release(spark)
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = materialize(shared_signatures(sets, parts_for(spark, 0.65 * total, BUCKET_SIGNATURES)), "signatures")
    release(spark)
    facts = sets.drop("shingles")
    rows = shared.count()
    led = shared.select("node", "times", F.posexplode("leaders").alias("order", "leader")).where("node <> leader")
    led = led.groupBy("node", "order", "leader").agg(F.sum("times").alias("times"))
    best = led.groupBy("node", "order").agg(F.max(F.struct("times", "leader")).alias("best"))
    best = best.select(F.least("best.leader", "node").alias("a"), F.greatest("best.leader", "node").alias("b")).distinct()
    best = materialize(few_files(best, rows), "best")
    rows = best.count()
    near = skew_join(best, facts.toDF("b", "n_b", "sketch_b"), ["b"], hot_left=find_hot(best, ["b"], rows=rows), spread_by=["a"])
    near = skew_join(near, facts.toDF("a", "n_a", "sketch_a"), ["a"], hot_left=find_hot(best, ["a"], rows=rows), spread_by=["b"])
    near = materialize(few_files(near, rows, SETS).where(_near("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b"), "near")
    found, tried = _verified(sets, near), best
    labels = components(found)

    def opened(some: DataFrame | None = None) -> DataFrame:
        rows = shared.select("signature", "node")
        rows = rows if some is None else rows.join(some, "node", "left_semi")
        return _open(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))

    open_ = opened()
    for turn in range(TURNS):
        if open_.where(F.col("others") + F.col("majors") > BLOCK).isEmpty():
            break
        probed = materialize(_probed(open_, facts, turn).join(tried, ["a", "b"], "left_anti").select("a", "b"), "probed")
        more = _verified(sets, probed)
        tried = tried.union(probed)
        joined = more.count()
        if not joined:
            break
        found = found.union(more)
        labels = components(found)
        open_ = opened()
        if 4 * joined < labels.count():  # another turn would join few
            break
    k = NEAREST
    while rows := open_.count():
        pairs = materialize(_across(open_, facts, rows, k), "rest")
        rest = pairs.join(tried, ["a", "b"], "left_anti").select("a", "b")
        rest = materialize(rest, "untried")
        release(spark)
        more = _verified(sets, rest)
        tried = tried.union(rest)
        if not more.isEmpty():
            found = found.union(more)
            labels = components(found)
        cut = pairs.where("cut_a").select(F.col("a").alias("node")).union(pairs.where("cut_b").select("b"))
        if cut.isEmpty():
            break
        # A pair that was left out has two cut sets.
        open_, k = opened(materialize(cut.distinct(), "cut")), 4 * k
    return labels


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of docs with doc_id and text, and node, label of those that link."""
    nodes = materialize(nodes_of(docs), "nodes")
    return nodes, linked(docs, nodes.where("n_shingles > 0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Rows with equal sets are one node, and component_id is the least doc_id
    that links lead to. A document without words is alone. Repeated ids are
    rows of their own; a null id is never a component's name unless all its ids
    are null. An empty table gives no rows.
    """
    nodes, labels = _labelled(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    least = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    joined = skew_join(nodes.drop("key"), materialize(named, "named"), ["node"], "left", hot_left=find_hot(nodes, ["node"]))
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one of least id, nulls last, then of least
    text hash; all columns stay. Rows without words are all kept."""
    nodes, labels = _labelled(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    rows = nodes.where("n_shingles > 0").groupBy("node", "doc_id", "key").agg(F.count("*").alias("n"))
    least = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("least"))
    least = least.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
    # A row is named by id and text; n of them are the same.
    chosen = materialize(least.select(F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_key"), F.col("least.n").alias("_n")), "chosen")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    wordless = F.coalesce(~F.col(f"`{text}`").rlike(NOT_SPACE), F.lit(True))
    found = docs.select(
        row, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), wordless.alias("_wordless"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_h")
    )
    found = _keyed(found).drop("text")
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    one = found.join(chosen.where("_n = 1"), same, "left").where("_wordless or _n is not null").select("_row.*")
    # Only rows that repeat are shuffled to be chosen from, combined before.
    many = found.join(chosen.where("_n > 1"), same).groupBy("doc_id", "key").agg(F.min_by("_row", "_h").alias("_row"))
    return one.union(many.select("_row.*"))


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY a, b) p JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * n_both >= 80 * (sa.n + sb.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""
