"""Line dedup, vector codes and clusters, against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribeloom.llm import line_dedup, vector_clusters, vector_codes
from scribeloom.llm.line_dedup import LINE_SCHEMA, Range, pack, unpack

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))


def plain_lines(docs, least):
    """docs: (id, text); a null id counts as one document for each text."""
    where = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            where.setdefault(plain_key(line), set()).add((i, text if i is None else None))
    many = {k for k, found in where.items() if k and len(found) >= least}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if plain_key(x) not in many]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_texts(n=120, seed=3):
    rng = random.Random(seed)
    shared = [f"Shared line {i}" for i in range(12)]
    texts = []
    for i in range(n):
        lines = [f"own {i} {j}" for j in range(rng.randrange(4))] + rng.choices(shared, k=rng.randrange(6))
        lines += [rng.choice(["  ALL of them \t", "all of them", "\x0ball OF them\r"])] * rng.randrange(1, 4)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    return [*texts, None, "", "\n\n", "  ", "É\né", "x" * 5000 + "\n" + "y\n" * 3000, *texts[:5]]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_equal_brute_force(spark, parts):
    """A line of all documents is spread over the ranges; ids may be null or repeat."""
    docs = [(None if i % 9 == 0 else i // 2 if i % 5 == 0 else i, t) for i, t in enumerate(line_texts())]
    rows = [(i, t, "other", 1) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, version string, lines int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in line_dedup.op11(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain_lines(docs, line_dedup.MIN_DOCS), key=key)


def test_bitmaps_keep_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, version string, keep string, lines int"
    rows = [(i, f"same\nown {i}", "v", "k", 1) for i in range(10)] + [(None, None, "v", "k", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert kept.columns == ["doc_id", "text", "version", "keep", "lines"]
    found = {r["doc_id"]: r for r in kept.collect()}
    assert found[3]["text"] == "own 3" and found[3]["version"] == "v" and tuple(found[3]["lines"]) == (2, 1)
    assert found[None]["text"] is None and tuple(found[None]["lines"]) == (1, 0)
    assert line_dedup.op11(docs.limit(0)).collect() == []


@given(st.integers(1, 400), st.sets(st.integers(0, 399)))
@settings(max_examples=60, deadline=None)
def test_bitmaps_round_trip(n, dropped):
    dropped = sorted(d for d in dropped if d < n)
    keep = unpack(pack(n, np.array(dropped, np.int64)))
    assert len(keep) == n and np.flatnonzero(~keep).tolist() == dropped


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 8), st.integers(0, 2)), max_size=60), st.data())
@settings(max_examples=80, deadline=None)
def test_ranges_stream_alike_in_any_batches_and_cuts(rows, data):
    """Lines in ranges that end anywhere between documents, batches that end anywhere."""
    rows, least = sorted(set(rows)), 4
    ends = [i for i in range(1, len(rows)) if rows[i][:2] != rows[i - 1][:2]]
    cuts = sorted(data.draw(st.sets(st.sampled_from(ends)))) if ends else []
    gone, open_, counts = set(), {}, {}
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        state, tables, i = Range(least), [], a
        while i < b:
            j = data.draw(st.integers(i + 1, b))
            part = [{"high": h, "low": 0, "doc_id": d, "version": 0, "n_lines": 3, "pos": p} for h, d, p in rows[i:j]]
            tables += state.feed(pa.Table.from_pylist(part, LINE_SCHEMA))
            i = j
        for table in [*tables, *state.end()]:
            for r in table.to_pylist():
                if r["docs"] is not None:
                    counts[r["high"]] = counts.get(r["high"], 0) + r["docs"]
                elif r["high"] is None:
                    gone.add((r["doc_id"], r["pos"], len(gone)))
                else:
                    open_.setdefault(r["high"], []).append((r["doc_id"], r["pos"]))
    got = sorted([g[:2] for g in gone] + [x for h, found in open_.items() if counts[h] >= least for x in found])
    docs = {h: {d for x, d, _ in rows if x == h} for h, _, _ in rows}
    assert got == sorted((d, p) for h, d, p in rows if len(docs[h]) >= least)


def whole(vec, scale):
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [max(-(1 << 24), min(1 << 24, math.floor(scale * x))) for x in vec]


def lloyd(x, entries, rounds):
    """Full search; ties to the lower index, floored means, empty entries stay."""
    def assign():
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = assign()
        for e in range(len(entries)):
            if (own == e).any():
                entries[e] = x[own == e].sum(0) // (own == e).sum()
    return assign(), entries


def vector_rows(n, dim, seed, odd=True):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.3, (6, dim))
    vecs = [(centers[i % 6] + rng.normal(0, 0.1, dim)).astype(np.float32).tolist() for i in range(n)]
    rows = [(i * 3 % 1009, v, None if i % 11 == 0 else i % 4) for i, v in enumerate(vecs)]
    if odd:
        rows += [rows[0], rows[1], (rows[-1][0], vecs[2], 1), (None, vecs[1], 2), (None, vecs[0], None)]
        rows += [(2000, None, 1), (2001, [None] * dim, 1), (2002, [float("nan")] * dim, 0), (2003, [float("inf")] * dim, 0)]
        rows += [(2004, [], 0), (2005, vecs[0][:-1], 0), (2006, [3e38] * dim, 3), (2007, [-3e38] * dim, 3)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, values string, codes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("n, dim", [(5, 16), (300, 32), (700, 64)])
def test_codes_equal_full_search(spark, n, dim):
    rows = vector_rows(n, dim, n)
    kept = [(i, v, lab) for i, vec, lab in rows if (v := whole(vec, 256)) is not None and len(v) == dim]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    x, width = np.array([v for _, v, _ in kept], np.int64), dim // 16
    start = np.array(list(first.values())[:64], np.int64)
    codes, error, entries = [], np.zeros(len(x), np.int64), []
    for p in range(16):
        cut = slice(p * width, (p + 1) * width)
        (own, best), e = lloyd(x[:, cut], start[:, cut].copy(), 2)
        codes.append(own)
        error += best
        entries.append(e)
    sha = hashlib.sha256(",".join(str(c) for e in entries for c in e.ravel()).encode()).hexdigest()
    by_label = {}
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] = by_label.get(lab, 0) + int(e)
    want = [
        (i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by_label[lab], sha) for k, (i, _, lab) in enumerate(kept)
    ]
    got = [tuple(r) for r in vector_codes.op12(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_rings_compare_less_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 6, (200, 4)) for c in (0, 80, 160, 240)]).astype(np.int64)
    entries = np.stack([x[:16], x[200:216]]).astype(np.int64)  # two part positions with the same parts
    entries[0, 3] = entries[0, 5]  # equal entries
    own = np.stack([vector_codes.full_search(x, e)[0] for e in entries])
    new = np.stack([np.array([x[own[p] == e].sum(0) // max(1, (own[p] == e).sum()) if (own[p] == e).any() else entries[p, e] for e in range(16)]) for p in range(2)])
    far = np.stack([[((x[own[p] == e] - entries[p, e]) ** 2).sum(1).max(initial=0) for e in range(16)] for p in range(2)])
    went = ((new - entries) ** 2).sum(2)
    radius = np.ceil((np.sqrt(far) + np.sqrt(went)) ** 2 + 1).astype(np.int64)
    balls = vector_codes.balls_of(new, radius, went > 0)
    for p in range(2):
        code, best, compared = vector_codes.ring_search(x, own[p], new[p], balls.near[p], balls.gaps[p])
        want = vector_codes.full_search(x, new[p])
        assert (code == want[0]).all() and (best == want[1]).all()
        assert compared < len(x) * 15
    still = vector_codes.balls_of(new, radius, np.zeros_like(went, bool))
    assert (still.gaps == vector_codes.FAR).all()  # nothing moved, nothing is looked at


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [], None)], [(1, [1.0] * 15, None)]):
        assert vector_codes.op12(frame(spark, rows)).collect() == []


@pytest.mark.parametrize("n", [3, 400])
def test_clusters_equal_full_search(spark, n):
    rows = vector_rows(n, 64, n + 1)
    kept = [(i, v) for i, vec, _ in rows if (v := whole(vec, 64)) is not None and len(v) == 64]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(r[0]), r[1]))
    x = np.array([v for _, v in kept], np.int64)
    (own, best), c = lloyd(x, np.array([v for _, v in order[:16]], np.int64), 3)
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    total = int(best.sum())
    want = [
        (i, int(own[k]), int(best[k]), int(best[own == own[k]].sum()), total, names[own[k]]) for k, (i, _) in enumerate(kept)
    ]
    got = [tuple(r) for r in vector_clusters.op13(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 63, None)]):
        assert vector_clusters.op13(frame(spark, rows)).collect() == []


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_cells_round_trip_and_intervals_hold(spark, bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-40, 40, (300, 5)).astype(np.int64)
    x[:, 2] = 7  # one value only
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "values array<int>")
    grid = vector_clusters.grid_of(rows, 5, bits)
    cells = grid.cells(x)
    assert (vector_clusters.unpack_cells(vector_clusters.pack_cells(cells, bits), 5, bits) == cells).all()
    at = (np.arange(5)[None], cells)
    assert (grid.low[at] <= x).all() and (x <= grid.high[at]).all()
    centroids = x[:7]
    least, most = vector_clusters.tables(grid, centroids)
    amid = centroids.sum(0) // 7
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2) - ((x - amid) ** 2).sum(1)[:, None]
    assert (sum(least[d][cells[:, d]] for d in range(5)) <= exact).all()
    assert (sum(most[d][cells[:, d]] for d in range(5)) >= exact).all()
    found, fetched = vector_clusters.nearest(lambda r: x[r], cells, least, most, centroids)
    assert (found == exact.argmin(1)).all() and len(fetched) <= len(x)


def test_clear_clusters_need_few_full_vectors(spark):
    rng = np.random.default_rng(5)
    vecs = [(np.eye(16, 64)[i % 16] * 3 + rng.normal(0, 0.05, 64)).tolist() for i in range(800)]
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    found = vector_clusters.cluster(frame(spark, rows))
    assert len(found.fetched) == 3 and found.fetched[-1] < 400
