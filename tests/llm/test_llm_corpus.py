"""Operators over whole corpora, against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from scribeloom.llm import bm25, jaccard_join, long_repeats, mixing, quality, shingles, url_filter
from scribeloom.llm.components import components
from scribeloom.scale import materialize

SMALL = "/root/testdata/sf0.001"


def corpus(n=60, seed=5):
    """Texts with exact and near copies, shared passages, odd and empty ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=45))
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 160))) for _ in range(n)]
    texts += [t.replace("w1", "W1") for t in texts[:10]] + texts[:5]
    for t in texts[10:30]:
        w = t.split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices(words, k=12)) + " " + passage + " " + " ".join(rng.choices(words, k=12)) for _ in range(15)]
    return [*texts, None, "", " ", "a", "A", "a b", "x" * 350, "x" * 350, "ab" * 300, None]


def docs_of(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "other", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node string, label int")


def plain_set(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, hot):
    if hot:  # groups in many blocks, many packed rows
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
        monkeypatch.setattr(jaccard_join, "CHUNK_SIGNATURES", 50)
    texts = corpus(seed=6 if hot else 5)
    sets = [plain_set(t) for t in texts]
    want = plain_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op10(docs_of(spark, texts)).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_sketches_tell_large_sets_apart():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64)) for _ in range(2))
    differ = np.bitwise_count(np.frombuffer(jaccard_join.sketch_of(a), np.uint64) ^ np.frombuffer(jaccard_join.sketch_of(b), np.uint64)).sum()
    assert not jaccard_join._may_link(len(a), len(b), int(differ))
    some = np.unique(np.concatenate([a[:1900], b]))  # a sketch twice as wide
    assert jaccard_join._differences([jaccard_join.sketch_of(a), jaccard_join.sketch_of(some)], np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, some))


def test_many_near_copies_are_compared_in_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = []
    for _ in range(600):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    seen = Counter()
    store = jaccard_join.materialize

    def spied(df, label="step"):
        found = store(df, label)
        seen[label] += found.count() if label in ("probed", "rest") else 0
        return found

    monkeypatch.setattr(jaccard_join, "materialize", spied)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    want = plain_components([plain_set(t) for t in texts])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.op10(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    assert sum(seen.values()) < 4 * len(texts), seen


def test_sets_with_few_shared_shingles_are_not_signed(spark, monkeypatch):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(70)
    texts = [" ".join(passage + fresh(30)) for _ in range(120)]  # alike, but none links
    whole = fresh(100)
    texts += [" ".join(whole), " ".join(whole[1:]), " ".join(whole[:-1])]
    seen, store = Counter(), jaccard_join.materialize

    def spied(df, label="step"):
        found = store(df, label)
        seen[label] = found.select("node").distinct().count() if label == "signatures" else 0
        return found

    monkeypatch.setattr(jaccard_join, "materialize", spied)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 500, raising=False)  # equal shingles in many chunks
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.op10(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(plain_components([plain_set(t) for t in texts])))
    assert seen["signatures"] == 3


def test_keep_one_keeps_columns(spark):
    docs = docs_of(spark, corpus())
    kept = jaccard_join.keep_one(docs)
    want = plain_components([plain_set(r["text"]) for r in sorted(docs.collect())])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_null_ids_and_repeated_rows_are_components_like_others(spark):
    rng = random.Random(9)
    words = [[f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "abcd"]
    text = lambda k, *cut: " ".join(w for i, w in enumerate(words[k]) if i not in cut)
    chain = [text(0), text(0, *range(6)), text(0, *range(12))]  # neighbours link, the ends do not
    rows = [
        (1, chain[0], "x"), (None, chain[1], "x"), (2, chain[2], "x"), (None, text(1), "x"), (5, text(1, 0), "x"),
        (None, text(2), "x"), (None, text(2), "y"), (None, text(2, 0), "x"), (7, text(3), "x"), (7, text(3), "y"), (7, text(3, 0), "x"),
        (7, "alone", "x"), (None, None, "x"), (8, " ", "x"), (8, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.op10(docs).collect())
    assert got == Counter({(1, 1): 1, (None, 1): 1, (2, 1): 1, (None, 5): 1, (5, 5): 1, (None, None): 4, (7, 7): 4, (8, 8): 2})
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect()]
    groups = [{(1, chain[0])}, {(5, text(1, 0))}, {(None, text(2)), (None, text(2, 0))}, {(7, text(3)), (7, text(3, 0))}, {(7, "alone")}, {(None, None)}]
    assert [sum(k in g for k in kept) for g in groups] == [1] * 6 and kept.count((8, " ")) == 2 and len(kept) == 8


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(1)
    for size in [5, 6, 9, 14, 30, 77, 200, 900]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            drop = int(rng.integers(0, size // 9 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, drop).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    texts = corpus() + ["é Ü " * 90]
    whole = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(s) for s in whole] == [len(plain_set(t)) for t in texts]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(pa.array(texts)), strict=True))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def plain_removed(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - long_repeats.LENGTH + 1):
            s = text[i : i + long_repeats.LENGTH]
            if s in seen:
                gone[i : i + long_repeats.LENGTH] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        out[doc_id] = (len(text), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_long_repeats_equal_brute_force(spark, monkeypatch, hot):
    if hot:  # every k-gram dealt by the bytes between, many small indexes, parts of long texts
        for name, value in {"HOT_RUNS": 2, "HOT_SHARE": 1 << 40, "INDEX_BYTES": 400, "CHUNK": 150}.items():
            monkeypatch.setattr(long_repeats, name, value)
    texts = corpus(seed=8)
    texts += [texts[3][5:] + " tail", "é" * 130, "é" * 80 + texts[4]]
    got = {r["doc_id"]: tuple(r)[1:] for r in long_repeats.op2(docs_of(spark, texts)).collect()}
    assert got == plain_removed([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_long_repeats_of_repeated_rows_and_nulls(spark):
    text = "".join(random.Random(1).choices("abc ", k=300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:150]), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in long_repeats.op2(docs).collect()))
    assert got == [(0, 150, 0), (1, 300, 150), (1, 300, 150), (2, 0, 0)]
    assert long_repeats.op2(docs.limit(0)).count() == 0


def test_run_index_streams_what_matches_earlier():
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab") for _ in range(160))
    pieces = list(dict.fromkeys([base[:140], b"z" + base[:150], base[20:] + b"qq", b"a" * 150, b"a" * 160, b"\x00" * 130, base[:100]]))
    seen, want = set(), []
    for p in pieces:
        flags = []
        for i in range(len(p) - 99):
            flags.append(p[i : i + 100] in seen)
            seen.add(p[i : i + 100])
        want.append(flags)
    index = long_repeats.RunIndex(pieces)
    assert [f.tolist() for f in index.stream(pieces)] == want
    assert len(index.starts) < index.size / 2  # runs, not rows


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randrange(0, 40)) for _ in range(900)]
    rows = [(i, t, "big" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 5}", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    first = {r["doc_id"]: r for r in mixing.op5(docs).collect()}
    assert {r["doc_id"]: r for r in mixing.op5(docs.repartition(7)).collect()} == first
    total, by = sum(r["size"] for r in first.values()), defaultdict(list)
    for i, _, source, _ in rows:
        by[source].append(first[i])
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted((s for s in by if s), key=str) + [None])}
    targets, open_, left = {}, dict(weights), float(total)
    while True:  # caps are met one after the other
        over = {s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * sum(r["size"] for r in by[s])}
        if not over:
            break
        for s in over:
            targets[s] = 3.0 * sum(r["size"] for r in by[s])
        left, open_ = total - sum(targets.values()), {s: w for s, w in open_.items() if s not in targets}
    targets |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s, found in by.items():
        assert found[0]["target"] == pytest.approx(targets[s])
        assert abs(sum(r["taken"] for r in found) - targets[s]) <= 80
        assert all(r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0 for r in found)
        assert all(r["taken"] <= 3 * r["size"] for r in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: r["taken"] // r["size"] for i, r in first.items() if r["taken"]})


def test_mix_cut_in_rounds_is_the_same(spark, monkeypatch):
    docs = docs_of(spark, corpus())
    whole = sorted(mixing.op5(docs).collect())
    monkeypatch.setattr(mixing, "CUT_ROWS", 3)
    monkeypatch.setattr(mixing, "CUT_BUCKETS", 4)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(mixing.op5(docs).collect()) == whole
    assert mixing.op5(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text is null")).count() == 0


def test_mix_takes_each_row_of_one_id_by_itself(spark):
    """Rows of one id, equal or not, null and empty texts: the mix holds what op5 says."""
    rows = [(1, "a b c", "s", 0), (1, None, "s", 1), (1, "", "s", 2), (2, "d e", "s", 3), (2, "d e", "s", 4), (2, "d e", "t", 5),
            (None, "f g", "s", 6), (None, "f g", "s", 6), (None, "h i j k", None, 7), (3, "d e", "t", 8), (4, "l", "t", 9)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, source string, number int")
    size = lambda t: len((t or "").split())
    want = Counter()
    for r in mixing.op5(docs).collect():
        if r["taken"]:
            want[(r["doc_id"], r["size"], r["target"])] += r["taken"] // r["size"]
    target = {r["key"]: r["target"] for r in mixing.taken(docs).collect()}
    mixed = mixing.mix(docs)
    got = Counter((r["doc_id"], size(r["text"]), target[f"s{r['source']}" if r["source"] else "n"]) for r in mixed.collect())
    assert mixed.columns == docs.columns and got == want
    assert sum(size(r["text"]) for r in mixed.collect()) <= sum(size(t) for _, t, _, _ in rows) * 3


def test_a_shard_is_opened_in_little_memory():
    rng = np.random.default_rng(3)
    dfs = np.full(2000, 200)
    docs = np.concatenate([np.sort(rng.choice(4000, n, replace=False)) for n in dfs]).astype(np.int32)
    counts = rng.integers(1, 9, len(docs)).astype(np.int32)
    row = {"doc_ids": list(range(4000)), "lengths": rng.integers(1, 500, 4000), "terms": [f"t{i}" for i in range(len(dfs))], "dfs": dfs, "docs": docs.tobytes(), "counts": counts.tobytes()}
    tracemalloc.start()
    shard = bm25.Shard(row, 250.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(docs)
    tf, length = counts.astype(float), row["lengths"][docs]
    assert np.allclose(shard.weight, tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * length / 250)), rtol=1e-14)
    for term in (0, 7, 1999):  # entries of a term cover its postings, block by block
        first, last = shard.entries[term], shard.entries[term + 1]
        assert (shard.begins[first], shard.begins[last]) == (200 * term, 200 * term + 200)
        assert shard.block[first:last].tolist() == sorted(set((docs[200 * term : 200 * term + 200] // bm25.BLOCK).tolist()))


@pytest.mark.parametrize("pruned", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, pruned):
    if pruned:
        monkeypatch.setattr(bm25, "BLOCK", 2)
        monkeypatch.setattr(bm25, "FIRST_BLOCKS", 1)
        monkeypatch.setattr(bm25, "SHARD_BYTES", 4000)
    texts = corpus(n=150)
    docs = docs_of(spark, texts).select("doc_id", "text")
    counts = [Counter(bm25.terms_of(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    mean, df, n = sum(sizes) / len(texts), Counter(t for c in counts for t in c), len(texts)
    want = set()
    for q in range(0, n, 20):
        scores = []
        for d, c in enumerate(counts):
            s = 0.0
            for t in sorted(counts[q]):
                if t in c:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sizes[d] / mean))
            if s:
                scores.append((-round(s, 7), d))
        want |= {(q, k + 1, d) for k, (_, d) in enumerate(sorted(scores)[:4])}
    got = bm25.search(docs, docs.where("doc_id % 20 = 0"), k=4).collect()
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in got} == want
    assert bm25.search(docs.limit(0), docs.limit(0)).count() == 0


def test_queries_meet_many_shards_without_a_shuffle(spark, monkeypatch):
    """Null and repeated ids, ties over shards, blocks of queries: as with one shard, and
    a task gives the best k of all its shards."""
    texts = corpus(n=60)
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)] + [(100 + i, "same words here") for i in range(30)] + [(7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = docs.where("doc_id % 10 = 0 or doc_id is null")
    one = sorted(map(str, bm25.search(docs, queries, k=5).collect()))
    for name, value in (("SHARD_BYTES", 2000), ("QUERY_TERMS", 100), ("BLOCK", 2), ("FIRST_BLOCKS", 1)):
        monkeypatch.setattr(bm25, name, value)
    stored, keep = {}, bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, label: stored.setdefault(label, []).append(keep(df, label)) or stored[label][-1])
    found = bm25.search(docs, queries, k=5)
    assert sorted(map(str, found.collect())) == one
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    shards, tasks = stored["index"][0].count(), stored["index"][0].rdd.getNumPartitions()
    asked = queries.where("text is not null and text <> ''").distinct().count()
    assert len(stored["found"]) > 3 and shards > tasks
    assert 0 < sum(f.count() for f in stored["found"]) <= asked * tasks


def test_url_rules_by_date(spark):
    rows = [("d:a.org", "2024-01-05", True, 1), ("d:a.org", "2024-03-05", False, 2), ("d:a.org", "2024-03-05", True, 3), ("d:a.org", "2024-04-01", False, 4),
            ("f:b.a.org/x", "2024-02-01", True, 5), (None, "2024-01-01", True, 6), ("d:c.org", None, True, 7)]
    entries = spark.createDataFrame(rows, "rule string, ts string, added boolean, seq long").selectExpr("rule", "cast(ts as timestamp) ts", "added", "seq")
    urls = [(1, "https://u:p@B.A.org:80/x/y", "2024-02-02"), (2, "http://a.org", "2024-01-04"), (3, "http://a.org", "2024-03-31"), (4, "http://a.org/", "2024-04-01"),
            (5, "http://nota.org/", "2024-03-01"), (6, None, "2024-03-01"), (7, "http://a.org", None), (8, "junk", "2024-02-02"), (1, "https://u:p@B.A.org:80/x/y", "2024-02-02")]
    captures = spark.createDataFrame(urls, "page_id long, url string, at string").selectExpr("page_id", "url", "cast(at as timestamp) fetched_at", "1 as n")
    got = sorted((r["page_id"], r["n_rules"], r["rule"]) for r in url_filter.evaluate(captures, entries).collect())
    assert got == [(1, 2, "f:b.a.org/x"), (1, 2, "f:b.a.org/x"), (2, 0, None), (3, 1, "d:a.org"), (4, 0, None), (5, 0, None), (6, 0, None), (7, 0, None), (8, 0, None)]
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in quality.op3(docs).where("kept").collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = frames[name] = materialize(stage(spark, docs, SMALL), name)
        assert name == "encode" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in frames[name].collect()]
    assert set(ids("quality_rules")) == kept
    sets = {r["doc_id"]: plain_set(r["text"]) for r in frames["quality_rules"].collect()}
    order = sorted(sets)
    want = plain_components([sets[i] for i in order])
    assert sorted(ids("near_duplicates")) == sorted({order[i] for i in want})
    assert sorted(ids("secrets")) == sorted(ids("near_duplicates"))
    assert set(ids("mix")) <= set(ids("secrets")) and max(Counter(ids("mix")).values()) <= 3
    assert sorted(ids("encode")) == sorted(ids("mix"))
