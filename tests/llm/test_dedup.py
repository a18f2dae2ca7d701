"""Near-duplicates, repeated passages, embeddings, components: against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from rillstone.llm import embedding_dedup, simhash, substring_dedup
from rillstone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7)]
    want = groups({x for p in pairs for x in p}, pairs)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(want[i] == c for i, c in got.items()) and all(i in got for p in pairs if p[0] != p[1] for i in p)


def slow_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints(odd_docs):
    for r in odd_docs.where("text is null or length(text) < 5000").collect():
        assert simhash.fingerprint(r.text) == slow_fingerprint(r.text)


@pytest.mark.parametrize(("shard", "block"), [(16, 32), (100_000, 64), (8, 8)])
def test_near_fingerprints_are_all_linked(spark, shard, block):
    rnd = random.Random(9)
    values = {rnd.getrandbits(64) for _ in range(700)}
    center = rnd.getrandbits(64)
    values |= {center ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(64)) for _ in range(200)} | {center ^ (rnd.getrandbits(12) << 40) for _ in range(300)}
    for v in rnd.sample(sorted(values), 200):
        for _ in range(rnd.randint(1, 4)):
            v ^= 1 << rnd.randrange(64)
            values.add(v)
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    edges = simhash.near_edges(spark.createDataFrame(rows, "fp long, rep long"), shard=shard, block=block)
    u = np.array(values, np.uint64)
    near = [(i, j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1]
    want = groups(range(len(u)), near)
    got = groups(range(len(u)), [(r.a, r.b) for r in edges.collect()])
    assert got == want


def test_simhash_query(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == by[None] == {("0" * 16, 1)} and by[4] == by[5] and by[7] == by[6] and len(by[13]) == 1
    assert simhash.near_duplicates(no_docs).count() == 0


# -- repeated passages -----------------------------------------------------------------------------------------------


def slow_removal(rows):
    lists = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in lists for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_passages(spark, odd_docs, no_docs, docs):
    rnd = random.Random(4)
    passages = [[f"p{rnd.randrange(50)}" for _ in range(n)] for n in (35, 36, 50, 90, 200)]
    made = []
    for i in range(60):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "edited"
            w[rnd.randrange(len(w) + 1) : 0] = p[rnd.randrange(3) :]
        made.append((100 + i, " ".join(w)))
    frames = [odd_docs.select("doc_id", "text"), docs.select("doc_id", "text"), spark.createDataFrame(made, "doc_id long, text string")]
    frames.append(frames[0].union(frames[2]))
    for df in frames:
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, substring_dedup.deduplicated(df).collect()), key=str) == slow_removal(rows)
    assert substring_dedup.deduplicated(no_docs).count() == 0


def test_removed_keeps_columns(odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 as key", "2 as marks", "3 as c1", "4 as `row`", "5 as __key")
    out = substring_dedup.removed(clash)
    assert out.columns == clash.columns and out.schema["c1"].dataType.typeName() == "integer" and {tuple(r)[-5:] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert substring_dedup.removed(no_docs).count() == 0
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[8] == "" and texts[9] == "x y z q r s" and texts[1] is None and texts[14].count("\n") == 4 and texts[13] == ""


def test_index_grows_by_batches_of_several_sessions(spark, docs, tmp_path):
    rows = substring_dedup.keyed(docs, "doc_id", "text").select("key", "text").cache()
    folder = f"file://{tmp_path}/index"
    plans = []
    for b in range(5):
        index = substring_dedup.FingerprintIndex(spark.newSession(), folder, buckets=3)
        index.ingest(rows.where(f"pmod(key, 5) = {b}"))
        for run, _ in index.state["runs"][:-1]:
            plans.append(index.merged(run, index.state["runs"][-1][0])._jdf.queryExecution().executedPlan().toString())
            plans.append(index.repeating(index.state["runs"][-1][0], [run])._jdf.queryExecution().executedPlan().toString())
    assert plans and all("SortMergeJoin" in p and "Exchange" not in p for p in plans)
    index = substring_dedup.FingerprintIndex(spark.newSession(), folder)
    assert index.state["batches"] == 5 and [t for _, t in index.state["runs"]] == [2, 0] and index.state["buckets"] == 3
    counts = collections.Counter()
    for r in substring_dedup.postings_of(rows).collect():
        counts.update(r.anchors)
    held = collections.Counter()
    for run, _ in index.state["runs"]:
        held.update({r.anchor: r.n for r in index.run(run).collect()})
    assert held == counts
    marks = lambda df: {r.key: sorted(map(tuple, r.marks)) for r in df.collect()}
    got = marks(substring_dedup.removal_marks(rows, index.repeated().sparkSession.createDataFrame(index.repeated().collect(), "key long, anchors array<long>")))
    assert got and got == marks(substring_dedup.marked_at_once(rows))
    newest = {r.key for r in rows.where("pmod(key, 5) = 4").collect()}
    late = {r.key: set(r.anchors) for r in index.repeated(since=4).collect()}
    own = {r.key: set(r.anchors) for r in substring_dedup.postings_of(rows.where("pmod(key, 5) = 4")).collect()}
    want = {a for k in newest for a in own[k] if counts[a] > 1}
    assert set().union(*late.values()) == want
    index.drop()


def test_long_runs_of_one_anchor(spark):
    rows = [(1, "a " * 400), (2, "b c " * 90 + "d"), (3, "x y z " + "b c " * 40), (4, "a " * 34), (5, " ".join(f"u{i}" for i in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.deduplicated(df).collect()), key=str) == slow_removal(rows)


def test_spans_by_doubling():
    h = np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64)
    for n in (1, 2, 3, 8, 35):
        want = np.zeros(100 - n + 1, np.uint64)
        for k in range(n):
            want = want * np.uint64(substring_dedup.BASE) + h[k : k + 101 - n]
        assert (substring_dedup.spans_of(h, n) == want).all()
    assert len(substring_dedup.spans_of(h[:10], 35)) == 0
    assert (substring_dedup.sliding(h, 28, np.minimum) == np.array([h[i : i + 28].min() for i in range(73)])).all()


# -- embeddings ------------------------------------------------------------------------------------------------------


def test_collisions_are_counted_by_windows():
    rnd = np.random.default_rng(3)
    proj = rnd.standard_normal((300, 20)).astype(np.float32)
    proj[150:] = proj[:150] + rnd.standard_normal((150, 20)).astype(np.float32) * np.float32(0.2)
    proj[10] = proj[11]
    a, b = embedding_dedup.collisions(proj, 0.5, 8, 5, 13)
    hits = np.abs(proj[:, None] - proj[None]) <= np.float32(0.5)
    want = (hits[:, :, :8].sum(axis=2) >= 5) & (hits.sum(axis=2) >= 13)
    near = proj[:, None, :8] + np.float32(0.5)  # rounding at a window's very edge may differ
    edge = (np.abs(np.abs(proj[:, None] - proj[None]) - 0.5) < 1e-5).any(axis=2)
    assert near.size and {(i, j) for i, j in zip(*np.nonzero(want & ~edge)) if i < j} <= set(zip(a.tolist(), b.tolist())) and all(want[i, j] or edge[i, j] for i, j in zip(a, b)) and len(a) > 100


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.8])
def test_cuts_keep_pairs_of_labels_that_lie_close_together(mean):
    """Pairs at the threshold share a cell, whatever the mean cosine of a label."""
    rnd = np.random.default_rng(8)
    dim, n = 64, 4000
    x = rnd.standard_normal((n, dim))
    x = np.sqrt(mean) * np.eye(dim)[0] + np.sqrt(1 - mean) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x = embedding_dedup.units(x)
    y = rnd.standard_normal((n, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * embedding_dedup.units(y)
    center = x.mean(axis=0)
    bits, rounds = embedding_dedup.cuts_for(300_000, 1 - center @ center, embedding_dedup.CELL, 0.93, embedding_dedup.CELL_RECALL)
    assert bits >= 3
    drawn = embedding_dedup.lines(dim, bits * rounds, 5)
    side = [((z - center) @ drawn > 0).reshape(n, rounds, bits) for z in (x, y)]
    assert (side[0] == side[1]).all(axis=2).any(axis=1).mean() >= 0.975


@pytest.mark.parametrize(("cell", "block"), [(40, 1000), (100_000, 64)])
def test_embeddings(spark, cell, block):
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(40):
        center = rnd.standard_normal(32)
        for _ in range(12):
            rows.append((len(rows), (center + rnd.standard_normal(32) * rnd.choice([0.1, 0.25, 0.4])).astype(np.float32).tolist(), int(i % 3)))
    rows += [(len(rows) + i, rows[5][1], 1) for i in range(90)] + [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, rows[5][1], None), (9003, [float("nan")] * 32, 1), (9004, [None] * 32, 1), (9005, [1.0] * 5, 1), (None, rows[5][1], 1), (9006, [], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, codes int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, cell=cell, block=block).collect()}
    good = [r for r in rows if r[0] is not None and (r[0] < 9000)]
    x = np.array([r[1] for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    have = np.array([got[r[0]].n_links for r in good])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    comps = groups([r[0] for r in good], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert sum(comps[r[0]] != got[r[0]].component_id for r in good) <= 0.03 * len(good)
    for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and len(got) == len(rows)


def test_no_embeddings(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
