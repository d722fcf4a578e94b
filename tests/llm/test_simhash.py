import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from rows import DOCS, clashing, docs, empty

from rasterlake.llm import simhash

RULE = simhash.Rule(shingle=4, words=1, distance=4)


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def groups_of(points, distance):
    """Connected groups of two or more by comparing all pairs."""
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, points[j])) <= distance:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, a in enumerate(points):
        groups[find(i)].add("".join(f"{int(x):016x}" for x in a))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_fingerprints_and_components(spark):
    base = [f"word{i} and some other words number {i * 7} for this text to be long enough {i}" for i in range(12)]
    texts = [*base, *[b.upper() for b in base[:4]], *[r[1] for r in DOCS], "É É É É É", "É É É É É x" * 50, "x"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_copies(docs(spark, rows), RULE).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == fps
    points = sorted({(int(f, 16),) for f in fps})
    group = {member: g for g in groups_of(points, 4) for member in g}
    for i, f in enumerate(fps):
        near = group.get(f, {f})
        assert got[i].component_id == min(j for j, other in enumerate(fps) if other in near)


@pytest.mark.parametrize("words,distance,hot", [(1, 4, 20_000), (1, 4, 5), (2, 17, 20_000), (2, 17, 5)])
def test_links_lose_nothing(spark, words, distance, hot):
    rng = np.random.default_rng(words + hot)
    rule = simhash.Rule(5, words, distance)
    rows = [tuple(int(v) for v in r) for r in rng.integers(-(1 << 62), 1 << 62, (150, words))]
    for row in rows[:80]:
        for step in range(3):
            moved = list(row)
            for bit in rng.choice(62 * words, int(rng.integers(1, distance + 3)), replace=False):
                moved[bit // 62] ^= 1 << int(bit % 62)
            rows.append(tuple(moved))
            row = tuple(moved)
    rows = sorted(set(rows))
    table = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in simhash.names(rule)))
    found = defaultdict(set)
    for r in simhash.components(simhash.links(table, rule, hot)).collect():
        found[r.root] |= {r.root, r.fp}
    assert {frozenset(g) for g in found.values()} == groups_of([tuple(v % (1 << 64) for v in r) for r in rows], distance)


def test_large_groups(monkeypatch):
    """The way of large cells gives the groups of the matrix way."""
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, (40, 1), dtype=np.uint64)
    near = centre[:20] ^ (np.uint64(1) << rng.integers(0, 60, (20, 1), dtype=np.uint64))
    fps = np.unique(np.concatenate((centre, near)), axis=0)
    small = simhash._links(fps, 4)
    monkeypatch.setattr(simhash, "MATRIX", 8)
    large = simhash._links(fps, 4)
    assert {frozenset((int(a[0]), int(b[0]))) for a, b in zip(*small)} == {frozenset((int(a[0]), int(b[0]))) for a, b in zip(*large)}


def test_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "a string, b string")
    assert {(r.root) for r in simhash.components(edges).collect()} == {"0000"}
    assert simhash.components(edges.limit(0)).count() == 0


def test_groups_across_batches():
    import pyarrow as pa

    rule = simhash.Rule(4, 1, 4)
    fps = np.array([1, 3, 1 << 40, 7, 1 << 50], dtype=np.int64)
    batches = [
        pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0], pa.int32()), pa.array([int(f)])], ["key", "chunk", "fp0"])
        for k, f in zip([5, 5, 5, 5, 9], fps)
    ]
    pairs = {frozenset((a, b)) for out in simhash._verify(iter(batches), rule) for a, b in zip(*[c.to_pylist() for c in out.columns])}
    assert {x for p in pairs for x in p} >= {1, 3, 7} and not any(1 << 50 in p for p in pairs)


def test_one_of_each_group_stays(spark):
    rows = clashing(spark)
    left = simhash.drop_near_copies(rows)
    assert left.columns == rows.columns
    got = [r.doc_id for r in left.collect()]
    assert sorted(i for i in got if i is not None) == [1, 3, 6, 7, 9] and got.count(None) == 1
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_edited_copy_is_caught(spark):
    words = [f"{a}{b}" for a in "kmnprst" for b in ("ala", "ebe", "idi", "ofo", "ugu")] * 9
    text = " ".join(f"{w}{i % 41}" for i, w in enumerate(words))
    edited = text.replace(" kala0 ", " other ", 1) + " end"
    rows = [(1, text, None, None), (2, edited, None, None), (3, text[::-1], None, None)]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect()) == [1, 3]


def test_cells_lead_to_the_near_copies_of_the_stage(spark, monkeypatch):
    """Texts that meet at no key at all meet in the grid cells; pairs that the cells cover are left to them."""
    whole = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: whole(*a).withColumn("keys", F.array().cast("array<bigint>")))
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    rows = [(1, " ".join(words), None, None), (2, " ".join([*words, "end"]), None, None), (3, " ".join(words[::-1]), None, None)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("matrix", [1024, 2])
def test_links_above_a_distance(monkeypatch, matrix):
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    fps = np.array([[0], [0b11], [0b1111110], [(1 << 60) - (1 << 40)]], np.uint64)
    assert {(int(a[0]), int(b[0])) for a, b in zip(*simhash._links(fps, 6, 2))} == {(0b11, 0), (0b1111110, 0)}
    assert len(simhash._links(fps[:2], 6, 2)[0]) == 0 and len(simhash._links(fps[:2], 6)[0]) == 1


def test_links_of_the_stage_are_those_of_exact_similarity(spark, monkeypatch):
    """Words replaced in copies, some just above and some just below a similarity of 0.8, against comparing all pairs of sets."""
    rng = np.random.default_rng(3)
    texts = []
    for base in range(40):
        words = [f"w{int(x)}" for x in rng.integers(0, 3000, int(rng.integers(40, 300)))]
        texts.append(" ".join(words))
        for share in (0.005, 0.012, 0.02, 0.022, 0.025, 0.03, 0.05):
            copy = [w if rng.random() > share else f"new{int(rng.integers(1 << 30))}" for w in words]
            texts.append(" ".join(copy))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", *[" ".join([texts[0]] * n) for n in (2, 3)], "", " \t"]
    texts += [texts[8] + f" tail{i} of some words" for i in range(60)]  # more than are compared in one group
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    monkeypatch.setattr(simhash.similar_texts, "__defaults__", (20_000,))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_long_chains_leave_small_estimates(spark):
    """Each round joins tables twice; their estimated sizes are not multiplied from round to round."""
    n = 300
    edges = [(f"{i:04d}", f"{(i + 1):04d}") for i in range(n)] + [(f"x{i}", f"x{i}y") for i in range(3)] + [("z", "z")]
    found = simhash.components(spark.createDataFrame(edges, "a string, b string"))
    want = {(f"{i:04d}", "0000") for i in range(1, n + 1)} | {(f"x{i}y", f"x{i}") for i in range(3)}
    assert {(r.fp, r.root) for r in found.collect()} == want
    assert simhash.components(spark.createDataFrame([("z", "z")], "a string, b string")).count() == 0
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 62
