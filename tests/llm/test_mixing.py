import re
from collections import defaultdict

import pytest
from rows import clashing, docs, empty

from rasterlake.llm import mixing


def targets(sizes, passes=3):
    """By resharing, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(passes * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: passes * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > passes * sizes[s]}
        if not over:
            return out
        full |= over


def many(n=400):
    return [(i, "w " * (i % 17 + 1), "en", ["a", "b", "c", None][(i * i) % 7 % 4]) for i in range(n)] + [(9999, "one", "en", "zz")]


@pytest.mark.parametrize("rows", [many(), many(40)])
def test_targets_and_taken(spark, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in mixing.plan_passes(docs(spark, rows)).collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.passes <= 3 and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.passes * r.size
    for source, n in taken.items():
        assert abs(n - want[source]) <= 17


def test_positions_follow_the_schedule(spark):
    """Of a light source, three quarters of the demand lie where the integral of its falling schedule says."""
    rows = [(i, "w w w", "en", ["a", "b", "c"][i % 3]) for i in range(3000)]
    positions = [p for r in mixing.plan_passes(docs(spark, rows)).filter("source = 'a'").collect() for p in r.positions]
    early = sum(p <= 0.5 for p in positions) / len(positions)
    assert early == pytest.approx(1.5 * 0.5 - 0.5 * 0.25, abs=0.01)


def test_rows_as_often_as_planned_and_sorted(spark):
    rows = clashing(spark)
    plan = {(r.doc_id, r.source): r.passes for r in mixing.plan_passes(rows).collect()}
    mixed = mixing.mix_documents(rows)
    assert mixed.columns == rows.columns
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id, r.source] += 1
    assert found == {k: n * (2 if k[0] == 7 else 1) for k, n in plan.items() if n}
    assert (3, "a") not in found and (4, "a") not in found


def test_reruns_agree_and_empty(spark):
    first = mixing.mix_documents(docs(spark, many())).select("doc_id").collect()
    assert first == mixing.mix_documents(docs(spark, many()[::-1]).repartition(7)).select("doc_id").collect()
    assert mixing.plan_passes(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_repeated_rows_come_back_each(spark):
    """Rows that are the same are planned together; the query shows each, so that a source's taken words add up to its target."""
    from rasterlake.llm import queries

    rows = [(i, f"word{i} " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(40)] + [(4, "word4 " * 5, "en", "a")] * 3
    got = queries.mix_rows(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= 20 and all(r.taken <= 3 * r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == mine[0].source_size
