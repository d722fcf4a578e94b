import hashlib
from collections import defaultdict

import pytest
from rows import DOCS, clashing, docs, empty, key

from rasterlake.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("hot,tracked", [(1000, 65_536), (1, 8)])
def test_marks(spark, hot, tracked):
    got = exact_dedup.mark_copies(docs(spark), hot=hot, tracked=tracked)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == brute(DOCS)


def test_one_row_of_each_text_stays(spark):
    rows = clashing(spark)
    left = exact_dedup.drop_copies(rows)
    assert left.columns == rows.columns
    got = left.collect()
    texts = [r.text or "" for r in got]
    assert sorted(texts) == sorted({r[1] or "" for r in DOCS})
    assert {r.doc_id for r in got} == {10, 4, 5, 6, 7, None, 9}


def test_empty(spark):
    assert exact_dedup.mark_copies(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_shuffle_way(spark, monkeypatch):
    from rasterlake.llm import common

    monkeypatch.setattr(common, "sized", lambda df, limit=0: df)
    assert sorted((r.doc_id for r in exact_dedup.drop_copies(docs(spark)).collect()), key=str) == sorted(
        [10, 4, 5, 6, 7, None, 9], key=str
    )
