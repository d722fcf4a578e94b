import random
import re
from collections import Counter

import pytest
from rows import clashing, docs, empty

from rasterlake.llm import collocations

LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, support, longest, top):
    """All phrases counted one by one, then the rule as it is stated."""
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= support}
    rows = []
    for p, a in often.items():
        lang, w = p[0], p[1:]
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            q[0] == lang and len(q) > len(p) and c >= a and any(q[i:i + len(w)] == w for i in range(1, len(q))) for q, c in often.items()
        )
        if not inside:
            rows.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, rank, *r[1:]) for rank, r in enumerate(best, 1)]
    return sorted(out)


def made(seed, many=160):
    rng = random.Random(seed)
    signs = ["The", "of", "a", "b", "house", "Über", "é x", "1", "-"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", " \x0b"]
    rows = []
    for i in range(many):
        text = "".join(rng.choice(signs[:4 + i % 6]) + rng.choice(ends) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "a"))
    return rows + [(1, None, "en", "a"), (1, "", None, None), (None, "only the once", "xx", None), rows[5], rows[5], (7, "of the house " * 40, "fr", None)]


@pytest.mark.parametrize("seed, support, share, lowered", [(0, 8, 8, 0.4), (1, 3, 2, 1.0), (2, 5, 1, 1.0), (3, 4, 1_000_000, 0.4), (4, 20, 3, 0.1)])
def test_against_plain_rule(spark, seed, support, share, lowered):
    rows = made(seed)
    table = clashing(spark, rows) if seed == 2 else docs(spark, rows).repartition(3)
    got = collocations.collocations(table, support, 5, 9, share=share, lowered=lowered).collect()
    assert sorted(map(tuple, got)) == plain(rows, support, 5, 9)


def test_many_held_rows_and_a_trie_too_large(spark, monkeypatch):
    rows = made(5)
    want = plain(rows, 4, 5, 50)
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows), 4, 5, 50, nodes=10).collect())) == want
    monkeypatch.setattr(collocations, "HELD", 3)
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows), 4, 5, 50).collect())) == want


def test_large_products_stay_exact(spark):
    known = [("en", p, w, f) for p, w, f in (("x", 1, 4_000_000_000), ("y", 1, 3_000_000_000), ("x y", 2, 2_999_999_999))]
    a, n, l, r = 2_999_999_999, 9_000_000_000_000, 4_000_000_000, 3_000_000_000
    table = spark.createDataFrame(known, "lang string, phrase string, words int, f bigint")
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    found = collocations.scored(table, totals, 5).collect()
    assert [tuple(row) for row in found] == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_no_words(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs(spark, [(1, " .\n", "en", "a"), (2, None, None, None)])).count() == 0


def test_over_a_million_phrases_need_no_shuffle_of_all(spark, monkeypatch):
    def shuffled(*_):
        raise AssertionError("all phrases were shuffled")

    monkeypatch.setattr(collocations, "count_by_shuffle", shuffled)
    n = 210_000
    text = " ".join(f"w{i}" for i in range(n))
    known, totals = collocations.frequent_phrases(docs(spark, [(1, text, "en", "a"), (2, text + ". solo", "en", "a")]), support=2, share=1)
    known = known.cache()
    assert known.count() == sum(n - k + 1 for k in range(1, 6)) and totals.collect() == [("en", 2 * n + 1)]
    some = known.filter(known.phrase.startswith("w777 ") | known.phrase.isin("w777", "solo")).collect()
    assert sorted(tuple(r) for r in some) == sorted(("en", " ".join(f"w{777 + i}" for i in range(k)), k, 2) for k in range(1, 6))


def test_counts_are_sent_in_parts(spark, monkeypatch):
    rows = made(6)
    monkeypatch.setattr(collocations, "SENT", 7)
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows).repartition(3), 4, 5, 50, share=2).collect())) == plain(rows, 4, 5, 50)
