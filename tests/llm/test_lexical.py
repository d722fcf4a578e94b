import math
import re
from collections import Counter

from rows import DOCS, clashing, docs, empty

from rasterlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def ranked(rows, items, k):
    """Item, rank, document and score by the rule, one document after another."""
    held = [(r[0], Counter(terms(r[1])), len(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    out = []
    for item, text in items:
        found = []
        for doc, tf, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in set(terms(text)) if tf[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, n, doc))
        out += [(item, rank, f[4], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:4])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "the SAME text, the same: TEXT"), (2, "Häuser à Straßen"), (3, None), (4, "..."), (None, "no id here"), (5, "longword 12345"),
    (1, "the same text"), (6, "nowhere else"),
]
MORE = [(11, "à la carte à", "fr", None), (12, "la carte \u0085x carte", "fr", None), (13, "The_same-text{the}", None, None), (14, "SAME" * 3, None, None)]


def test_against_plain_rule(spark):
    rows = DOCS + MORE
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for table in (docs(spark, rows), clashing(spark, rows)):
        for k, per_scan in ((10, 1024), (2, 3)):
            got = lexical.search(table, items, k, per_scan=per_scan).collect()
            assert sorted(map(tuple, got), key=str) == ranked(rows, ITEMS, k)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "equal words here", "en", "a") for i in range(60, 0, -1)] + [(None, "equal words here", "en", "a"), (99, "other", "en", "a")]
    items = [(7, "equal")]
    table = docs(spark, rows).repartition(5)
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))
    assert sorted(map(tuple, got), key=str) == ranked(rows, items, 10)


def test_scores_in_parts(monkeypatch, spark):
    monkeypatch.setattr(lexical, "COLUMNS", 2)
    import numpy as np

    found = lexical.Terms(["a b c d", "b c", "", "d e"])
    starts, items = found.items_by_term()
    row, term, parts = np.array([0, 0, 1, 1, 1]), np.array([0, 3, 1, 2, 4]), np.array([5, 7, 1, 2, 3])
    assert lexical.item_scores(2, row, term, parts, starts, items, 4).tolist() == [[12, 0, 0, 7], [3, 3, 0, 3]]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(docs(spark), items.limit(0)).count() == 0
    assert lexical.search(docs(spark), items.filter("text IS NULL")).count() == 0
