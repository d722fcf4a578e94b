import re

from hypothesis import given, settings
from hypothesis import strategies as st
from rows import DOCS, clashing, docs, empty

from rasterlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, *m.span()


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1209.@-+ ()é_%", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base(text) == list(plain(text))


def test_known_cases():
    text = "mail a.b@c-d.org, 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111, 🙂 tel +49 (30) 1234-5678"
    assert base(text) == list(plain(text)) and len(base(text)) == 5
    assert base("001.002.0255.04 1.2.3.256") == [("ip", 0, 15)]


def test_checksums_and_context():
    spans = {s.kind: s for s in pii.find("iban DE89 3704 0044 0532 0130 00 AND 123-45-6789")}
    assert spans["iban"].score == 1.0 and "ssn" not in spans
    assert "ssn" in {s.kind for s in pii.find("ssn 123-45-6789")}
    assert "iban" not in {s.kind for s in pii.find("iban DE88 3704 0044 0532 0130 00")}
    assert pii.find("your phone 555-123-4567")[0].kind == "phone_local" and not pii.find("part 555-123-4567")


def test_long_runs_are_read_in_linear_time():
    for text in ("1" * 10**6, "a" * 10**6 + "@", "+1" + " " * 10**6, "1." * 10**6, "A1" * 10**6, "@" * 10**6):
        pii.find(text)


def test_table(spark):
    got = {r.doc_id: r for r in pii.find_spans(clashing(spark)).collect()}
    assert got[3].spans == [] and set(got) == {r[0] for r in DOCS}
    assert pii.find_spans(docs(spark)).count() == len(DOCS)
    assert pii.find_spans(empty(spark)).count() == 0
