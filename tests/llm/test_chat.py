import hashlib
from collections import defaultdict

import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from rasterlake.llm import chat


def render(template, messages):
    return [tuple(p) for p in chat.compile_template(template)(messages)]


def text_of(template, messages=()):
    return "".join(t for t, _ in render(template, messages))


@pytest.mark.parametrize("template,text", [
    ("a{{ 'b' ~ 1 }}c", "ab1c"), ("{% if 1 == 1 and not false %}x{% else %}y{% endif %}", "x"), ("{# no #}z", "z"),
    ("{% set a = 'q' %}{{ a | upper }}{{ missing }}", "Q"), ("  {{- 'a' -}}  b", "ab"), ("{{ 'it\\'s' }}{{ \"\\n\" }}", "it's\n"),
    ("{% if false %}x{% elif true or false %}y{% endif %}", "y"), ("{{ ('a' ~ 'b') | escape }}", "ab"),
])
def test_expressions(template, text):
    assert text_of(template) == text


def test_folding():
    tree = chat.fold(chat.parse("a{{ 'b' }}{% if 1 == 2 %}x{% else %}{{ 'c' | upper }}{% endif %}{# n #}d"))
    assert tree == ("block", [("text", "abCd")])


def test_loop_and_marks():
    template = "{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}"
    got = render(template, [{"role": "a", "text": "x"}, {"role": "b", "text": "y"}])
    assert got == [("1", False), ("x", True), ("2", False), ("!", False), ("y", True)]


@pytest.mark.parametrize("template", [
    "{{ a.b( }}", "{% for x in range %}{% endfor %}", "{{ a | nope }}", "{% if a %}", "{{ 'a' 'b' }}", "{% import os %}", "{{ __import__('os') }}",
])
def test_refused(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#/<>turn: \n", max_size=40))
def test_escaping_is_reversible(text):
    for change in (chat.escape, chat.escape_name):
        assert chat.unescape(change(text)) == text
    turn = chat._TURN.fullmatch(f"### {chat.escape_name(text)}: {chat.escape(text)}</turn>\n")
    assert turn and (chat.unescape(turn[1]), chat.unescape(turn[2])) == (text, text)


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        said = "".join(t[5] for t in own if t[3] == "assistant")
        all_of = "".join(f"{t[3]}\n{t[5]}\n" for t in own)
        out[conv] = (len(own), hashlib.sha256(all_of.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "assistant", "\\"), (2, 0, None, None), (None, 1, "a:b", "x\ny"),
    (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, "assistant", None), (4, None, "user", "é🙂" * 50_000), (4, 1, "assistant", "\\###" * 3_000),
]


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_read_back(spark, part):
    table = spark.createDataFrame([r + (1, "x") for r in ODD], "conv_id long, turn long, role string, text string, part int, N_TURNS string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(table, part=part)).collect()}
    assert got == brute(ODD)


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(table)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    want = brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = driver.queries()["op6_chat_formatting"](spark, SF_DIR)
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == want
