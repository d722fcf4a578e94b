"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures. Rendering walks the turns of a
conversation one by one and gives pieces of text, each with a mark: whether it stands between ``{% generation %}`` and
``{% endgeneration %}`` (the text a model is trained on). Templates can't reach anything but their variables: there are no attribute
lookups on Python objects, no calls but the named filters, and loops only over the turns.

    {{ m.text | escape }}                       value with filters (escape, escape_name, trim, upper, lower)
    {% for m in messages %} ... {% endfor %}     loop over the turns; loop.index, loop.first and loop.last are known
    {% if a == 'x' and not b %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% set name = value %}, {# comment #}, and - next to % or braces, which trims white space outside

Expressions: strings, integers, true, false, none, ``a.b``, ``~`` (joins texts), ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses.

Turns are brought together by conversation and sorted; a conversation is rendered and read back as a stream in pieces of about
PART characters, so even a very long one needs little memory (its digest is a sequential one, so one task must see its turns in order).

Defined cases: null texts and roles count as empty; turns with equal numbers are ordered by role, then text, nulls first; repeated rows
are repeated turns; rows with a null conversation id form one conversation; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 20

# The escape sign goes before itself and before every control string. The control strings of the default template.
SIGN = "\\"
HEAD, SEP, END = "### ", ": ", "</turn>"
DEFAULT = (
    "{% for m in messages %}### {{ m.role | escape_name }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_NAME = re.compile(r"\\|###|</turn>|:")
_SIGNED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: SIGN + m[0], text)


def escape_name(text: str) -> str:
    return _CONTROL_NAME.sub(lambda m: SIGN + m[0], text)


def unescape(text: str) -> str:
    return _SIGNED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


class TemplateError(ValueError):
    pass


# Syntax tree: tuples, the first item names the kind.
_TOKEN = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_EXPR = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~.|()]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expr:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _EXPR.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            elif name in ("true", "false", "none"):
                self.tokens.append(("const", {"true": True, "false": False, "none": None}[name]))
            else:
                self.tokens.append(("word", name) if name in ("and", "or", "not") else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *wanted) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return True
        return False

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over in expression: {self.tokens[self.at:]}")
        return node

    def either(self):
        node = self.both()
        while self.take(("word", "or")):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take(("word", "and")):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take(("word", "not")) else self.compared()

    def compared(self):
        node = self.joined()
        for sign in ("==", "!="):
            if self.take(("sign", sign)):
                return (sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.take(("sign", "~")):
            node = ("~", node, self.filtered())
        return node

    def filtered(self):
        node = self.single()
        while self.take(("sign", "|")):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            node = ("filter", name, node)
        return node

    def next(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def single(self):
        kind, value = self.next()
        if kind == "const":
            return ("const", value)
        if (kind, value) == ("sign", "("):
            node = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("missing )")
            return node
        if kind != "name":
            raise TemplateError(f"unexpected {value}")
        path = [value]
        while self.take(("sign", ".")):
            kind, value = self.next()
            if kind != "name":
                raise TemplateError("a name must follow .")
            path.append(value)
        return ("path", tuple(path))


def parse(source: str):
    """The syntax tree of a template: ("block", nodes)."""
    items, at = [], 0
    trim = False
    for m in _TOKEN.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if trim else text
        if m[0][2:3] == "-":
            text = text.rstrip()
        trim, at = m[0][-3:-2] == "-", m.end()
        if text:
            items.append(("text", text))
        if m[1] is not None:
            items.append(("value", _Expr(m[1]).whole()))
        elif m[2] is not None:
            items.append(("tag", *(m[2].strip().split(None, 1) + [""])[:2]))
    rest = source[at:].lstrip() if trim else source[at:]
    if rest:
        items.append(("text", rest))
    place = 0

    def block(*ends: str):
        nonlocal place
        nodes = []
        while place < len(items):
            item = items[place]
            if item[0] != "tag":
                nodes.append(item)
                place += 1
                continue
            _, name, rest = item
            if name in ends:
                return ("block", nodes)
            place += 1
            if name == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+messages", rest)
                if not m:
                    raise TemplateError("loops run over messages only")
                body = block("endfor")
                place += 1
                nodes.append(("for", m[1], body))
            elif name == "if":
                arms, condition = [], _Expr(rest).whole()
                while True:
                    arms.append((condition, block("elif", "else", "endif")))
                    _, name, rest = items[place]
                    place += 1
                    if name == "endif":
                        break
                    condition = _Expr(rest).whole() if name == "elif" else ("const", True)
                nodes.append(("if", arms))
            elif name == "generation":
                body = block("endgeneration")
                place += 1
                nodes.append(("generation", body))
            elif name == "set":
                m = re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError("bad set")
                nodes.append(("set", m[1], _Expr(m[2]).whole()))
            else:
                raise TemplateError(f"unknown or misplaced tag: {name}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", nodes)

    return block()


def fold(node):
    """The tree with constant expressions worked out, dead arms removed and neighbouring texts joined."""
    kind = node[0]
    if kind in ("~", "==", "!=", "and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "const":
            return ("const", _value((kind, a, b))({}))
        if kind in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else (kind, a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](_text(a[1]))) if a[0] == "const" else (kind, node[1], a)
    if kind == "value":
        a = fold(node[1])
        return ("text", _text(a[1])) if a[0] == "const" else (kind, a)
    if kind == "set":
        return (kind, node[1], fold(node[2]))
    if kind == "for":
        return (kind, node[1], fold(node[2]))
    if kind == "generation":
        return (kind, fold(node[1]))
    if kind == "if":
        arms = []
        for condition, body in node[1]:
            condition = fold(condition)
            if condition[0] == "const" and not condition[1]:
                continue
            arms.append((condition, fold(body)))
            if condition[0] == "const":
                break
        if not arms:
            return ("block", [])
        return arms[0][1] if arms[0][0][0] == "const" else (kind, arms)
    if kind == "block":
        nodes: list = []
        for child in map(fold, node[1]):
            for one in child[1] if child[0] == "block" else [child]:
                if one[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + one[1])
                elif one != ("text", ""):
                    nodes.append(one)
        return (kind, nodes)
    return node


def _text(value) -> str:
    return "" if value is None else str(value)


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda names, v=node[1]: v
    if kind == "path":
        first, *rest = node[1]

        def look(names):
            value = names.get(first)
            for key in rest:
                value = value.get(key) if isinstance(value, dict) else None
            return value

        return look
    if kind == "filter":
        change, inner = FILTERS[node[1]], _value(node[2])
        return lambda names: change(_text(inner(names)))
    if kind == "not":
        inner = _value(node[1])
        return lambda names: not inner(names)
    a, b = _value(node[1]), _value(node[2])
    return {
        "~": lambda names: _text(a(names)) + _text(b(names)),
        "==": lambda names: a(names) == b(names),
        "!=": lambda names: a(names) != b(names),
        "and": lambda names: a(names) and b(names),
        "or": lambda names: a(names) or b(names),
    }[kind]


class Piece(NamedTuple):
    text: str
    trained: bool


Render = Callable[[dict, bool], Iterator[Piece]]


def _closure(node) -> Render:
    kind = node[0]
    if kind == "text":
        marked, plain = Piece(node[1], True), Piece(node[1], False)
        return lambda names, trained: iter((marked if trained else plain,))
    if kind == "value":
        value = _value(node[1])
        return lambda names, trained: iter((Piece(_text(value(names)), trained),))
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(names, trained):
            names[name] = value(names)
            return iter(())

        return assign
    if kind == "generation":
        body = _closure(node[1])
        return lambda names, trained: body(names, True)
    if kind == "if":
        arms = [(_value(condition), _closure(body)) for condition, body in node[1]]

        def choose(names, trained):
            for condition, body in arms:
                if condition(names):
                    return body(names, trained)
            return iter(())

        return choose
    if kind == "for":
        name, body = node[1], _closure(node[2])

        def loop(names, trained):
            turns = iter(names["messages"])
            turn, index = next(turns, None), 0
            while turn is not None:
                following = next(turns, None)
                index += 1
                names[name], names["loop"] = turn, {"index": index, "first": index == 1, "last": following is None}
                yield from body(names, trained)
                turn = following

        return loop
    nodes = [_closure(child) for child in node[1]]

    def run(names, trained):
        for child in nodes:
            yield from child(names, trained)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from the turns (dicts with ``role`` and ``text``) to the pieces of the formatted conversation."""
    run = _closure(fold(parse(source)))
    return lambda messages: run({"messages": messages}, False)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each conversation of a sorted partition with its turns as a stream; a stream must be used up before the next one."""
    rows = (
        row for batch in batches
        for row in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
    )
    row = next(rows, None)

    def turns(conv):
        nonlocal row
        while row is not None and row[0] == conv:
            yield {"role": row[1] or "", "text": row[2] or ""}
            row = next(rows, None)

    while row is not None:
        yield row[0], turns(row[0])


def format_conversations(turns: DataFrame, template: str = DEFAULT, part: int = PART) -> DataFrame:
    """``conv_id``, ``part``, ``text`` and ``trained``: the formatted conversations, and the spans [start, end) under the loss mask.

    A conversation has one row, or several consecutive ones (part 0, 1, ...) of about ``part`` characters if it is longer. Spans are in
    code points of the whole conversation.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.column("conv_id").type

        def both():
            yield first
            yield from batches

        out: list[tuple] = []
        held = 0

        def batch():
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], span)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "text", "trained"])

        for conv, messages in _conversations(both()):
            at, number, size, pieces, spans = 0, 0, 0, [], []
            for text, trained in render(messages):
                if trained and text:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(text)
                    else:
                        spans.append({"start": at, "end": at + len(text)})
                pieces.append(text)
                at += len(text)
                size += len(text)
                if size >= part:
                    out.append((conv, number, "".join(pieces), spans))
                    yield batch()
                    held, number, size, pieces, spans = 0, number + 1, 0, [], []
            for _ in messages:  # a template need not use its turns
                pass
            if pieces or not number:
                out.append((conv, number, "".join(pieces), spans))
                held += size
            if out and (held >= part or len(out) >= 1000):
                yield batch()
                held = 0
        if out:
            yield batch()

    return rows.mapInArrow(step, f"conv_id {kind}, part bigint, text string, trained array<struct<start:bigint,end:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of the default template says: per conversation its turns' count and digest, and the text under the loss mask.

    ``formatted`` comes straight from ``format_conversations``: the parts of a conversation follow each other.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def fresh(conv):
            return {"conv": conv, "rest": "", "masked": "", "at": 0, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0}

        def take(state, text, spans):
            start = state["at"]
            for s in spans:
                # An escape sign at the end of a part waits for the sign it belongs to.
                masked = state["masked"] + text[s["start"] - start:s["end"] - start]
                signs = len(masked) - len(masked.rstrip(SIGN))
                state["masked"] = SIGN if signs % 2 else ""
                plain = unescape(masked[:-1] if signs % 2 else masked)
                state["chars"] += len(plain)
                state["loss"].update(plain.encode("utf-8", "surrogatepass"))
            state["at"] += len(text)
            rest, done = state["rest"] + text, 0
            for m in _TURN.finditer(rest):
                if m.start() != done:
                    raise ValueError(f"not a formatted turn in conversation {state['conv']}")
                done = m.end()
                state["n"] += 1
                state["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            state["rest"] = rest[done:]

        def row(state):
            if state["rest"]:
                raise ValueError(f"unfinished turn in conversation {state['conv']}")
            return state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["at"]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        id_type = None
        for batch in batches:
            id_type, out = batch.column("conv_id").type, []
            for conv, number, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "trained")]):
                if number == 0:
                    if state:
                        out.append(row(state))
                    state = fresh(conv)
                take(state, text, spans)
            if out:
                yield _rows(out, names, id_type)
        if state:
            yield _rows([row(state)], names, id_type)

    return formatted.mapInArrow(
        step, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _rows(out: list[tuple], names: list[str], id_type) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
