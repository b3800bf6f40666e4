"""Chat formatting: a small template language, compiled to Python closures that render a stream of messages.

    {{ expression | filter }}    {% set name = expression %}    {% if %} {% elif %} {% else %} {% endif %}
    {% for message in messages %} {% endfor %}    {% generation %} {% endgeneration %}    {# remark #}

Expressions have texts, whole numbers, true, false, none, names, a.b and a['b'], + == != < > in, not, and, or, and
filters. Names are looked up in the values given and nowhere else; a.b is a key of a mapping, never an
attribute of an object; nothing is called but the filters below. `messages` is a stream, passed once: loop.first,
loop.last, loop.index0 and loop.previous tell what stands around a message.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}" + OPEN + "{{ message.role | name }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}" + CLOSE + "\n{% endfor %}"
    "{% if add_generation_prompt %}" + OPEN + "assistant\n{% endif %}")


class TemplateError(ValueError):
    """A template that does not parse, or that asks for what is not there."""


# --- texts inside a format ---------------------------------------------------------

def escape(text: str) -> str:
    """The text with a backslash more in every '<|', '<\\|', ...: no control string is left, and `unescape` restores it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_name(text: str) -> str:
    """A role on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": escape, "name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower,
    "length": len, "string": str,
}

# --- syntax tree -------------------------------------------------------------------
# Nodes are tuples: (kind, parts...). Expressions: const, name, key, not, and, or, binary, filter.
# Statements: text, output, set, if, for, generation; a body is a list of them.

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<word>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+<>|.\[\]()=]))""", re.S)
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", *_CONSTANTS}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the signs of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        node = self.either()
        self.end()
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.take("not"):
            return ("not", self.negated())
        node = self.sum()
        for sign in ("==", "!=", "<", ">", "in"):
            if self.take(sign):
                return ("binary", sign, node, self.sum())
        if self.take("not"):
            self.need("in")
            return ("not", ("binary", "in", node, self.sum()))
        return node

    def sum(self):
        node = self.filtered()
        while self.take("+"):
            node = ("binary", "+", node, self.filtered())
        return node

    def filtered(self):
        node = self.keyed()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def keyed(self):
        node = self.single()
        while True:
            if self.take("."):
                node = ("key", node, ("const", self.word()))
            elif self.take("["):
                node = ("key", node, self.either())
                self.need("]")
            else:
                return node

    def single(self):
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("const", int(value))
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "word":
            if value in _CONSTANTS:
                return ("const", _CONSTANTS[value])
            if value not in _RESERVED:
                return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template. `-` inside a tag's edge takes the white space beside the tag away."""
    pieces, at = [], 0
    for m in _PARTS.finditer(source):
        pieces.append(("text", source[at:m.start()]))
        for kind, inside in (("output", m[1]), ("tag", m[2])):
            if inside is not None:
                pieces.append((kind, inside))
        at = m.end()
    pieces.append(("text", source[at:]))
    for i, (kind, value) in enumerate(pieces):
        if kind == "text":
            continue
        if value.startswith("-"):
            value, pieces[i - 1] = value[1:], ("text", pieces[i - 1][1].rstrip())
        if value.endswith("-"):
            value, pieces[i + 1] = value[:-1], ("text", pieces[i + 1][1].lstrip())
        pieces[i] = (kind, value)
    stream = iter(pieces)

    def body(*ends: str) -> tuple[list, str | None, _Expression | None]:
        nodes = []
        for kind, value in stream:
            if kind == "text":
                if value:
                    nodes.append(("text", value))
                continue
            e = _Expression(value)
            if kind == "output":
                nodes.append(("output", e.whole()))
                continue
            tag = e.word()
            if tag in ends:
                return nodes, tag, e
            if tag == "set":
                name = e.word()
                e.need("=")
                nodes.append(("set", name, e.whole()))
            elif tag == "for":
                name = e.word()
                e.need("in")
                over = e.whole()
                inner, _, last = body("endfor")
                last.end()
                nodes.append(("for", name, over, inner))
            elif tag == "generation":
                e.end()
                inner, _, last = body("endgeneration")
                last.end()
                nodes.append(("generation", inner))
            elif tag == "if":
                nodes.append(choice(e.whole()))
            else:
                raise TemplateError(f"no tag {tag!r} here")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return nodes, None, None

    def choice(condition) -> tuple:
        yes, tag, e = body("elif", "else", "endif")
        no: list = []
        if tag == "elif":
            return ("if", condition, yes, [choice(e.whole())])
        e.end()
        if tag == "else":
            no, _, e = body("endif")
            e.end()
        return ("if", condition, yes, no)

    return body()[0]


def _binary(sign: str, a, b):
    if sign == "+":
        return a + b
    if sign == "in":
        return a in b
    if sign == "<":
        return a < b
    return a > b if sign == ">" else (a == b) == (sign == "==")


def fold(node, known: dict):
    """An expression with all that depends on constants and `known` names worked out."""
    kind = node[0]
    if kind == "name" and node[1] in known:
        return ("const", known[node[1]])
    if kind in ("const", "name"):
        return node
    parts = tuple(fold(x, known) if isinstance(x, tuple) else x for x in node[1:])
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    node = (kind, *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        try:
            return ("const", _closure(node)({}))
        except TypeError as fault:
            raise TemplateError(f"does not fit: {node!r}") from fault
    return node


def fold_body(nodes: list, known: dict) -> list:
    """Statements with constants folded: decided branches only, and neighbouring texts as one."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    set_here = {n for n in _assigned(nodes)}
    known = {k: v for k, v in known.items() if k not in set_here}  # what a template sets itself is no constant
    for node in nodes:
        kind = node[0]
        if kind == "output":
            value = fold(node[1], known)
            add(("text", _shown(value[1])) if value[0] == "const" else ("output", value))
        elif kind == "set":
            add(("set", node[1], fold(node[2], known)))
        elif kind == "if":
            condition = fold(node[1], known)
            if condition[0] == "const":
                for x in fold_body(node[2] if condition[1] else node[3], known):
                    add(x)
            else:
                add(("if", condition, fold_body(node[2], known), fold_body(node[3], known)))
        elif kind == "for":
            inner = {k: v for k, v in known.items() if k not in (node[1], "loop")}
            add(("for", node[1], fold(node[2], known), fold_body(node[3], inner)))
        elif kind == "generation":
            add(("generation", fold_body(node[1], known)))
        else:
            add(node)
    return out


def _assigned(nodes: list) -> Iterator[str]:
    for node in nodes:
        if node[0] == "set":
            yield node[1]
        for part in node[1:]:
            if isinstance(part, list):
                yield from _assigned(part)


# --- closures ----------------------------------------------------------------------

def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _closure(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, value=node[1]: value
    if kind == "name":
        name = node[1]

        def look(scope):
            if name not in scope:
                raise TemplateError(f"no value for {name!r}")
            return scope[name]

        return look
    if kind == "key":
        whole, key = _closure(node[1]), _closure(node[2])

        def part(scope):
            held, name = whole(scope), key(scope)
            if not isinstance(held, dict) or name not in held:
                raise TemplateError(f"no key {name!r}")
            return held[name]

        return part
    if kind == "not":
        inner = _closure(node[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        change, inner = FILTERS[node[1]], _closure(node[2])
        return lambda scope: change(inner(scope))
    if kind == "binary":
        sign, a, b = node[1], _closure(node[2]), _closure(node[3])
        return lambda scope: _binary(sign, a(scope), b(scope))
    a, b = _closure(node[1]), _closure(node[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    return lambda scope: a(scope) or b(scope)


def _render(nodes: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that gives (text, whether it is to be learned) piece by piece."""
    steps = [_step(node) for node in nodes]

    def run(scope: dict, marked: bool):
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(node) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda scope, marked, text=node[1]: ((text, marked),)
    if kind == "output":
        value = _closure(node[1])
        return lambda scope, marked: ((_shown(value(scope)), marked),)
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def put(scope, marked):
            scope[name] = value(scope)
            return ()

        return put
    if kind == "if":
        condition, yes, no = _closure(node[1]), _render(node[2]), _render(node[3])
        return lambda scope, marked: (yes if condition(scope) else no)(scope, marked)
    if kind == "generation":
        inner = _render(node[1])
        return lambda scope, marked: inner(scope, True)
    name, over, inner = node[1], _closure(node[2]), _render(node[3])

    def loop(scope, marked):
        items = iter(over(scope))
        before, item, index = None, next(items, loop), 0
        while item is not loop:
            after = next(items, loop)
            own = {**scope, name: item, "loop": {"first": index == 0, "last": after is loop, "index0": index, "previous": before}}
            yield from inner(own, marked)
            before, item, index = item, after, index + 1

    return loop


def compile_template(source: str, **known) -> Callable[..., Iterator[tuple[str, bool]]]:
    """render(messages, **values): pieces (text, learned) of one conversation.

    `known` values hold for all conversations and are folded into the template. `messages` may be any
    iterable of {"role", "content"}; no more than one message and its neighbours are held.
    """
    run = _render(fold_body(parse(source), known))

    def render(messages: Iterable[dict], **values):
        for text, marked in run({**values, "messages": messages}, False):
            if text:
                yield text, marked

    return render


# --- on Spark ----------------------------------------------------------------------

#: A part of a conversation's format: whole pieces of about that many characters.
PART_CHARS = 1_000_000
FORMATTED = "conv_id long, part long, text string, spans array<struct<start:long,end:long>>"


def _ordered(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _by_key(rows: Iterable[tuple]) -> Iterator[tuple]:
    return itertools.groupby(rows, key=lambda r: r[0])


def _rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of rows and characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if len(held) >= 1000 or size >= PART_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def formatted(conversations: DataFrame, template: str = TEMPLATE, *, add_generation_prompt: bool = False, **known) -> DataFrame:
    """conv_id, part, text and spans: the format of every conversation, in parts that follow each other.

    `conversations` has a row a turn (conv_id, turn, role, text). Spans (start, end in code points of the
    part's text) are what a model shall learn. Turns are in order of turn, null first, of equal
    turns by role and text; null roles and texts are empty; rows without conv_id are one
    conversation; repeated rows are turns of their own. A conversation is rendered as its rows stream by, so
    that a long one costs time, not memory; parts end between pieces. Other columns do not matter.
    """
    own = {**known, "add_generation_prompt": add_generation_prompt}
    compile_template(template, **own)  # a fault in a template shows here, not in a task
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def parts(render, conv, rows):
        part, pieces, spans, size = 0, [], [], 0
        for text, learned in render({"role": r, "content": t} for _, r, t in rows):
            if pieces and size + len(text) > PART_CHARS:
                yield conv, part, "".join(pieces), spans
                part, pieces, spans, size = part + 1, [], [], 0
            if learned:
                spans.append({"start": size, "end": size + len(text)})
            pieces.append(text)
            size += len(text)
        yield conv, part, "".join(pieces), spans

    def run(batches):
        render = compile_template(template, **own)
        found = (p for conv, rows in _by_key(_rows(batches, "conv_id", "role", "text")) for p in parts(render, conv, rows))
        yield from _batched(found, schema, lambda p: len(p[2]))

    return _ordered(conversations).mapInArrow(run, FORMATTED)


class Reader:
    """Turns and learned texts of one conversation, read back from its format part by part, as digests."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.role, self.open, self.tail = None, False, ""

    def add(self, text: str, spans: list[dict]) -> None:
        for s in spans:
            learned = unescape(text[s["start"]:s["end"]])
            self.loss_chars += len(learned)
            self.loss_hash.update(learned.encode())
        self.chars += len(text)
        text = self.tail + text
        # A turn is its role's line and its text between control strings, which no escaped text holds.
        at = 0
        while (end := text.find(CLOSE, at)) >= 0:
            begin = text.index(OPEN, at) + len(OPEN)
            name, content = text[begin:end].split("\n", 1)
            self.turn_hash.update(f"{unescape_name(name)}\n{unescape(content)}\n".encode())
            self.turns += 1
            at = end + len(CLOSE)
        self.tail = text[at:]

    def row(self, conv) -> tuple:
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """DIGESTS of every conversation, from the parts of `formatted` as they stream out of it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(conv, rows):
        reader = Reader()
        for _, _, text, spans in rows:
            reader.add(text, spans)
        return reader.row(conv)

    def run(batches):
        found = (read(conv, rows) for conv, rows in _by_key(_rows(batches, "conv_id", "part", "text", "spans")))
        yield from _batched(found, schema, lambda row: 0)

    return parts.mapInArrow(run, DIGESTS)
