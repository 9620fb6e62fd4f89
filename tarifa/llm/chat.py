"""Chat formatting: a compiler for a small, sandboxed template language, and its use on conversations.

The language: text; ``{{ expression | filter }}``; ``{% if %} / {% elif %} / {% else %} / {% endif %}``;
``{% for x in expression %} / {% endfor %}`` with ``loop.first`` and ``loop.index``; ``{% set x = expression %}``;
``{% generation %} / {% endgeneration %}`` around what a model is trained on; ``{# comments #}``; a
``-`` inside a tag's brackets strips white space beside it.  Expressions have strings, integers,
true, false, none, names, ``x.field``, ``+``, ``==``, ``!=``, ``in``, ``not``, ``and``, ``or``,
parentheses and filters.  There is no call, no index and no attribute beyond a record's own
fields, so a template reaches nothing but its variables.

A template is parsed into a tree, constants are folded, and each node becomes a Python closure.
Rendering yields (text, trained) pieces, so a conversation of any length streams through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import require

Piece = tuple[str, bool]

START, END = "<|im_start|>", "<|im_end|>"

#: The default template: turns between marks, assistant texts as the trained part.
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)


def escape(text: str) -> str:
    r"""Break up control strings reversibly: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    r"""Like ``escape``, and a line feed becomes ``\n``, so the result is one line."""
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def unescape_line(text: str) -> str:
    """Undo ``escape_line``."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}


class TemplateError(ValueError):
    """The template can't be compiled, or reads what isn't there."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().])|(\S))", re.S)
_LITERALS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens = []
        for string, number, word, op, bad in _TOKEN.findall(source.strip()):
            if bad:
                raise TemplateError(f"unexpected {bad!r} in {source!r}")
            if string:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S)))
            elif number:
                self.tokens.append(("value", int(number)))
            elif word in _LITERALS:
                self.tokens.append(("value", _LITERALS[word]))
            else:
                self.tokens.append(("op" if op or word in ("and", "or", "not", "in") else "name", op or word))
        self.at = 0

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def parse(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while op := self.take("==", "!=", "in"):
            node = Op(op, (node, self.added()))
        return node

    def added(self):
        node = self.filtered()
        while self.take("+"):
            node = Op("+", (node, self.filtered()))
        return node

    def filtered(self):
        node = self.item()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Op(f"|{name}", (node,))
        return node

    def item(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            node = Const(self.tokens[self.at][1])
            self.at += 1
        else:
            node = Name(self.name())
        while self.take("."):
            node = Field(node, self.name())
        return node


def parse(source: str) -> tuple:
    """The statements of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        before, after = next((a, b) for a, b in ((m[1], m[3]), (m[4], m[6]), (m[7], m[8])) if a is not None)
        pieces.append(("text", text.rstrip() if before else text))
        if m[2] is not None:
            pieces.append(("emit", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(after)
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    body, end, rest = _block(pieces, 0)
    if end is not None:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _block(pieces: list[tuple[str, str]], at: int) -> tuple[tuple, str | None, int]:
    """Statements from ``at`` to a tag that ends or divides a block, that tag, and the place after it."""
    out = []
    while at < len(pieces):
        kind, source = pieces[at]
        at += 1
        word, _, rest = source.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "text":
            if source:
                out.append(Emit(Const(source)))
        elif kind == "emit":
            out.append(Emit(Expression(source).parse()))
        elif word in ("endif", "endfor", "endgeneration", "else", "elif"):
            return tuple(out), source, at
        elif word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"can't read {source!r}")
            out.append(Set(name.strip(), Expression(value).parse()))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            body, end, at = _block(pieces, at)
            if not m or end != "endfor":
                raise TemplateError(f"can't read {source!r}")
            out.append(For(m[1], Expression(m[2]).parse(), body))
        elif word == "generation":
            body, end, at = _block(pieces, at)
            if end != "endgeneration":
                raise TemplateError("endgeneration is missing")
            out.append(Generation(body))
        elif word == "if":
            node, at = _branches(pieces, rest, at)
            out.append(node)
        else:
            raise TemplateError(f"no tag {word!r}")
    return tuple(out), None, at


def _branches(pieces: list[tuple[str, str]], test: str, at: int) -> tuple[If, int]:
    body, end, at = _block(pieces, at)
    word, _, rest = (end or "").partition(" ")
    if word == "elif":
        other, at = _branches(pieces, rest, at)
        return If(Expression(test).parse(), body, (other,)), at
    other = ()
    if word == "else":
        other, end, at = _block(pieces, at)
    if end != "endif":
        raise TemplateError("endif is missing")
    return If(Expression(test).parse(), body, other), at


# ---------------------------------------------------------------- constants

_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold(node):
    """A node with its constant parts computed: expressions, branches that are never or always taken,
    and neighbouring constant texts."""
    if isinstance(node, tuple):
        flat = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if flat and all(isinstance(z, Emit) and isinstance(z.value, Const) for z in (y, flat[-1])):
                    flat[-1] = Emit(Const(_show(flat[-1].value.value) + _show(y.value.value)))
                else:
                    flat.append(y)
        return tuple(flat)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op)(*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.body if test.value else node.other)
        return If(test, fold(node.body), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _apply(op: str) -> Callable:
    return FILTERS[op[1:]] if op[0] == "|" else (lambda a: not a) if op == "not" else _BINARY[op]


def _show(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


# ---------------------------------------------------------------- closures


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def read(env, name=node.name):
            if name not in env:
                raise TemplateError(f"no variable {name!r}")
            return env[name]

        return read
    if isinstance(node, Field):
        of = _value(node.of)

        def field(env, name=node.name):
            record = of(env)
            if not isinstance(record, dict) or name not in record:
                raise TemplateError(f"no field {name!r}")
            return record[name]

        return field
    args = [_value(a) for a in node.args]
    if node.op in ("and", "or"):
        a, b = args
        return (lambda env: a(env) and b(env)) if node.op == "and" else (lambda env: a(env) or b(env))
    f = _apply(node.op)
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def _body(nodes: tuple, trained: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(n, trained) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _statement(node, trained: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            return lambda env, piece=((_show(node.value.value), trained),): piece
        value = _value(node.value)
        return lambda env: ((_show(value(env)), trained),)
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, If):
        test, body, other = _value(node.test), _body(node.body, trained), _body(node.other, trained)
        return lambda env: body(env) if test(env) else other(env)
    value = _value(node.value if isinstance(node, Set) else node.over)
    if isinstance(node, Set):

        def assign(env):
            env[node.name] = value(env)
            return ()

        return assign
    body = _body(node.body, trained)

    def loop(env):
        for k, item in enumerate(value(env)):
            yield from body(env | {node.name: item, "loop": {"first": k == 0, "index": k + 1}})

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, trained) pieces."""
    run = _body(fold(parse(source)), False)
    return lambda **variables: run(variables)


def render(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The text of pieces and the spans of it (code points, end exclusive) to train on, touching ones joined."""
    parts, spans, at = [], [], 0
    for text, trained in pieces:
        parts.append(text)
        if trained and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)
    return "".join(parts), spans


# ---------------------------------------------------------------- conversations


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """(conv_id, formatted, spans) per conversation of ``turns`` (conv_id, turn, role, text).

    Rows go by turn, ties by role, then text; null turns come first.  Null roles and texts are
    empty.  Null ids form one conversation.  Repeated rows are turns of their own.  An empty table
    gives no rows.

    Rows are dealt by conversation and sorted inside each task; a task reads its rows as a stream
    and holds one conversation's output at a time.
    """
    require(turns, "conv_id", "turn", "role", "text")
    compile_template(template)  # fail on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        ready: list[tuple] = []
        size = 0
        for conv_id, group in groupby(rows, itemgetter(0)):
            text, spans = render(write(messages=({"role": r, "text": t} for _, r, t in group)))
            ready.append((conv_id, text, [{"begin": a, "end": b} for a, b in spans]))
            size += len(text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names)

    names = ["conv_id", "formatted", "spans"]
    kind = dict(turns.dtypes)["conv_id"]
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    kinds = [to_arrow_type(turns.schema["conv_id"].dataType), pa.string(), pa.list_(span)]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    ordered = (
        turns.select("conv_id", "turn", *texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind}, formatted string, spans array<struct<begin: long, end: long>>"
    )


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation formatted by ``CHATML``."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape_line(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what conversations formatted by ``CHATML`` say, read from their output alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = hashlib.sha256()
                parsed = parse_formatted(text)
                for role, said in parsed:
                    turns.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(parsed), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
