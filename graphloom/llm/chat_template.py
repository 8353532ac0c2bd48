r"""Chat formatting by a template compiler.

A small sandboxed language is parsed to a syntax tree, constants are folded, and closures are generated that render
conversations and record the spans between generation markers.

    {{ expression }}                     strings, names, m.role, a ~ b, ==, !=, and, or, not, ( ), value | filter
    {% for m in messages %} {% endfor %}
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% generation %} {% endgeneration %} text inside is under the loss mask

Values are strings, booleans, and the given dicts and lists; a name or key that is missing is an error.  No Python
attribute, call or index can be reached, and every loop runs over a given list, so every rendering ends.

Control strings: ``escape`` writes ``\`` as ``\\`` and ``<|`` as ``<\|``, so no text can hold a marker; ``escape_line``
also writes a line feed as ``\n``.  ``unescape`` undoes both.

Defined results: null role or text is empty; turns with one number are in the order of role and text; repeated rows are turns each; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | escape_line) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
#: Characters of formatted text after which a long conversation goes on in a further part.
PART_CHARS = 1 << 20


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|") if "\\" in text or "<|" in text else text


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([A-Za-z_]\w*)|(==|!=|[~().|]))")
_CODES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


# A tree is made of tuples: ("const", value) ("name", n) ("get", e, key) ("cat", [e]) ("eq"|"ne"|"and"|"or", a, b)
# ("not", e) ("filter", name, e) ("text", e) ("for", name, e, body) ("if", [(e, body)], body) ("gen", body)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            at = m.end()
            if m[1] is not None:
                self.tokens.append(("str", re.sub(r"\\(.)", lambda c: _CODES.get(c[1], c[1]), m[1])))
            else:
                self.tokens.append(("name", m[2]) if m[2] else ("op", m[3]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def accept(self, *token: str) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.accept("name", "or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.accept("name", "and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("name", "not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        for op, kind in (("==", "eq"), ("!=", "ne")):
            if self.accept("op", op):
                return (kind, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        items = [self.filtered()]
        while self.accept("op", "~"):
            items.append(self.filtered())
        return items[0] if len(items) == 1 else ("cat", items)

    def filtered(self) -> tuple:
        tree = self.single()
        while self.accept("op", "|"):
            if (name := self.name()) not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def single(self) -> tuple:
        kind, value = self.peek()
        if self.accept("op", "("):
            tree = self.either()
            if not self.accept("op", ")"):
                raise TemplateError("a parenthesis is not closed")
            return tree
        self.at += 1
        if kind == "str":
            return ("const", value)
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        tree: tuple = {"true": ("const", True), "false": ("const", False)}.get(value, ("name", value))
        while self.accept("op", "."):
            tree = ("get", tree, self.name())
        return tree


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            pieces.append(("raw", template[at : m.start()]))
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("raw", template[at:]))
    pieces.reverse()

    def body(*ends: str) -> tuple[list[tuple], str]:
        found: list[tuple] = []
        while pieces:
            kind, value = pieces.pop()
            word = value.split(None, 1)[0] if kind == "tag" and value else ""
            if kind == "raw":
                found.append(("text", ("const", value)))
            elif kind == "out":
                found.append(("text", _Expression(value).whole()))
            elif word in ends:
                return found, value
            elif word == "for":
                if not (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)):
                    raise TemplateError(f"malformed {value!r}")
                inner, _ = body("endfor")
                found.append(("for", m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                arms, test, rest = [], value[2:], []
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((_Expression(test).whole(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end[4:]
                if end == "else":
                    rest, _ = body("endif")
                found.append(("if", arms, rest))
            elif word == "generation":
                found.append(("gen", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return found, ""

    return body()[0]


def fold(tree: Any) -> Any:
    """The same tree with constant parts computed, neighbouring texts joined and dead branches removed."""
    if isinstance(tree, list):
        out: list[tuple] = []
        for node in map(fold, tree):
            for part in node if isinstance(node, list) else [node]:
                if part[0] == "text" and part[1] == ("const", ""):
                    continue
                if out and part[0] == out[-1][0] == "text" and part[1][0] == out[-1][1][0] == "const":
                    out[-1] = ("text", ("const", _string(out[-1][1][1]) + _string(part[1][1])))
                else:
                    out.append(part)
        return out
    kind = tree[0]
    if kind == "text":
        value = fold(tree[1])
        return [("text", x) for x in value[1]] if value[0] == "cat" else ("text", value)
    if kind == "cat":
        items: list[tuple] = []
        for x in map(fold, tree[1]):
            for y in x[1] if x[0] == "cat" else [x]:
                if items and y[0] == items[-1][0] == "const":
                    items[-1] = ("const", _string(items[-1][1]) + _string(y[1]))
                else:
                    items.append(y)
        return items[0] if len(items) == 1 and items[0][0] == "const" else ("cat", items)
    if kind in ("eq", "ne", "and", "or"):
        a, b = fold(tree[1]), fold(tree[2])
        if a[0] == b[0] == "const":
            return ("const", _BINARY[kind](a[1], b[1]))
        return (kind, a, b)
    if kind == "not":
        a = fold(tree[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(tree[2])
        return ("const", FILTERS[tree[1]](_string(a[1]))) if a[0] == "const" else ("filter", tree[1], a)
    if kind == "get":
        return ("get", fold(tree[1]), tree[2])
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "gen":
        return ("gen", fold(tree[1]))
    if kind == "if":
        arms = []
        for test, inner in tree[1]:
            test = fold(test)
            if test[0] == "const" and test[1]:
                return fold(inner) if not arms else ("if", arms, fold(inner))
            if test[0] != "const":
                arms.append((test, fold(inner)))
        return ("if", arms, fold(tree[2])) if arms else fold(tree[2])
    return tree


_BINARY = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _string(value: Any) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    raise TemplateError("only strings and booleans can be written")


class Rendered:
    """Text as it is written, with the spans of code points under the loss mask."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        def look(scope: dict, key: str = tree[1]) -> Any:
            if key not in scope:
                raise TemplateError(f"unknown name {key!r}")
            return scope[key]
        return look
    if kind == "get":
        def get(scope: dict, inner=_value(tree[1]), key=tree[2]) -> Any:
            found = inner(scope)
            if type(found) is not dict or key not in found:
                raise TemplateError(f"no field {key!r}")
            return found[key]
        return get
    if kind == "cat":
        return lambda scope, items=[_value(x) for x in tree[1]]: "".join(_string(f(scope)) for f in items)
    if kind == "not":
        return lambda scope, f=_value(tree[1]): not f(scope)
    if kind == "and":
        return lambda scope, a=_value(tree[1]), b=_value(tree[2]): a(scope) and b(scope)
    if kind == "or":
        return lambda scope, a=_value(tree[1]), b=_value(tree[2]): a(scope) or b(scope)
    if kind == "filter":
        return lambda scope, g=FILTERS[tree[1]], f=_value(tree[2]): g(_string(f(scope)))
    return lambda scope, op=_BINARY[kind], a=_value(tree[1]), b=_value(tree[2]): op(a(scope), b(scope))


def _writer(body: list[tuple]) -> Callable[[dict, Rendered], None]:
    steps: list[Callable[[dict, Rendered], None]] = []
    for node in body:
        if node[0] == "text":
            if node[1][0] == "const":
                steps.append(lambda scope, out, v=_string(node[1][1]): out.add(v))
            else:
                steps.append(lambda scope, out, f=_value(node[1]): out.add(_string(f(scope))))
        elif node[0] == "for":
            def loop(scope, out, name=node[1], items=_value(node[2]), inner=_writer(node[3])) -> None:
                found = items(scope)
                if type(found) is not list:
                    raise TemplateError("a loop needs a list")
                for x in found:
                    inner({**scope, name: x}, out)
            steps.append(loop)
        elif node[0] == "if":
            def branch(scope, out, arms=[(_value(t), _writer(b)) for t, b in node[1]], rest=_writer(node[2])) -> None:
                for test, inner in arms:
                    if test(scope):
                        return inner(scope, out)
                return rest(scope, out)
            steps.append(branch)
        else:
            def marked(scope, out, inner=_writer(node[1])) -> None:
                start = out.length
                inner(scope, out)
                out.spans.append((start, out.length))
            steps.append(marked)
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Rendered) -> None:
        for step in steps:
            step(scope, out)

    return run


def compile_template(template: str) -> Callable[..., Rendered]:
    """A function of the template's variables that renders it."""
    write = _writer(fold(parse(template)))

    def render(**variables: Any) -> Rendered:
        out = Rendered()
        write(variables, out)
        return out

    return render


# --------------------------------------------------------------------------- Spark

FORMATTED = "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(turns: DataFrame, template: str = CHATML, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, formatted, loss_spans: conversations of (conv_id, turn, role, text), rendered in order of turn.

    A conversation longer than ``part_chars`` goes on in further parts of whole turns, consecutive in one partition, so
    a task never holds more than a part.  The template must write each message by itself, in one loop over messages.
    """
    parse(template)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        done: list[tuple] = []
        held: list[dict] = []
        conv, part, size, out = None, 0, 0, 0

        def flush() -> None:
            nonlocal held, part, size, out
            if held:
                r = render(messages=held)
                done.append((conv, part, r.text(), [{"start": a, "end": b} for a, b in r.spans]))
                out += r.length
            held, part, size = [], part + 1, 0

        def batch() -> pa.RecordBatch:
            nonlocal done, out
            found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
            done, out = [], 0
            return found

        first = True
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if first or c != conv:
                    flush()
                    conv, part, first = c, 0, False
                elif size >= part_chars:
                    flush()
                held.append({"role": role, "text": text})
                size += len(text)
                if out > 4 * part_chars:
                    yield batch()
        flush()
        if done:
            yield batch()

    return rows.mapInArrow(run, FORMATTED)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of text under the loss mask, from ChatML output alone.  Parts follow each other as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for b in batches:
            for conv, part, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0 or now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while m := _TURN.match(text, at):
                    now[1] += 1
                    now[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    at = m.end()
                if at != len(text):
                    raise TemplateError("the formatted text does not read back")
                for s in spans:
                    loss = unescape(text[s["start"] : s["end"]])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(text)
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _DIGESTS)], schema=_DIGESTS)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _DIGESTS)], schema=_DIGESTS)

    return formatted.mapInArrow(run, DIGESTS)
