"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes
Python closures. A closure yields pieces ``(text, trained)``; text inside
``{% generation %} ... {% endgeneration %}`` is marked as trained on. The language is a
sandbox: it reads keys of the mappings it is given and nothing else, has no calls, no
attributes of Python objects, no loops but over lists and iterators it is given, and limits on size and depth.
Whatever breaks a rule is a TemplateError. A value that the template makes by joining or by filters has
at most 16 M characters (a number 18 digits); one that it is given, or one filter makes of it, may have any length.

    {{ expr }}   {% set name = expr %}   {% generation %} .. {% endgeneration %}
    {% for name in expr %} .. {% endfor %}   (loop.first, loop.last, loop.index)
    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    expr: 'text', numbers, true, false, none, names, a.b, a['b'], + ~ == != and or not in, (..), x | filter

``messages`` may be an iterator: a loop takes one message after another, so a conversation of
any length is rendered in bounded memory. Partitions are sorted by conversation and turn;
the output comes in parts of about a megabyte.

The default template writes ``### role: text</turn>`` lines. Texts are escaped: a backslash
goes before each backslash, ``<`` and ``#`` (in roles also ``:``), so no control string can
arise inside a text, and dropping the backslashes gives the text back.

Cases: a null role or text counts as empty; equal turn numbers are ordered by role and text;
a null turn comes first; a null conv_id is a conversation of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
MAX_SOURCE, MAX_DEPTH, MAX_TREE = 1 << 16, 50, 100
MAX_VALUE, MAX_NUMBER = 1 << 24, 10**18
PART_CHARS = 1 << 20


class TemplateError(ValueError):
    """The template is malformed or asks for what the sandbox does not give."""


def escape(text: str) -> str:
    return re.sub(r"[\\<#]", r"\\\g<0>", text)


def escape_role(text: str) -> str:
    return re.sub(r"[\\<#:]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def show(value) -> str:
    """How a value appears in the output."""
    if value is None:
        return ""
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+~().|\[\]=]))", re.DOTALL)
_WORDS = {"and", "or", "not", "in"}
_CONST = {"true": True, "false": False, "none": None}
_SLASH = {"n": "\n", "t": "\t", "r": "\r"}


def limited(made):
    """A value that the template made, if it isn't too large."""
    if len(made) > MAX_VALUE if isinstance(made, str) else abs(made) >= MAX_NUMBER:
        raise TemplateError("value too large")
    return made


def depth(node: tuple) -> int:
    """How many nodes lie below each other; counted level by level, as chains may be long."""
    level, n = [node], 0
    while level:
        level, n = [x for parent in level for x in parent[1:] if isinstance(x, tuple)], n + 1
    return n


class Expression:
    """Recursive-descent parser of one expression; nodes are tuples headed by their kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if not self.peek(*texts):
            raise TemplateError(f"expected {' or '.join(texts)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        if depth(node) > MAX_TREE:
            raise TemplateError("expression too deep")
        return node

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("expression too deep")
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        self.depth -= 1
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        turns = 0
        while self.peek("not"):
            self.take("not")
            turns += 1
        node = self.compared()
        for _ in range(turns):
            node = ("not", node)
        return node

    def compared(self) -> tuple:
        node = self.joined()
        if self.peek("==", "!=", "in"):
            node = (self.take("==", "!=", "in"), node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            node = (self.take("+", "~"), node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.peek("|"):
            self.take("|")
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def member(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"unexpected {name!r} after the dot")
                self.at += 1
                node = ("key", node, ("const", name))
            else:
                node = ("key", node, self.either())
                self.take("]")
        return node

    def atom(self) -> tuple:
        if self.peek("("):
            self.take("(")
            node = self.either()
            self.take(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _SLASH.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "num":
            if len(text) > 18:
                raise TemplateError("number too large")
            return ("const", int(text))
        if kind == "name" and text in _CONST:
            return ("const", _CONST[text])
        if kind == "name" and text not in _WORDS and not text.startswith("_"):
            return ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: a ("block", nodes) of text, out, set, for, if and gen nodes."""
    if len(source) > MAX_SOURCE:
        raise TemplateError("template too long")
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL)
    stack: list[list] = [["block", None, []]]  # kind, what it needs, nodes

    def close(*kinds: str) -> list:
        top = stack.pop()
        if top[0] not in kinds:
            raise TemplateError(f"a tag closes {top[0]}, not {kinds[0]}")
        return top

    for piece in pieces:
        nodes = stack[-1][2]
        if piece.startswith("{{") and piece.endswith("}}"):
            nodes.append(("out", Expression(piece[2:-2]).whole()))
            continue
        if not (piece.startswith("{%") and piece.endswith("%}")):
            if re.search(r"\{\{|\{%", piece):
                raise TemplateError("a tag isn't closed")
            if piece:
                nodes.append(("text", piece))
            continue
        word, _, rest = piece[2:-2].strip().partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError("for needs 'name in expression'")
            stack.append(["for", (m[1], Expression(m[2]).whole()), []])
        elif word == "endfor":
            _, (name, over), body = close("for")
            stack[-1][2].append(("for", name, over, ("block", body)))
        elif word == "if":
            stack.append(["if", [(Expression(rest).whole(), [])], None])
            stack[-1][2] = stack[-1][1][-1][1]
        elif word in ("elif", "else"):
            if stack[-1][0] != "if" or stack[-1][1][-1][0] is None:
                raise TemplateError(f"{word} without if")
            stack[-1][1].append((Expression(rest).whole() if word == "elif" else None, []))
            stack[-1][2] = stack[-1][1][-1][1]
        elif word == "endif":
            _, arms, _ = close("if")
            stack[-1][2].append(("if", [(test, ("block", body)) for test, body in arms]))
        elif word == "generation":
            stack.append(["gen", None, []])
        elif word == "endgeneration":
            body = close("gen")[2]
            stack[-1][2].append(("gen", ("block", body)))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError("set needs 'name = expression'")
            nodes.append(("set", name.strip(), Expression(value).whole()))
        else:
            raise TemplateError(f"unknown tag {word!r}")
        if len(stack) > MAX_DEPTH:
            raise TemplateError("template too deep")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return ("block", stack[0][2])


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, dead branches cut and neighbouring texts joined."""
    kind = node[0]
    if kind in ("and", "or", "==", "!=", "in", "+", "~", "key"):
        a, b = fold(node[1]), fold(node[2])
        if kind in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        if a[0] == b[0] == "const":
            return ("const", value((kind, a, b))({}))
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", limited(FILTERS[node[1]](show(a[1])))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "out":
        a = fold(node[1])
        return ("text", show(a[1])) if a[0] == "const" else ("out", a)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "gen":
        return ("gen", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = ("const", True) if test is None else fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        if not arms:
            return ("text", "")
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for x in child[1] if child[0] == "block" else [child]:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", out)
    return node


def value(node: tuple) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        def named(scope, k=node[1]):
            if k not in scope:
                raise TemplateError(f"{k!r} is not defined")
            return scope[k]
        return named
    if kind == "not":
        return lambda scope, a=value(node[1]): not a(scope)
    if kind == "filter":
        # what is read from a mapping may be of any length
        check = (lambda made: made) if node[2][0] == "key" else limited
        return lambda scope, f=FILTERS[node[1]], a=value(node[2]): check(f(show(a(scope))))
    a, b = value(node[1]), value(node[2])
    if kind == "key":
        def keyed(scope):
            have = a(scope)
            if not isinstance(have, dict):
                raise TemplateError("only mappings have keys")
            key = b(scope)
            if not isinstance(key, (str, int)):
                raise TemplateError("keys are texts or numbers")
            return have.get(key)
        return keyed
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    if kind == "!=":
        return lambda scope: a(scope) != b(scope)
    if kind == "in":
        return lambda scope: show(a(scope)) in show(b(scope))
    if kind == "+":
        def added(scope):
            x, y = a(scope), b(scope)
            return limited(x + y if type(x) is type(y) is int else show(x) + show(y))
        return added
    return lambda scope: limited(show(a(scope)) + show(b(scope)))


Pieces = Iterator[tuple[str, bool]]


def closure(node: tuple, trained: bool = False) -> Callable[[dict], Pieces]:
    """The closure of a template node; it yields pieces of output and whether they are trained on."""
    kind = node[0]
    if kind == "text":
        return lambda scope, piece=(node[1], trained): iter((piece,))
    if kind == "out":
        return lambda scope, v=value(node[1]): iter(((show(v(scope)), trained),))
    if kind == "gen":
        return closure(node[1], True)
    if kind == "set":
        def assign(scope, k=node[1], v=value(node[2])):
            scope[k] = v(scope)
            return iter(())
        return assign
    if kind == "if":
        arms = [(value(test), closure(body, trained)) for test, body in node[1]]

        def choose(scope):
            return next((body(scope) for test, body in arms if test(scope)), iter(()))
        return choose
    if kind == "for":
        name, over, body = node[1], value(node[2]), closure(node[3], trained)

        def loop(scope):
            given = over(scope)
            if not isinstance(given, (list, tuple, Iterator)):
                raise TemplateError("loops go over lists")
            rest, index, missing = iter(given), 0, object()
            item = next(rest, missing)
            while item is not missing:
                after = next(rest, missing)
                index += 1
                inner = dict(scope)
                inner[name] = item
                inner["loop"] = {"first": index == 1, "last": after is missing, "index": index}
                yield from body(inner)
                item = after
        return loop
    bodies = [closure(x, trained) for x in node[1]]

    def block(scope):
        for run in bodies:
            yield from run(scope)
    return block


def compile_template(source: str) -> Callable[[dict], Pieces]:
    return closure(fold(parse(source)))


def parts_of(pieces: Iterable[tuple[str, bool]], limit: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Output in parts of about ``limit`` characters, with the trained spans inside each."""
    text, size, spans = [], 0, []
    for piece, trained in pieces:
        if trained and piece:
            if spans and spans[-1][1] == size:
                spans[-1] = (spans[-1][0], size + len(piece))
            else:
                spans.append((size, size + len(piece)))
        text.append(piece)
        size += len(piece)
        if size >= limit:
            yield "".join(text), spans
            text, size, spans = [], 0, []
    yield "".join(text), spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, formatted, loss_spans``; a conversation's parts follow one another in one partition."""
    compile_template(template)  # a bad template fails here
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)
        stream = ((c, {"turn": t, "role": r, "text": x}) for b in batches for c, t, r, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        out: list[tuple] = []
        held = next(stream, None)
        size = 0
        while held is not None:
            conv, nxt = held[0], [held]

            def messages(conv=conv, nxt=nxt):
                while nxt[0] is not None and nxt[0][0] == conv:
                    yield nxt[0][1]
                    nxt[0] = next(stream, None)

            reader = messages()
            for k, (text, spans) in enumerate(parts_of(render({"messages": reader}), part_chars)):
                out.append((conv, k, text, [{"start": a, "stop": b} for a, b in spans]))
                size += len(text)
                if size > 4 * part_chars:
                    yield batch(out)
                    out, size = [], 0
            for _ in reader:  # what the template did not read
                pass
            held = nxt[0]
        if out:
            yield batch(out)

    def batch(out):
        conv, part, text, spans = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(text, pa.string()), pa.array(spans, SPANS)], ["conv_id", "part", "formatted", "loss_spans"])

    return rows.mapInArrow(run, "conv_id long, part long, formatted string, loss_spans array<struct<start:long,stop:long>>")


TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)


class Reader:
    """Reads formatted parts of one conversation back, turn by turn."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list) -> None:
        self.chars += len(text)
        for s in spans:
            plain = unescape(text[s["start"] : s["stop"]])
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode("utf-8", "surrogatepass"))
        self.rest += text
        at = 0
        for m in iter(lambda: TURN.match(self.rest, at), None):
            self.turns += 1
            self.turn_hash.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            at = m.end()
        self.rest = self.rest[at:]

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv} doesn't read back")
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations from what ``format_conversations`` wrote with the default template."""

    def run(batches):
        reader, conv, any_row, out = Reader(), None, False, []

        def batch():
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in READ_SCHEMA.split(", ")])

        for b in batches:
            for c, part, text, spans in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part == 0:
                    if any_row:
                        out.append(reader.row(conv))
                    reader, conv, any_row = Reader(), c, True
                reader.feed(text, spans)
            if len(out) >= 4096:
                yield batch()
        if any_row:
            out.append(reader.row(conv))
        if out:
            yield batch()

    return formatted.mapInArrow(run, READ_SCHEMA)
