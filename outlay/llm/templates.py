"""A small, sandboxed template language, compiled to Python closures.

Texts hold ``{{ expression }}`` and the tags ``{% for name in list %}``, ``{% if test %}`` with ``{% elif test %}``
and ``{% else %}``, and ``{% generation %}``, each closed by ``end`` and its name. Expressions are names, texts in quotes, whole
numbers, ``true``, ``false`` and ``none``, keys after a dot, ``==``, ``!=``, ``and``, ``or``, ``not``, ``~`` (joins texts), parentheses, and
filters after ``|``. A dot reads a key of a dict and nothing else, filters are the ones listed here, and there are
no calls, so a template cannot reach Python objects, files or modules; its loops are over the lists it is
given, so it ends. In a loop, ``loop.first``, ``loop.last`` and ``loop.index`` are known.

``compile_template`` parses to a tree, folds constants (names given at that time count as constants,
tests that are constant leave one branch, neighbouring texts become one), and makes a closure of each node.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>[0-9]+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~|.(),]))""")
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template cannot be read, or asks for something that the language does not have."""


def shown(value: Any) -> str:
    """Values as text; none is empty."""
    return "" if value is None else value if isinstance(value, str) else str(value)


def escaped(text: str, control: tuple[str, ...]) -> str:
    """Every backslash and control string with a backslash before it; longer control strings go first."""
    if not any(c in text for c in ("\\", *control)):
        return text
    return re.sub("|".join(map(re.escape, sorted(("\\", *control), key=len, reverse=True))), lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    """The text that ``escaped`` made this of: backslashes go, what follows each stays."""
    return text if "\\" not in text else re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: Filters: the value and the filter's arguments.
FILTERS: dict[str, Callable[..., str]] = {
    "escape": None,  # knows the control strings of the template
    "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "title": lambda v: shown(v).title(),
}


@dataclass
class Node:
    """``kind`` with the parts ``of`` and a plain ``value``."""

    kind: str
    value: Any = None
    of: list[Node] = field(default_factory=list)


# Expressions


class _Reader:
    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] != "text" else None

    def take(self, *signs: str) -> str | None:
        if self.peek() in signs:
            return self.tokens.pop(0)[1]
        return None

    def must(self, kind: str) -> str:
        if not self.tokens or self.tokens[0][0] != kind:
            raise TemplateError(f"expected a {kind} before {self.tokens[:1]}")
        return self.tokens.pop(0)[1]

    def whole(self) -> Node:
        node = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", of=[node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", of=[node, self.negated()])
        return node

    def negated(self) -> Node:
        turns = 0
        while self.take("not"):
            turns += 1
        node = self.compared()
        for _ in range(turns):
            node = Node("not", of=[node])
        return node

    def compared(self) -> Node:
        node = self.joined()
        while sign := self.take("==", "!="):
            node = Node(sign, of=[node, self.joined()])
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.take("~"):
            node = Node("~", of=[node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.keyed()
        while self.take("|"):
            name, args = self.must("name"), []
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.must("text")[1:-1])
                    self.take(",")
            if args and name != "escape":
                raise TemplateError(f"filter {name!r} takes no arguments")
            node = Node("filter", (name, tuple(args)), [node])
        return node

    def keyed(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
        elif self.tokens and self.tokens[0][0] == "text":
            node = Node("constant", self.must("text")[1:-1])
        elif self.tokens and self.tokens[0][0] == "number":
            node = Node("constant", int(self.must("number")))
        else:
            name = self.must("name")
            node = Node("constant", _CONSTANTS[name]) if name in _CONSTANTS else Node("name", name)
        while self.take("."):
            node = Node("key", self.must("name"), [node])
        return node


# Texts and tags


def parse(source: str) -> Node:
    """The syntax tree: a ``list`` of texts, outputs, loops, choices and generations."""
    root = Node("list")
    open_tags: list[tuple[str, Node]] = []  # the tag, and the list that its content goes to
    into, at = root, 0

    def begin(tag: str, node: Node) -> Node:
        into.of.append(node)
        open_tags.append((tag, into))
        node.of.append(Node("list"))
        return node.of[-1]

    for m in _PARTS.finditer(source):
        if m.start() > at:
            into.of.append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            into.of.append(Node("output", of=[_Reader(m[1]).whole()]))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            loop = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not loop or loop[1] == "loop" or loop[1] in _CONSTANTS:
                raise TemplateError(f"cannot read the loop {rest!r}")
            into = begin("for", Node("for", loop[1], [_Reader(loop[2]).whole()]))
        elif word == "if":
            into = begin("if", Node("if", of=[_Reader(rest).whole()]))
        elif word == "generation":
            into = begin("generation", Node("generation"))
        elif word in ("elif", "else") and open_tags and open_tags[-1][0] == "if":
            choice = open_tags[-1][1].of[-1]
            if len(choice.of) % 2:
                raise TemplateError(f"{word!r} after else")
            choice.of += [_Reader(rest).whole(), Node("list")] if word == "elif" else [Node("list")]
            into = choice.of[-1]
        elif word.startswith("end") and open_tags and word == "end" + open_tags[-1][0] and not rest.strip():
            into = open_tags.pop()[1]
        else:
            raise TemplateError(f"unexpected tag {m[2].strip()!r}")
    if open_tags:
        raise TemplateError(f"{open_tags[-1][0]!r} is not closed")
    if at < len(source):
        into.of.append(Node("text", source[at:]))
    return root


# Folding


def _value(kind: str, value: Any, got: list[Any], control: tuple[str, ...]) -> Any:
    if kind == "~":
        return shown(got[0]) + shown(got[1])
    if kind in ("==", "!="):
        return (got[0] == got[1]) == (kind == "==")
    if kind == "not":
        return not got[0]
    if kind == "key":
        return got[0].get(value) if isinstance(got[0], Mapping) else None
    name, args = value
    return escaped(shown(got[0]), (*control, *args)) if name == "escape" else FILTERS[name](got[0])


def fold(node: Node, known: Mapping[str, Any], control: tuple[str, ...] = ()) -> Node:
    """The tree with everything worked out that only needs constants and ``known`` names."""
    if node.kind in ("constant", "text"):
        return node
    if node.kind == "name":
        return Node("constant", known[node.value]) if node.value in known else node
    if node.kind == "for":
        inner = {k: v for k, v in known.items() if k not in (node.value, "loop")}
        return Node("for", node.value, [fold(node.of[0], known, control), fold(node.of[1], inner, control)])
    of = [fold(n, known, control) for n in node.of]
    if node.kind == "list":
        out: list[Node] = []
        for n in of:
            if n.kind == "output" and n.of[0].kind == "constant":
                n = Node("text", shown(n.of[0].value))
            for m in n.of if n.kind == "list" else [n]:
                if m.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", out[-1].value + m.value)
                elif m.kind != "text" or m.value:
                    out.append(m)
        return Node("list", of=out)
    if node.kind == "if":
        left: list[Node] = []
        for i in range(0, len(of) - 1, 2):
            if of[i].kind != "constant":
                left += of[i : i + 2]
            elif of[i].value:
                left.append(of[i + 1])
                break
        else:
            left += of[len(of) // 2 * 2 :]
        if not left:
            return Node("list")
        return left[0] if len(left) == 1 else Node("if", of=left)
    if node.kind in ("and", "or"):
        if of[0].kind == "constant":
            return of[1] if bool(of[0].value) == (node.kind == "and") else of[0]
    elif node.kind not in ("output", "generation") and all(n.kind == "constant" for n in of):
        return Node("constant", _value(node.kind, node.value, [n.value for n in of], control))
    return Node(node.kind, node.value, of)


# Closures


class Output:
    """What a template has written so far, and the ranges of it that a model is to learn."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)


class Stretch(list):
    """Rows ``offset`` and following of a longer list, up to its end or not."""

    def __init__(self, rows: list[Any], offset: int = 0, ends: bool = True) -> None:
        super().__init__(rows)
        self.offset, self.ends = offset, ends


Names = dict[str, Any]


def _expression(node: Node, control: tuple[str, ...]) -> Callable[[Names], Any]:
    kind, value = node.kind, node.value
    if kind == "constant":
        return lambda names: value
    if kind == "name":
        return lambda names: names.get(value)
    of = [_expression(n, control) for n in node.of]
    if kind == "and":
        return lambda names: of[0](names) and of[1](names)
    if kind == "or":
        return lambda names: of[0](names) or of[1](names)
    return lambda names: _value(kind, value, [f(names) for f in of], control)


def _statement(node: Node, control: tuple[str, ...]) -> Callable[[Names, Output], None]:
    if node.kind == "text":
        text = node.value
        return lambda names, out: out.add(text)
    if node.kind == "output":
        value = _expression(node.of[0], control)
        return lambda names, out: out.add(shown(value(names)))
    if node.kind == "generation":
        inner = _statement(node.of[0], control)

        def generation(names: Names, out: Output) -> None:
            start = out.length
            inner(names, out)
            if out.length > start:
                out.spans.append((start, out.length))

        return generation
    if node.kind == "if":
        tests = [_expression(n, control) for n in node.of[: len(node.of) // 2 * 2 : 2]]
        then = [_statement(n, control) for n in node.of[1 : len(node.of) // 2 * 2 : 2]]
        last = _statement(node.of[-1], control) if len(node.of) % 2 else None

        def choice(names: Names, out: Output) -> None:
            for test, branch in zip(tests, then, strict=True):
                if test(names):
                    return branch(names, out)
            if last:
                last(names, out)

        return choice
    if node.kind == "for":
        name, rows, body = node.value, _expression(node.of[0], control), _statement(node.of[1], control)

        def loop(names: Names, out: Output) -> None:
            listed = rows(names)
            if not isinstance(listed, list):
                return
            stretch = listed if isinstance(listed, Stretch) else Stretch(listed)
            stop = stretch.offset + len(listed)
            for i, row in enumerate(listed, stretch.offset):
                body({**names, name: row, "loop": {"index": i + 1, "first": i == 0, "last": stretch.ends and i + 1 == stop}}, out)

        return loop
    parts = [_statement(n, control) for n in node.of]

    def every(names: Names, out: Output) -> None:
        for part in parts:
            part(names, out)

    return every


def compile_template(source: str, control: tuple[str, ...] = (), known: Mapping[str, Any] | None = None) -> Callable[[Names], Output]:
    """A function from names to ``Output``. ``control`` are the strings that ``escape`` makes harmless."""
    return _renderer(fold(parse(source), known or {}, control), control)


def _renderer(tree: Node, control: tuple[str, ...]) -> Callable[[Names], Output]:
    body = _statement(tree, control)

    def render(names: Names) -> Output:
        out = Output()
        body(names, out)
        return out

    return render


def _names(node: Node) -> int:
    return (node.kind == "name" and node.value == "turns") + sum(map(_names, node.of))


def compile_chat(source: str, control: tuple[str, ...] = (), known: Mapping[str, Any] | None = None) -> Callable[[Stretch], Output]:
    """A function from a stretch of a conversation's turns to its part of the output.

    The template has one loop over ``turns`` that is not inside another tag, and names ``turns`` nowhere else. What stands before
    the loop goes with the first turn, what stands after it with the last.
    """
    tree = fold(parse(source), known or {}, control)
    loops = [i for i, n in enumerate(tree.of) if n.kind == "for" and n.of[0].kind == "name" and n.of[0].value == "turns"]
    if len(loops) != 1 or _names(tree) != 1:
        raise TemplateError("the template needs one loop over turns, outside of other tags, and no other use of turns")
    at = loops[0]
    whole = {
        (first, last): _renderer(Node("list", of=tree.of[0 if first else at : None if last else at + 1]), control)
        for first in (True, False)
        for last in (True, False)
    }

    def render(turns: Stretch) -> Output:
        return whole[turns.offset == 0, turns.ends]({"turns": turns})

    return render
