"""A small template language for chat turns, compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% if %} / {% elif %} / {% else %} / {% endif %}`` and
``{% generation %} / {% endgeneration %}``, which marks what the loss covers. Expressions know string
and integer literals, ``role``, ``text``, ``index``, ``first``, ``+``, ``==``, ``!=``, ``and``, ``or``,
``not``, parentheses and the filters ``escape``, ``escape_line``, ``upper``, ``lower`` and ``trim``.
There is nothing else: no attributes, calls, loops or imports, so a template cannot reach the process.

``compile_template`` parses to a tree, folds what is constant and returns a closure that appends
``(text, in_loss)`` spans for one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<(\\*)\\\|")
LINE = re.compile(r"[\\\n]")
UNLINE = re.compile(r"\\([\\n])")
CUT = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+()|]))")
NAMES = ("role", "text", "index", "first")


def escape(s: str) -> str:
    """``<|`` cannot occur in the result; ``unescape`` gives the text back."""
    return CONTROL.sub(r"<\1\\|", s)


def unescape(s: str) -> str:
    return ESCAPED.sub(r"<\1|", s)


def escape_line(s: str) -> str:
    """``escape`` for a value that ends with its line."""
    return LINE.sub(lambda m: "\\n" if m[0] == "\n" else "\\\\", escape(s))


def unescape_line(s: str) -> str:
    return unescape(UNLINE.sub(lambda m: "\n" if m[1] == "n" else "\\", s))


FILTERS = {"escape": escape, "escape_line": escape_line, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or a filter with its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Put:
    expr: object


@dataclass(frozen=True)
class Branch:
    """(condition, body) pairs; the last condition may be a constant."""

    arms: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPS: dict[str, Callable] = {
    "+": lambda a, b: f"{a}{b}" if isinstance(a, str) or isinstance(b, str) else a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
    **{name: (lambda v, f=f: f(str(v))) for name, f in FILTERS.items()},
}


class _Expression:
    """Recursive descent over one expression; binds: or, and, not, comparison, +, filters."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read expression: {self.source!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][0].strip()
        return None

    def parse(self):
        node = self.either()
        if self.peek() is not None:
            raise TemplateError(f"left over {self.peek()!r} in {self.source!r}")
        return node

    def _left(self, below: Callable, *ops: str):
        node = below()
        while op := self.take(*ops):
            node = Apply(op, (node, below()))
        return node

    def either(self):
        return self._left(self.both, "or")

    def both(self):
        return self._left(self.negated, "and")

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self._left(self.total, "==", "!=")

    def total(self):
        return self._left(self.filtered, "+")

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Apply(name, (node,))
        return node

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"expression ends early: {self.source!r}")
        text, number, name, sign = self.tokens[self.at].groups()
        self.at += 1
        if text is not None:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if number is not None:
            return Const(int(number))
        if name in ("true", "false"):
            return Const(name == "true")
        if name in NAMES:
            return Name(name)
        if sign == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError(f"missing ) in {self.source!r}")
            return node
        raise TemplateError(f"unknown {name or sign!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """The tree of a template."""
    parts, at = [], 0
    for m in CUT.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                nodes.append(Put(Const(value)))
            elif kind == "put":
                nodes.append(Put(_Expression(value).parse()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                if word == "if":
                    nodes.append(branch(rest))
                elif word == "generation":
                    nodes.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), ""

    def branch(condition: str) -> Branch:
        arms, test = [], _Expression(condition).parse()
        while True:
            nodes, end = body("elif", "else", "endif")
            arms.append((test, nodes))
            if end == "endif":
                return Branch(tuple(arms))
            test = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).parse()

    return body()[0]


def fold(node):
    """The same tree with constant expressions evaluated, dead arms cut and neighbouring texts joined."""
    if isinstance(node, Apply):
        args = tuple(fold(a) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(OPS[node.op](*(a.value for a in args)))
        return Apply(node.op, args)
    if isinstance(node, Put):
        return Put(fold(node.expr))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Branch):
        arms = []
        for test, nodes in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(nodes)))
            if isinstance(test, Const):
                break
        return Branch(tuple(arms))
    if not isinstance(node, tuple):
        return node
    out: list = []
    for n in map(fold, node):
        flat = n.arms[0][1] if isinstance(n, Branch) and n.arms and isinstance(n.arms[0][0], Const) else (n,)
        for x in () if isinstance(n, Branch) and not n.arms else flat:
            both = out and isinstance(x, Put) and isinstance(out[-1], Put)
            if both and isinstance(x.expr, Const) and isinstance(out[-1].expr, Const):
                out[-1] = Put(Const(f"{out[-1].expr.value}{x.expr.value}"))
            else:
                out.append(x)
    return tuple(out)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env[n]
    args, op = [_value(a) for a in node.args], OPS[node.op]
    if len(args) == 1:
        return lambda env, a=args[0]: op(a(env))
    return lambda env, a=args[0], b=args[1]: op(a(env), b(env))


def _writer(nodes: tuple, in_loss: bool) -> Callable[[dict, list], None]:
    steps = []
    for n in nodes:
        if isinstance(n, Put):
            steps.append(lambda env, out, v=_value(n.expr): out.append((str(v(env)), in_loss)))
        elif isinstance(n, Generation):
            steps.append(_writer(n.body, True))
        else:
            arms = [(_value(t), _writer(b, in_loss)) for t, b in n.arms]

            def choose(env, out, arms=arms):
                for test, write in arms:
                    if test(env):
                        return write(env, out)
                return None

            steps.append(choose)

    def write(env: dict, out: list) -> None:
        for step in steps:
            step(env, out)

    return write


def compile_template(source: str) -> Callable[[str, str, int], list[tuple[str, bool]]]:
    """``render(role, text, index)`` to the spans of one turn."""
    write = _writer(fold(parse(source)), False)

    def render(role: str, text: str, index: int) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        write({"role": role, "text": text, "index": index, "first": index == 0}, out)
        return out

    return render
