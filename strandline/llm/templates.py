"""A small sandboxed template language for conversations: parsed to a tree, folded, and compiled to Python closures.

    {{ expression }}                     its value as text
    {% for m in messages %}..{% endfor %}   the conversation's turns, in order; once a template, and not inside anything else
    {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set name = expression %}          a variable: for the whole template before the loop, else until the turn ends
    {% generation %}..{% endgeneration %}   what is written inside is marked as a span
    {# comment #}

Expressions: 'text' or "text" (with \\n, \\t, \\\\, and quotes), whole numbers, true, false, none, names; m.role and m.text of
the loop's variable; loop.first, loop.last, loop.index, loop.index0, loop.length; e | filter; ~ joins texts; == != < > <= >=;
and, or, not; brackets. Filters are those of FILTERS. There are no calls, no other attributes and no indexing, so a
template reaches nothing but its conversation and the constants it is compiled with; it ends, as its one loop goes over
the conversation. Whatever it could get wrong by itself (unknown names and filters, misplaced statements) is an error when
it is compiled.

A template has three parts: what comes before the loop, its body, and what comes after it. Each turn's rendering depends
on the turn and its place only. So a long conversation can be rendered in pieces, by several tasks.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Templates are at most so long and so deeply nested.
LENGTH, DEPTH = 100_000, 50


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Takes control strings (all begin with <|) out of a text: one more backslash in each < \\...\\ |. ``unescape`` undoes it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def line(text: str) -> str:
    """A text as one line without control strings. ``unline`` undoes it."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def text_of(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {"escape": escape, "line": line, "upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


# --- the tree ---


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Apply:
    """function on the values of args; lazy: and, or."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Write:
    what: object


@dataclass(frozen=True)
class Set:
    name: str
    what: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


# --- text to tree ---

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>|~().=]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = self.depth = 0

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.next_is(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        out = self.any_of()
        self.end()
        return out

    def any_of(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("an expression is nested too deeply")
        out = self.all_of()
        while self.take("or"):
            out = Apply("or", (out, self.all_of()))
        self.depth -= 1
        return out

    def all_of(self):
        out = self.negated()
        while self.take("and"):
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self):
        times = 0
        while self.take("not"):
            times += 1
        out = self.compared()
        return out if not times else Apply("not", (out,)) if times % 2 else Apply("not", (Apply("not", (out,)),))

    def compared(self):
        out = self.joined()
        while sign := self.take(*_COMPARE):
            out = Apply(sign, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.take("~"):
            out = Apply("~", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.single()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Apply(f"|{name}", (out,))
        return out

    def single(self):
        if self.take("("):
            out = self.any_of()
            self.expect(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        return Field(value, self.name()) if self.take(".") else Name(value)


class _Parser:
    def __init__(self, source: str):
        if len(source) > LENGTH:
            raise TemplateError("the template is too long")
        self.pieces, at = [], 0
        for found in _PIECE.finditer(source):
            self.pieces.append(("text", source[at : found.start()]))
            if found[1] is not None:
                self.pieces.append(("write", found[1]))
            elif found[2] is not None:
                self.pieces.append(("do", found[2].strip()))
            at = found.end()
        self.pieces.append(("text", source[at:]))
        for kind, piece in self.pieces:
            if kind == "text" and re.search(r"\{[{%#]", piece):
                raise TemplateError("a tag is not closed")
        self.at = 0

    def body(self, *ends: str, depth: int = 0) -> tuple[tuple, str]:
        """Statements up to one of ``ends`` (a statement's first word, or '' for the end of the template), and that statement."""
        if depth > DEPTH:
            raise TemplateError("statements are nested too deeply")
        out = []
        while self.at < len(self.pieces):
            kind, piece = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                if piece:
                    out.append(Write(Const(piece)))
                continue
            if kind == "write":
                out.append(Write(_Expression(piece).whole()))
                continue
            word, rest = re.match(r"(\w*)(.*)", piece, re.DOTALL).groups()
            if word and word in ends:
                return tuple(out), piece
            out.append(self.statement(word, rest, depth))
        if "" not in ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str, depth: int):
        if word == "if":
            then, end = self.body("elif", "else", "endif", depth=depth + 1)
            test = _Expression(rest).whole()
            if end.startswith("elif"):
                return If(test, then, (self.statement("if", end[4:], depth + 1),))
            other = self.body("endif", depth=depth + 1)[0] if end == "else" else ()
            return If(test, then, other)
        if word == "for":
            head = _Expression(rest)
            name = head.name()
            head.expect("in")
            if head.name() != "messages":
                raise TemplateError("a loop goes over messages only")
            head.end()
            return Loop(name, self.body("endfor", depth=depth + 1)[0])
        if word == "set":
            head = _Expression(rest)
            name = head.name()
            head.expect("=")
            return Set(name, head.whole())
        if word == "generation" and not rest.strip():
            return Generation(self.body("endgeneration", depth=depth + 1)[0])
        raise TemplateError(f"unexpected statement {word!r}")


# --- tree to smaller tree ---

_FUNCTIONS: dict[str, Callable] = {
    "not": lambda a: not a, "~": lambda a, b: text_of(a) + text_of(b), **_COMPARE,
    **{f"|{name}": (lambda f: lambda a: f(text_of(a)))(f) for name, f in FILTERS.items()},
}


def _folded(e, known: dict):
    """An expression with everything worked out that does not depend on the conversation."""
    if isinstance(e, Name):
        return Const(known[e.name]) if e.name in known else e
    if not isinstance(e, Apply):
        return e
    args = tuple(_folded(a, known) for a in e.args)
    if e.name in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.name == "and") else args[0]
        return Apply(e.name, args)
    if all(isinstance(a, Const) for a in args):
        return Const(_call(e.name, [a.value for a in args]))
    return Apply(e.name, args)


def _call(name: str, values: list):
    try:
        return _FUNCTIONS[name](*values)
    except TypeError as error:
        raise TemplateError(f"{name!r} does not take {values!r}") from error


def _assigned(body: tuple) -> set[str]:
    """Names that statements set."""
    out = set()
    for s in body:
        out |= {s.name} if isinstance(s, Set) else _assigned(s.then) | _assigned(s.other) if isinstance(s, If) else _assigned(s.body) if isinstance(s, (Generation, Loop)) else set()
    return out


def fold(body: tuple, known: dict) -> tuple:
    """Statements with constants put in, branches that can't be taken left out, and neighbouring texts joined."""
    out: list = []
    for s in body:
        if isinstance(s, Write):
            what = _folded(s.what, known)
            if isinstance(what, Const):
                what = Const(text_of(what.value))
                if not what.value:
                    continue
                if out and isinstance(out[-1], Write) and isinstance(out[-1].what, Const):
                    what = Const(out.pop().what.value + what.value)
            out.append(Write(what))
        elif isinstance(s, Set):
            out.append(Set(s.name, _folded(s.what, known)))
        elif isinstance(s, If):
            test = _folded(s.test, known)
            if isinstance(test, Const):
                for inner in fold(s.then if test.value else s.other, known):
                    if isinstance(inner, Write) and isinstance(inner.what, Const) and out and isinstance(out[-1], Write) and isinstance(out[-1].what, Const):
                        inner = Write(Const(out.pop().what.value + inner.what.value))
                    out.append(inner)
            else:
                out.append(If(test, fold(s.then, known), fold(s.other, known)))
        else:
            out.append(type(s)(*((s.name,) if isinstance(s, Loop) else ()), fold(s.body, known)))
    return tuple(out)


# --- tree to closures ---


@dataclass
class Output:
    """What is written: texts, their length so far (code points), and marked spans."""

    texts: list = field(default_factory=list)
    length: int = 0
    spans: list = field(default_factory=list)

    def write(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)


_LOOP = ("first", "last", "index", "index0", "length")


def _value(e, names: set, loop: str | None) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, value=e.value: value
    if isinstance(e, Name):
        if e.name not in names:
            raise TemplateError(f"no name {e.name!r}")
        return lambda env, name=e.name: env.get(name)
    if isinstance(e, Field):
        if loop is None or not (e.of == loop and e.name in ("role", "text") or e.of == "loop" and e.name in _LOOP):
            raise TemplateError(f"no {e.of}.{e.name} here")
        return lambda env, key=("loop" if e.of == "loop" else "message", e.name): env[key]
    args = [_value(a, names, loop) for a in e.args]
    if e.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if len(args) == 1:
        return lambda env, name=e.name, a=args[0]: _call(name, [a(env)])
    return lambda env, name=e.name, a=args[0], b=args[1]: _call(name, [a(env), b(env)])


def _writer(e, names: set, loop: str | None) -> Callable[[dict, Output], None]:
    if isinstance(e, Const):
        return lambda env, out, text=e.value: out.write(text)
    value = _value(e, names, loop)
    return lambda env, out: out.write(text_of(value(env)))


def _steps(body: tuple, names: set, loop: str | None = None, inside: bool = False) -> Callable[[dict, Output], None]:
    """One function for a list of statements. names: what may be read; set statements add to it."""
    steps = []
    for s in body:
        if isinstance(s, Write):
            steps.append(_writer(s.what, names, loop))
        elif isinstance(s, Set):
            value = _value(s.what, names, loop)
            steps.append(lambda env, out, name=s.name, value=value: env.__setitem__(name, value(env)))
            names.add(s.name)
        elif isinstance(s, If):
            test, then, other = _value(s.test, names, loop), _steps(s.then, names, loop, inside), _steps(s.other, names, loop, inside)
            steps.append(lambda env, out, test=test, then=then, other=other: then(env, out) if test(env) else other(env, out))
        elif isinstance(s, Generation):
            if inside:
                raise TemplateError("generation inside generation")
            steps.append(_marked(_steps(s.body, names, loop, True)))
        else:
            raise TemplateError("the loop over messages stands by itself, once")
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _marked(body: Callable) -> Callable:
    def run(env: dict, out: Output) -> None:
        begin = out.length
        body(env, out)
        out.spans.append((begin, out.length))

    return run


class Template:
    """A compiled template. constants: names that it may read, put in when it is compiled."""

    def __init__(self, source: str, constants: dict | None = None):
        tree, _ = _Parser(source).body("")
        known = {k: v for k, v in (constants or {}).items() if k not in _assigned(tree)}
        self.tree = fold(tree, known)
        loops = [i for i, s in enumerate(self.tree) if isinstance(s, Loop)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        loop = self.tree[loops[0]]
        if loop.name in ("loop", "messages") or loop.name in _assigned(self.tree):
            raise TemplateError(f"{loop.name!r} is taken")
        self.constants = {k: v for k, v in (constants or {}).items() if k not in known}
        names = set(self.constants)
        self._before = _steps(self.tree[: loops[0]], names)
        self._after = _steps(self.tree[loops[0] + 1 :], set(names))
        self._body = _steps(loop.body, set(names), loop.name)

    def start(self) -> tuple[dict, Output]:
        """The variables that every turn sees, and what comes before the first."""
        env, out = dict(self.constants), Output()
        self._before(env, out)
        return env, out

    def turn(self, env: dict, out: Output, role: str, text: str, index: int, length: int) -> None:
        own = dict(env)
        own |= {("message", "role"): role, ("message", "text"): text, ("loop", "index0"): index, ("loop", "index"): index + 1}
        own |= {("loop", "length"): length, ("loop", "first"): index == 0, ("loop", "last"): index == length - 1}
        self._body(own, out)

    def finish(self, env: dict, out: Output) -> None:
        self._after(dict(env), out)

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """Text and marked spans (code points) of a conversation, a list of (role, text)."""
        env, out = self.start()
        for i, (role, text) in enumerate(messages):
            self.turn(env, out, role, text, i, len(messages))
        self.finish(env, out)
        return "".join(out.texts), out.spans
