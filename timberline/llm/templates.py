"""A small sandboxed template language: parsed into a syntax tree, folded, and turned into Python closures.

``{{ expression }}`` writes a value, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``, ``{% set x = ... %}`` and
``{% generation %}`` are blocks, ``{# #}`` is a comment; a ``-`` inside a bracket removes the white space beside it.
Expressions know texts, whole numbers, ``true false none``, ``or and not``, comparisons, ``in``, ``+ - * // %``, ``~`` (joins
texts), ``a if c else b``, ``x.key``, ``x['key']`` and ``x | filter``.

The sandbox: names are those given to ``render``; a key is looked up in mappings only, a position in lists only, never an attribute
of a Python object; there are no calls but the given filters and ``raise_exception``; ``*`` multiplies numbers only; a loop
runs over a given list, so rendering ends. What is missing is none, and none is written as nothing.

Folding evaluates what depends on no variable: operators and filters of constants, branches of constant tests; neighbouring
texts become one. The closures write to a sink: ``write(text, masked)`` per piece, and ``masked(start)`` as a generation block
starts and ends.
"""

from __future__ import annotations

import inspect
import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields, replace


class TemplateError(ValueError):
    """The template is wrong, or asked to stop."""


# -- syntax tree ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or a filter, by name, of its arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Either:
    """``or`` (gives the first true value) and ``and`` (the first false one)."""

    stop_at: bool
    first: object
    second: object


@dataclass(frozen=True)
class Stop:
    message: object


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- operators and filters --------------------------------------------------------------------


def _number(value):
    if isinstance(value, bool) or not isinstance(value, int):
        raise TemplateError("a whole number is needed")
    return value


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written")


def _ordered(compare):
    def run(a, b):
        if isinstance(a, str) and isinstance(b, str):
            return compare(a, b)
        return compare(_number(a), _number(b))

    return run


def _plus(a, b):
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)


def _divided(compute):
    def run(a, b):
        if _number(b) == 0:
            raise TemplateError("division by zero")
        return compute(_number(a), b)

    return run


def _within(a, b):
    if isinstance(b, str):
        return _text(a) in b
    if isinstance(b, (list, tuple, dict)):
        return a in b
    if b is None:
        return False
    raise TemplateError("only texts, lists and mappings hold something")


def _length(value):
    if isinstance(value, (str, list, tuple, dict)):
        return len(value)
    if value is None:
        return 0
    raise TemplateError("numbers have no length")


def _items(value):
    if value is None:
        return iter(())
    if isinstance(value, (list, tuple, dict)) or hasattr(value, "__next__"):
        return iter(value)
    raise TemplateError("only a list can be gone through")


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne,
    "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
    "in": _within, "not in": lambda a, b: not _within(a, b), "not": operator.not_,
    "~": lambda a, b: _text(a) + _text(b), "+": _plus,
    "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "neg": lambda a: -_number(a),
    "//": _divided(operator.floordiv), "%": _divided(operator.mod),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "string": _text, "length": _length, "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)),
}

# -- reading ----------------------------------------------------------------------------------

_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_TOKEN = re.compile(rf"\s*(?:(?P<text>{_QUOTED})|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>=.|()\[\],]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"or", "and", "not", "in", "if", "else", "is"}
_VALUES = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _tags(source: str):
    """(kind, content) of texts and brackets; a quoted text may hold a bracket's end."""
    at, trim = 0, False
    for start in iter(lambda: _next_open(source, at), -1):
        kind, text = source[start + 1], source[at:start]
        left = source[start + 2:start + 3] == "-"
        end = {"{": "}}", "%": "%}", "#": "#}"}[kind]
        inside = start + 2 + left
        stop = _closing(source, inside, end, quotes=kind != "#")
        right = source[stop - 1] == "-" and stop - 1 >= inside
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if left else text
        if kind != "#":
            yield {"{": "value", "%": "block"}[kind], source[inside:stop - right]
        at, trim = stop + 2, right
    yield "text", source[at:].lstrip() if trim else source[at:]


def _next_open(source: str, at: int) -> int:
    found = re.compile(r"\{[{%#]").search(source, at)
    return found.start() if found else -1


def _closing(source: str, at: int, end: str, quotes: bool) -> int:
    step = re.compile((rf"{_QUOTED}|" if quotes else "") + re.escape(end), re.S)
    while found := step.search(source, at):
        if found[0] == end:
            return found.start()
        at = found.end()
    raise TemplateError(f"{end} is missing")


class _Expression:
    """Recursive descent over the tokens of one bracket."""

    def __init__(self, code: str, filters):
        self.tokens, self.at, self.filters = [], 0, filters
        place, code = 0, code.rstrip()
        while place < len(code):
            found = _TOKEN.match(code, place)
            if not found:
                raise TemplateError(f"cannot read {code[place:].strip()!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> bool:
        found = self.peek(*wanted)
        self.at += found
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _WORDS | _VALUES.keys():
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} was not expected")

    def whole(self):
        found = self.choice()
        self.end()
        return found

    def choice(self):
        found = self.either()
        if self.take("if"):
            test = self.either()
            found = Choice(test, found, self.choice() if self.take("else") else Const(None))
        return found

    def either(self):
        found = self.both()
        while self.take("or"):
            found = Either(True, found, self.both())
        return found

    def both(self):
        found = self.negated()
        while self.take("and"):
            found = Either(False, found, self.negated())
        return found

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        found = self.joined()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            sign = self.tokens[self.at][1]
            self.at += 1
            if sign == "is":
                sign = "!=" if self.take("not") else "=="
                if not self.take("none", "None"):
                    sign = {"==": "!=", "!=": "=="}[sign]
                    self.need("defined")
                found = Apply(sign, (found, Const(None)))
                continue
            if sign == "not":
                self.need("in")
                sign = "not in"
            found = Apply(sign, (found, self.joined()))
        return found

    def _left(self, signs, inner):
        found = inner()
        while self.peek(*signs):
            self.at += 1
            found = Apply(self.tokens[self.at - 1][1], (found, inner()))
        return found

    def joined(self):
        return self._left(("~",), self.sum)

    def sum(self):
        return self._left(("+", "-"), self.product)

    def product(self):
        return self._left(("*", "//", "%"), self.signed)

    def signed(self):
        return Apply("neg", (self.signed(),)) if self.take("-") else self.filtered()

    def filtered(self):
        found = self.part()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            found = Apply(f"|{name}", (found, *(self.arguments() if self.take("(") else ())))
            try:
                inspect.signature(self.filters[name]).bind(*found.args)
            except TypeError as wrong:
                raise TemplateError(f"filter {name!r}: {wrong}") from None
        return found

    def arguments(self):
        found = []
        while not self.take(")"):
            found.append(self.choice())
            if not self.peek(")"):
                self.need(",")
        return tuple(found)

    def part(self):
        found = self.atom()
        while self.peek(".", "["):
            if self.take("."):
                found = Get(found, Const(self.name()))
            else:
                self.need("[")
                found = Get(found, self.choice())
                self.need("]")
        return found

    def atom(self):
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, found = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), found[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(found))
        if found in _VALUES:
            self.at += 1
            return Const(_VALUES[found])
        name = self.name()
        if self.take("("):
            if name != "raise_exception":
                raise TemplateError(f"{name!r} cannot be called")
            arguments = self.arguments()
            if len(arguments) != 1:
                raise TemplateError("raise_exception takes one message")
            return Stop(arguments[0])
        return Name(name)


class _Parser:
    def __init__(self, source: str, filters):
        self.tags, self.filters = list(_tags(source)), filters
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str, _Expression | None]:
        """Statements up to one of the block words in ``ends``, that word, and what follows it."""
        found = []
        while self.at < len(self.tags):
            kind, content = self.tags[self.at]
            self.at += 1
            if kind == "text":
                found.append(Write(Const(content)))
                continue
            rest = _Expression(content, self.filters)
            if kind == "value":
                found.append(Write(rest.whole()))
                continue
            word = rest.tokens[0][1] if rest.tokens else ""
            rest.at = 1
            if word in ends:
                return tuple(found), word, rest
            found.append(self.block(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(found), "", None

    def block(self, word: str, rest: _Expression):
        if word == "for":
            name = rest.name()
            rest.need("in")
            over = rest.whole()
            return Loop(name, over, self.closed("endfor"))
        if word == "if":
            return self.branches(rest)
        if word == "set":
            name = rest.name()
            rest.need("=")
            return Put(name, rest.whole())
        if word == "generation":
            rest.end()
            return Generation(self.closed("endgeneration"))
        raise TemplateError(f"unknown block {word!r}")

    def closed(self, end: str) -> tuple:
        body, _, rest = self.body(end)
        rest.end()
        return body

    def branches(self, test: _Expression) -> If:
        condition = test.whole()
        yes, word, rest = self.body("elif", "else", "endif")
        if word == "elif":
            return If(condition, yes, (self.branches(rest),))
        rest.end()
        return If(condition, yes, self.closed("endif") if word == "else" else ())


# -- folding ----------------------------------------------------------------------------------


def fold(node, constants: dict, functions: dict):
    """The tree with everything evaluated that depends on no variable; a body becomes a tuple of statements."""
    if isinstance(node, tuple):
        return _joined([piece for part in node for piece in _statements(fold(part, constants, functions))])
    if isinstance(node, Name):
        return Const(constants[node.name]) if node.name in constants else node
    if isinstance(node, (Loop, Put)) and node.name in constants:
        raise TemplateError(f"{node.name!r} is a constant")
    if isinstance(node, Apply):
        args = tuple(fold(a, constants, functions) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(functions[node.name](*[a.value for a in args]))
            except TemplateError:
                pass  # it may stand in a branch that is never taken
        return replace(node, args=args)
    changed = replace(node, **{
        f.name: fold(part, constants, functions) for f in fields(node)
        if isinstance(part := getattr(node, f.name), tuple) or hasattr(part, "__dataclass_fields__")
    })
    if isinstance(changed, Choice) and isinstance(changed.test, Const):
        return changed.yes if changed.test.value else changed.no
    if isinstance(changed, Either) and isinstance(changed.first, Const):
        return changed.first if bool(changed.first.value) == changed.stop_at else changed.second
    if isinstance(changed, Get) and isinstance(changed.of, Const) and isinstance(changed.key, Const):
        return Const(_get(changed.of.value, changed.key.value))
    if isinstance(changed, If) and isinstance(changed.test, Const):
        return changed.yes if changed.test.value else changed.no
    if isinstance(changed, Write) and isinstance(changed.value, Const):
        return Write(Const(_text(changed.value.value)))
    return changed


def _statements(found) -> tuple:
    return found if isinstance(found, tuple) else (found,)


def _joined(parts: list) -> tuple:
    out: list = []
    for part in parts:
        fixed = isinstance(part, Write) and isinstance(part.value, Const)
        if fixed and out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
            out[-1] = Write(Const(out[-1].value.value + part.value.value))
        elif not fixed or part.value.value:
            out.append(part)
    return tuple(out)


# -- closures ---------------------------------------------------------------------------------


def _get(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    if of is None or isinstance(of, (str, int, list, tuple)):
        return None
    raise TemplateError("keys belong to mappings")


def _stop(message):
    raise TemplateError(_text(message))


def _value(node, functions) -> Callable[[dict], object]:
    """The closure that gives an expression's value from the variables."""
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        return lambda env, name=node.name: env.get(name)
    if isinstance(node, Get):
        of, key = _value(node.of, functions), _value(node.key, functions)
        return lambda env: _get(of(env), key(env))
    if isinstance(node, Choice):
        test, yes, no = (_value(x, functions) for x in (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, Either):
        first, second, stop_at = _value(node.first, functions), _value(node.second, functions), node.stop_at
        return lambda env: found if bool(found := first(env)) == stop_at else second(env)
    if isinstance(node, Stop):
        message = _value(node.message, functions)
        return lambda env: _stop(message(env))
    function, args = functions[node.name], [_value(a, functions) for a in node.args]
    if len(args) == 1:
        only = args[0]
        return lambda env: function(only(env))
    if len(args) == 2:
        a, b = args
        return lambda env: function(a(env), b(env))
    return lambda env: function(*[a(env) for a in args])


def _steps(body: tuple, functions, masked: bool) -> list[Callable]:
    return [_step(node, functions, masked) for node in body]


def _step(node, functions, masked: bool) -> Callable[[dict, object], None]:
    """The closure that carries out a statement; whether its output is masked is known here already."""
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda env, sink, text=node.value.value: sink.write(text, masked)
        value = _value(node.value, functions)
        return lambda env, sink: sink.write(_text(value(env)), masked)
    if isinstance(node, Put):
        value = _value(node.value, functions)
        return lambda env, sink, name=node.name: env.__setitem__(name, value(env))
    if isinstance(node, If):
        test, yes, no = _value(node.test, functions), _steps(node.yes, functions, masked), _steps(node.no, functions, masked)

        def branch(env, sink):
            for step in yes if test(env) else no:
                step(env, sink)

        return branch
    if isinstance(node, Generation):
        if masked:
            raise TemplateError("a generation block cannot hold another")
        inner = _steps(node.body, functions, True)

        def generate(env, sink):
            sink.masked(True)
            for step in inner:
                step(env, sink)
            sink.masked(False)

        return generate
    over, inner, name = _value(node.over, functions), _steps(node.body, functions, masked), node.name

    def loop(env, sink):
        items, i = _items(over(env)), 0
        item = next(items, items)  # the iterator itself stands for the end
        while item is not items:
            after = next(items, items)
            mine = {**env, name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": after is items}}
            for step in inner:
                step(mine, sink)
            item, i = after, i + 1

    return loop


def _uses(node, name: str) -> int:
    if isinstance(node, Name):
        return node.name == name
    if isinstance(node, tuple):
        return sum(_uses(part, name) for part in node)
    return sum(_uses(getattr(node, f.name), name) for f in fields(node)) if hasattr(node, "__dataclass_fields__") else 0


class Template:
    """A compiled template. ``constants`` are known when it is compiled; ``filters`` are added to the given ones."""

    def __init__(self, source: str, constants: dict | None = None, filters: dict[str, Callable] | None = None):
        known = FILTERS | (filters or {})
        functions = OPERATORS | {f"|{name}": function for name, function in known.items()}
        tree, _, _ = _Parser(source, known).body()
        self.tree = fold(tree, constants or {}, functions)
        self._run = _steps(self.tree, functions, False)

    def streams(self, name: str) -> bool:
        """Whether a list is only gone through once, from the front, so that an iterator will do."""
        direct = [s for s in self.tree if isinstance(s, Loop) and s.over == Name(name)]
        return len(direct) == 1 and _uses(self.tree, name) == 1

    def render(self, sink, **variables: object) -> None:
        for name, value in variables.items():
            if not isinstance(value, (dict, list, tuple, str, int, type(None))) and not (isinstance(value, Iterable) and self.streams(name)):
                raise TemplateError(f"{name!r} must be plain data")
        env = dict(variables)
        for step in self._run:
            step(env, sink)
