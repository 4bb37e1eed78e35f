"""Prompt templates with conditions, loops, filters and attributes, compiled to one column each.

A template is read once on the driver and becomes an expression over the data columns, so rendering
is part of the query and every row is rendered by Spark's own functions. Known are

- ``{{ expression }}``, ``{# comment #}``, ``{% if %} {% elif %} {% else %} {% endif %}`` and
  ``{% for x in list %} {% else %} {% endfor %}`` with ``loop.index``, ``index0``, ``first``, ``last``
  and ``length``; a ``-`` inside a tag's mark drops the white space on that side;
- names of data columns in lower case, fields (``a.b``), items (``a[0]``, from the end below zero),
  texts, numbers, ``true``, ``false`` and ``none``;
- ``a if c else b``, ``or``, ``and``, ``not``, ``== != < <= > >= in``, ``+ - * // %``, ``~`` (joins
  texts), the tests ``is [not] defined`` and ``is [not] none``;
- the filters and methods of ``FILTERS`` and ``METHODS``.

Missing values print as empty text, are false, and loops over them do nothing. A name that the data
does not have prints as ``{{ name }}`` and is otherwise like a missing value; ``default`` takes the place
of such names only, and of missing values. One line end at the very end of a template does not
count. A template that cannot be read raises a :class:`TemplateError`, which names line and column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.text import once

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<mark>==|!=|<=|>=|//|[-+*%~|.,()\[\]<>=/]))""",
    re.X | re.S,
)
_TAG = re.compile(r"\{\{-?|\{%-?|\{\#-?")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that cannot be read."""


@dataclass
class Value:
    """A column with its type; without a type it is a name that the data does not have."""

    column: Column | None
    kind: T.DataType | None
    shown: str = ""
    truth: Column | None = None

    def text(self) -> Column:
        """As it is printed; missing values are null."""
        if self.kind is None:
            return F.lit(self.shown)
        if isinstance(self.kind, T.BooleanType):
            return F.when(self.column, "True").when(~self.column, "False")
        if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(self.column)
        return self.column.cast("string")

    def true(self) -> Column:
        if self.truth is not None:
            return self.truth
        if self.kind is None or isinstance(self.kind, T.NullType):
            return F.lit(False)
        if isinstance(self.kind, T.BooleanType):
            found = self.column
        elif isinstance(self.kind, T.StringType):
            found = self.column != ""
        elif isinstance(self.kind, T.NumericType):
            found = self.column != 0
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            found = F.size(self.column) > 0
        else:
            found = self.column.isNotNull()
        return F.coalesce(found, F.lit(False))

    def is_number(self) -> bool:
        return isinstance(self.kind, T.NumericType)


_TEXT, _LONG, _FLAG = T.StringType(), T.LongType(), T.BooleanType()


def _text(column: Column) -> Value:
    return Value(column, _TEXT)


def _length(v: Value) -> Value:
    many = isinstance(v.kind, (T.ArrayType, T.MapType))
    return Value(F.coalesce(F.size(v.column) if many else F.char_length(v.text()), F.lit(0)).cast("bigint"), _LONG)


def _default(v: Value, other: Value) -> Value:
    if v.kind is None:
        return other
    return Value(F.coalesce(v.column, other.column), v.kind) if v.kind == other.kind else _text(F.coalesce(v.text(), other.text()))


def _at(v: Value, place: Column) -> Value:
    if isinstance(v.kind, T.ArrayType):
        return Value(F.try_element_at(v.column, place), v.kind.elementType)
    at = F.when(place > 0, place).otherwise(F.char_length(v.text()) + place + 1)
    return _text(F.when((at > 0) & (at <= F.char_length(v.text())), F.substring(v.text(), at, F.lit(1))))


def _joined(v: Value, mark: Value | None = None) -> Value:
    if not isinstance(v.kind, T.ArrayType):
        return v
    items = F.transform(v.column, lambda x: F.coalesce(Value(x, v.kind.elementType).text(), F.lit("")))
    return _text(F.array_join(items, "") if mark is None else _join_by(items, mark.text()))


def _join_by(items: Column, mark: Column) -> Column:
    later = F.array_join(F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda x: F.concat(mark, x)), "")
    return F.when(F.size(items) == 0, "").otherwise(F.concat(F.get(items, F.lit(0)), later))


def _capitalized(v: Value) -> Value:
    return _text(F.concat(F.upper(F.substring(v.text(), 1, 1)), F.lower(F.substr(v.text(), F.lit(2)))))


def _replaced(v: Value, old: Value, new: Value) -> Value:
    return _text(F.replace(v.text(), old.text(), new.text()))


def _split(v: Value, mark: Value) -> Value:
    """Parts between marks, which are taken as they stand."""
    return Value(F.call_function("split", v.text(), F.concat(F.lit(r"\Q"), mark.text(), F.lit(r"\E"))), T.ArrayType(_TEXT))


FILTERS: dict[str, Callable[..., Value]] = {
    "upper": lambda v: _text(F.upper(v.text())),
    "lower": lambda v: _text(F.lower(v.text())),
    "trim": lambda v: _text(F.regexp_replace(v.text(), r"(?U)^\s+|\s+\z", "")),
    "capitalize": _capitalized,
    "length": _length,
    "count": _length,
    "default": _default,
    "d": _default,
    "first": lambda v: _at(v, F.lit(1)),
    "last": lambda v: _at(v, F.lit(-1)),
    "join": _joined,
    "replace": _replaced,
    "string": lambda v: _text(v.text()),
    "int": lambda v: Value(
        F.coalesce(v.text().try_cast("bigint"), v.text().try_cast("double").try_cast("bigint"), F.lit(0)), _LONG
    ),
    "sort": lambda v: Value(F.array_sort(v.column), v.kind),
    "reverse": lambda v: Value(F.reverse(v.column), v.kind),
    "unique": lambda v: Value(F.array_distinct(v.column), v.kind),
}
METHODS: dict[str, Callable[..., Value]] = {
    "upper": FILTERS["upper"],
    "lower": FILTERS["lower"],
    "strip": FILTERS["trim"],
    "replace": _replaced,
    "split": _split,
    "startswith": lambda v, w: Value(F.startswith(v.text(), w.text()), _FLAG),
    "endswith": lambda v, w: Value(F.endswith(v.text(), w.text()), _FLAG),
}

Scope = dict[str, Value]
Expression = Callable[[Scope], Value]


@dataclass
class _Reader:
    """Reads a template from left to right."""

    source: str
    at: int = 0
    ahead: tuple[str, str, int] | None = field(default=None)

    def fail(self, message: str, at: int | None = None) -> TemplateError:
        place = self.at if at is None else at
        line = self.source.count("\n", 0, place) + 1
        column = place - (self.source.rfind("\n", 0, place) + 1) + 1
        return TemplateError(f"line {line}, column {column}: {message}")

    # Tokens of a tag

    def peek(self) -> tuple[str, str, int]:
        if self.ahead is None:
            closing = re.compile(r"\s*(-?(?:\}\}|%\}))").match(self.source, self.at)
            found = closing or _TOKEN.match(self.source, self.at)
            if not found:
                raise self.fail("this mark is not known here" if self.source[self.at :].strip() else "the tag is not closed")
            kind = "end" if closing else found.lastgroup
            text = found[1] if closing else found[found.lastgroup]
            self.ahead = (kind, text, found.start(1 if closing else found.lastgroup))
            self.after = found.end()
        return self.ahead

    def take(self) -> tuple[str, str, int]:
        token = self.peek()
        self.at, self.ahead = self.after, None
        return token

    def sees(self, *texts: str) -> bool:
        kind, text, _ = self.peek()
        return kind in ("mark", "name") and text in texts

    def accept(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.take()
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise self.fail(f"{text!r} is missing", self.peek()[2])

    def name(self) -> str:
        kind, text, at = self.take()
        if kind != "name":
            raise self.fail("a name is missing", at)
        return text

    def close(self, mark: str) -> None:
        kind, text, at = self.take()
        if kind != "end" or not text.endswith(mark):
            raise self.fail(f"{mark!r} is missing", at)
        if text.startswith("-"):
            self.at += len(self.source[self.at :]) - len(self.source[self.at :].lstrip())

    # Text and tags

    def body(self, *stops: str) -> tuple[list[Callable[[Scope], Column]], str]:
        """Parts up to one of the tags ``stops`` (or the end, where none is given), and that tag."""
        parts: list[Callable[[Scope], Column]] = []
        while True:
            found = _TAG.search(self.source, self.at)
            plain = self.source[self.at : found.start() if found else len(self.source)]
            if found and found[0].endswith("-"):
                plain = plain.rstrip()
            if plain:
                parts.append(lambda scope, plain=plain: F.lit(plain))
            if not found:
                if stops:
                    raise self.fail(f"{{% {stops[-1]} %}} is missing", len(self.source))
                return parts, ""
            opened, self.at = found.start(), found.end()
            if found[0].startswith("{#"):
                end = self.source.find("#}", self.at)
                if end < 0:
                    raise self.fail("the comment is not closed", opened)
                cut = self.source[end - 1] == "-"
                self.at = end + 2
                if cut:
                    self.at += len(self.source[self.at :]) - len(self.source[self.at :].lstrip())
            elif found[0].startswith("{{"):
                value = self.expression()
                self.close("}}")
                parts.append(lambda scope, value=value: F.coalesce(value(scope).text(), F.lit("")))
            else:
                word = self.name()
                if word in stops:
                    return parts, word
                if word == "if":
                    parts.append(self.condition())
                elif word == "for":
                    parts.append(self.loop())
                else:
                    raise self.fail(f"the tag {word!r} is not known here", opened)

    def condition(self) -> Callable[[Scope], Column]:
        cases: list[tuple[Expression, list]] = []
        other: list = []
        word = "if"
        while word in ("if", "elif"):
            test = self.expression()
            self.close("%}")
            inner, word = self.body("elif", "else", "endif")
            cases.append((test, inner))
        if word == "else":
            self.close("%}")
            other, _ = self.body("endif")
        self.close("%}")

        def build(scope: Scope) -> Column:
            out = _concat(other, scope)
            for test, inner in reversed(cases):
                out = F.when(test(scope).true(), _concat(inner, scope)).otherwise(out)
            return out

        return build

    def loop(self) -> Callable[[Scope], Column]:
        name = self.name()
        self.expect("in")
        values, at = self.expression(), self.at
        self.close("%}")
        inner, word = self.body("else", "endfor")
        other: list = []
        if word == "else":
            self.close("%}")
            other, _ = self.body("endfor")
        self.close("%}")

        def build(scope: Scope) -> Column:
            many = values(scope)
            if many.kind is None or isinstance(many.kind, T.NullType):
                return _concat(other, scope)
            if not isinstance(many.kind, T.ArrayType):
                raise self.fail(f"a loop needs a list, not {many.kind.simpleString()}", at)

            def rounds(items: Column) -> Column:
                def one(item: Column, i: Column) -> Column:
                    turn = {
                        "loop.index": Value(i + 1, _LONG),
                        "loop.index0": Value(i, _LONG),
                        "loop.first": Value(i == 0, _FLAG),
                        "loop.last": Value(i == F.size(items) - 1, _FLAG),
                        "loop.length": Value(F.size(items), _LONG),
                    }
                    return _concat(inner, scope | turn | {name: Value(item, many.kind.elementType)})

                text = F.array_join(F.transform(items, one), "")
                return F.when(F.size(items) > 0, text).otherwise(_concat(other, scope))

            return once(F.coalesce(many.column, F.array().cast(many.kind)), rounds)

        return build

    # Expressions, loosest first

    def expression(self) -> Expression:
        value = self.either()
        if not self.accept("if"):
            return value
        test = self.either()
        other = self.expression() if self.accept("else") else (lambda scope: _text(F.lit("")))

        def build(scope: Scope) -> Value:
            a, b = value(scope), other(scope)
            if a.kind == b.kind and a.kind is not None:
                return Value(F.when(test(scope).true(), a.column).otherwise(b.column), a.kind)
            return _text(F.when(test(scope).true(), a.text()).otherwise(b.text()))

        return build

    def either(self) -> Expression:
        left = self.both()
        while self.accept("or"):
            left = _either(left, self.both(), lambda a, b: (a, b, a.true() | b.true()))
        return left

    def both(self) -> Expression:
        left = self.negated()
        while self.accept("and"):
            left = _either(left, self.negated(), lambda a, b: (b, a, a.true() & b.true()))
        return left

    def negated(self) -> Expression:
        if self.accept("not"):
            inner = self.negated()
            return lambda scope: Value(~inner(scope).true(), _FLAG)
        return self.compared()

    def compared(self) -> Expression:
        left = self.summed()
        while self.sees("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            _, mark, at = self.take()
            if mark == "not":
                self.expect("in")
            right = self.summed()
            left = _flag(left, right, lambda a, b, mark=mark, at=at: self.compare(a, b, mark, at))
        return left

    def compare(self, a: Value, b: Value, mark: str, at: int) -> Column:
        if mark in ("in", "not"):
            if isinstance(b.kind, T.ArrayType):
                found = F.array_contains(b.column, a.column.cast(b.kind.elementType))
            else:
                found = F.contains(b.text(), a.text())
            found = F.coalesce(found, F.lit(False))
            return ~found if mark == "not" else found
        if a.kind is None or b.kind is None:
            same = F.lit(a.kind is None and b.kind is None)
            return {"==": same, "!=": ~same}.get(mark, F.lit(False))
        x, y = (a.column, b.column) if a.is_number() == b.is_number() else (a.text(), b.text())
        if mark == "==":
            return x.eqNullSafe(y)
        if mark == "!=":
            return ~x.eqNullSafe(y)
        if a.is_number() != b.is_number():
            raise self.fail(f"{mark} needs two numbers or two texts", at)
        return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[mark], F.lit(False))

    def summed(self) -> Expression:
        left = self.multiplied()
        while self.sees("+", "-", "~"):
            _, mark, at = self.take()
            left = self.counted(left, self.multiplied(), mark, at)
        return left

    def multiplied(self) -> Expression:
        left = self.signed()
        while self.sees("*", "//", "%"):
            _, mark, at = self.take()
            left = self.counted(left, self.signed(), mark, at)
        return left

    def counted(self, left: Expression, right: Expression, mark: str, at: int) -> Expression:
        def build(scope: Scope) -> Value:
            a, b = left(scope), right(scope)
            if mark == "~" or (mark == "+" and isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType)):
                return _text(F.concat(*[F.coalesce(v.text(), F.lit("")) for v in (a, b)]))
            if not (a.is_number() and b.is_number()):
                raise self.fail(f"{mark} needs two numbers", at)
            whole = not any(isinstance(v.kind, (T.DoubleType, T.FloatType, T.DecimalType)) for v in (a, b))
            x, y = a.column, b.column
            if mark in ("//", "%"):
                y = F.nullif(y, F.lit(0))
                done = F.floor(x / y) if mark == "//" else x - F.floor(x / y) * y
            else:
                done = {"+": x + y, "-": x - y, "*": x * y}[mark]
            return Value(done.cast("bigint"), _LONG) if whole else Value(done.cast("double"), T.DoubleType())

        return build

    def signed(self) -> Expression:
        if self.accept("-"):
            inner = self.signed()
            return lambda scope: Value(-inner(scope).column, inner(scope).kind)
        return self.suffixed(self.atom())

    def arguments(self) -> list[Expression]:
        given: list[Expression] = []
        while not self.accept(")"):
            if given:
                self.expect(",")
            given.append(self.expression())
        return given

    def call(self, value: Expression, table: dict, name: str, given: list[Expression], at: int) -> Expression:
        if name not in table:
            raise self.fail(f"{name!r} is not known", at)

        def build(scope: Scope) -> Value:
            subject = value(scope)
            if subject.kind is None and table[name] is not _default:
                return subject
            try:
                return table[name](subject, *[g(scope) for g in given])
            except TypeError:
                raise self.fail(f"{name!r} takes other arguments", at) from None

        return build

    def suffixed(self, value: Expression) -> Expression:
        while True:
            if self.accept("."):
                at = self.peek()[2]
                name = self.name()
                if self.accept("("):
                    value = self.call(value, METHODS, name, self.arguments(), at)
                else:
                    value = self.attribute(value, name, at)
            elif self.accept("["):
                value = self.item(value)
                self.expect("]")
            elif self.accept("|"):
                at = self.peek()[2]
                name = self.name()
                value = self.call(value, FILTERS, name, self.arguments() if self.accept("(") else [], at)
            elif self.accept("is"):
                value = self.test(value)
            else:
                return value

    def attribute(self, value: Expression, name: str, at: int) -> Expression:
        def build(scope: Scope) -> Value:
            whole = value(scope)
            shown = f"{whole.shown[:-3]}.{name} }}}}" if whole.shown else ""
            if whole.shown == "{{ loop }}" and f"loop.{name}" in scope:
                return scope[f"loop.{name}"]
            if whole.kind is None:
                return Value(None, None, shown)
            if isinstance(whole.kind, T.MapType):
                return Value(F.try_element_at(whole.column, F.lit(name)), whole.kind.valueType)
            if not isinstance(whole.kind, T.StructType):
                raise self.fail(f"{whole.kind.simpleString()} has no field {name!r}", at)
            for f in whole.kind.fields:
                if f.name.lower() == name.lower():
                    return Value(whole.column.getField(f.name), f.dataType)
            return Value(None, None, f"{{{{ {name} }}}}")

        return build

    def item(self, value: Expression) -> Expression:
        at, place = self.peek()[2], self.expression()

        def build(scope: Scope) -> Value:
            whole, i = value(scope), place(scope)
            if whole.kind is None:
                return whole
            if isinstance(whole.kind, T.MapType):
                return Value(F.try_element_at(whole.column, i.column), whole.kind.valueType)
            if not i.is_number():
                raise self.fail("a place in a list is a number", at)
            return _at(whole, F.when(i.column >= 0, i.column + 1).otherwise(i.column).cast("int"))

        return build

    def test(self, value: Expression) -> Expression:
        wanted = not self.accept("not")
        at = self.peek()[2]
        name = self.name()
        if name not in ("defined", "none"):
            raise self.fail(f"the test {name!r} is not known", at)

        def build(scope: Scope) -> Value:
            v = value(scope)
            if name == "defined":
                return Value(F.lit((v.kind is not None) == wanted), _FLAG)
            missing = F.lit(False) if v.kind is None else v.column.isNull()
            return Value(missing if wanted else ~missing, _FLAG)

        return build

    def atom(self) -> Expression:
        kind, text, at = self.take()
        if kind == "number":
            number = float(text) if "." in text else int(text)
            return lambda scope: Value(F.lit(number), T.DoubleType() if "." in text else _LONG)
        if kind == "text":
            plain = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
            return lambda scope: _text(F.lit(plain))
        if kind == "name":
            if text.lower() in ("true", "false"):
                return lambda scope: Value(F.lit(text.lower() == "true"), _FLAG)
            if text.lower() == "none":
                return lambda scope: Value(F.lit(None), T.NullType())
            return lambda scope: scope.get(text, Value(None, None, f"{{{{ {text} }}}}"))
        if text == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        raise self.fail("an expression is missing", at)


def _flag(left: Expression, right: Expression, made: Callable[[Value, Value], Column]) -> Expression:
    return lambda scope: Value(made(left(scope), right(scope)), _FLAG)


def _either(left: Expression, right: Expression, parts: Callable) -> Expression:
    """``or`` and ``and``: one of the two values, by whether the left one is true."""

    def build(scope: Scope) -> Value:
        a = left(scope)
        if_true, if_false, truth = parts(a, right(scope))
        kinds = [if_true.kind, if_false.kind]
        if if_true.is_number() and if_false.is_number() and kinds[0] != kinds[1]:
            whole = not any(isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)) for k in kinds)
            kind = _LONG if whole else T.DoubleType()
            return Value(F.when(a.true(), if_true.column.cast(kind)).otherwise(if_false.column.cast(kind)), kind, truth=truth)
        if kinds[0] is not None and kinds[0] == kinds[1]:
            return Value(F.when(a.true(), if_true.column).otherwise(if_false.column), kinds[0], truth=truth)
        return Value(F.when(a.true(), if_true.text()).otherwise(if_false.text()), _TEXT, truth=truth)

    return build


def _concat(parts: list[Callable[[Scope], Column]], scope: Scope) -> Column:
    return F.concat(*[p(scope) for p in parts]) if parts else F.lit("")


def compile_template(source: str, data: DataFrame, row_id: str = "ID") -> Column:
    """The text of a template for each row of ``data``; names are its columns in lower case, and ``id``."""
    reader = _Reader(re.sub(r"\r?\n\Z", "", source))
    parts, _ = reader.body()
    scope = {f.name.lower(): Value(F.col(f"`{f.name}`"), f.dataType) for f in data.schema.fields}
    scope["id"] = Value(F.col(f"`{row_id}`"), data.schema[row_id].dataType)
    return _concat(parts, scope)


def render_templates(data: DataFrame, templates: dict[str, str], prompt_id: str, row_id: str = "ID") -> Column:
    """The text of each row's own template; null where ``prompt_id`` names none."""
    out = F.lit(None).cast("string")
    for name, source in templates.items():
        out = F.when(F.col(prompt_id) == name, compile_template(source, data, row_id)).otherwise(out)
    return out
