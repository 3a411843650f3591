"""The filter language: text to a Column, over known columns only.

Comparisons (also chained), and / or / not, & | ~, in and not in lists, + - * / % **, parentheses, True, False, numbers, strings, abs(x).
A remainder has the sign of the divisor, and division by zero is infinite. NULL follows the data-frame convention, not SQL's: a comparison with a missing value is false, except != and `not in`, which are true; so
`not (x > 5)` keeps missing rows. Anything else is rejected by name: attributes, calls other than abs, back-ticks, @, double underscores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that isn't in the language."""


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>\*\*|==|!=|<=|>=|[-+*/%<>()\[\],&|~]))")
_BINDS = {"or": 1, "|": 1, "and": 2, "&": 2, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8}
_COMPARE = ("==", "!=", "<", "<=", ">", ">=", "in", "not in")
_WORDS = ("and", "or", "not", "in", "True", "False", "abs")


def quotient(a: Column, b: Column) -> Column:
    """As data frames divide: by zero gives an infinity of the number's sign, and nothing for zero itself."""
    infinity = F.lit(float("inf"))
    return F.when(b != 0, a / b).when(a > 0, infinity).when(a < 0, -infinity)


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        for bad in ("__", "@", "`"):
            if bad in text:
                raise FilterError(f"{bad!r} isn't allowed in a filter")
        if re.search(r"[A-Za-z_)\]]\s*\.\s*[A-Za-z_]", text):
            raise FilterError("attributes aren't allowed in a filter")
        self.columns, self.tokens, at = columns, [], 0
        while text[at:].strip():
            if not (m := _TOKEN.match(text, at)):
                raise FilterError(f"bad filter at {text[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] != "str" else "\0"

    def take(self, expected: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if expected is not None and (kind == "str" or text != expected):
            raise FilterError(f"{expected!r} is expected, not {text or 'the end'!r}")
        self.at += 1
        return kind, text

    def expression(self, least: int = 0) -> tuple[Column, bool]:
        """(column, whether it is a condition)."""
        left = self.unary()
        while True:
            op = self.peek()
            if op == "not" and self.tokens[self.at + 1] == ("name", "in"):
                op = "not in"
            if op in _COMPARE and least <= 4:
                left = self.comparison(left)
            elif _BINDS.get(op, -1) >= max(least, 1):
                self.take()
                right = self.expression(_BINDS[op] + (op != "**"))
                left = self.binary(op, left, right)
            else:
                return left

    def unary(self) -> tuple[Column, bool]:
        op = self.peek()
        if op in ("not", "~"):
            self.take()
            return ~self.condition(self.expression(3 if op == "not" else 7)), True
        if op in ("-", "+"):
            self.take()
            x = self.number(self.expression(7))
            return (-x if op == "-" else x), False
        return self.primary()

    def primary(self) -> tuple[Column, bool]:
        kind, text = self.take()
        if kind == "num":
            return F.lit(float(text)), False
        if kind == "str":
            return F.lit(text[1:-1]), False
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if text in ("True", "False"):
            return F.lit(text == "True"), True
        if text == "abs":
            self.take("(")
            inner = self.number(self.expression())
            self.take(")")
            return F.abs(inner), False
        if kind == "name" and text not in _WORDS:
            if text not in self.columns:
                raise FilterError(f"unknown column {text!r}; columns: {', '.join(self.columns)}")
            return F.col(text), False
        raise FilterError(f"bad filter at {text or 'the end'!r}")

    def condition(self, x: tuple[Column, bool]) -> Column:
        return F.coalesce(x[0], F.lit(False))

    def number(self, x: tuple[Column, bool]) -> Column:
        return x[0]

    def binary(self, op, left, right) -> tuple[Column, bool]:
        if op in ("and", "&"):
            return self.condition(left) & self.condition(right), True
        if op in ("or", "|"):
            return self.condition(left) | self.condition(right), True
        a, b = left[0], right[0]
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: quotient(a, b), "%": lambda: F.when(b != 0, a - F.floor(a / b) * b), "**": lambda: F.pow(a, b)}
        return made[op](), False

    def comparison(self, left) -> tuple[Column, bool]:
        held: Column | None = None
        while True:
            op = self.peek()
            if op == "not" and self.tokens[self.at + 1] == ("name", "in"):
                self.take()
                op = "not in"
            if op not in _COMPARE:
                return held, True
            self.take()
            if op in ("in", "not in"):
                self.take("[")
                values = [self.expression(5)[0]]
                while self.peek() == ",":
                    self.take()
                    values.append(self.expression(5)[0])
                self.take("]")
                right, c = left, F.coalesce(left[0].isin(*values), F.lit(False))
                c = ~c if op == "not in" else c
            else:
                right = self.expression(5)
                a, b = left[0], right[0]
                c = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
                c = F.coalesce(c, F.lit(op == "!="))
            held = c if held is None else held & c
            left = right


def compile_filter(text: str, columns: list[str], conditions: tuple[str, ...] = ()) -> Column:
    """conditions: the boolean ones among columns, which may stand alone."""
    p = _Parser(text, columns)
    column, is_condition = p.expression()
    if p.tokens[p.at][0] != "end":
        raise FilterError(f"bad filter at {p.tokens[p.at][1]!r}")
    if not is_condition and text.strip() not in conditions:
        raise FilterError("a filter must be a condition")
    return F.coalesce(column, F.lit(False))


def apply_filter(df: DataFrame, text: str | None, key: str = "symbol") -> DataFrame:
    """The rows for which the filter holds; all for an empty filter. The key isn't a column of the language."""
    if not (text or "").strip():
        return df
    return df.filter(compile_filter(text, [c for c in df.columns if c != key], tuple(c for c, t in df.dtypes if t == "boolean")))
