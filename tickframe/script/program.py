"""Scripts as programs: one analysis, then one pass over a symbol's bars.

The analysis resolves names, inputs, plot titles and types once, folds constants, and reports unknown functions and names with their line
before any bar is read. It turns every expression into a closure over the run. User functions are put in at each call, so that each call
site has state of its own, as the language wants. A run holds one list for every variable, its history.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from ..timeframe import EASTERN
from . import state as S
from .syntax import Node, ScriptRuntimeError, ScriptUnsupportedError, parse, slug

#: Series of a bar, and the namespaces whose names are constants or whose calls draw only.
PRICES = ("open", "high", "low", "close", "volume", "hlc3", "hl2", "ohlc4")
FLAGS = ("session.ismarket", "barstate.isconfirmed", "barstate.islast", "barstate.isfirst")
CONSTANTS = tuple(
    "display. location. size. shape. position. format. plot. hline. line. label. extend. scale. xloc. yloc. barmerge. text. font. order. currency. dayofweek. color. chart.".split()
)
DRAWING = tuple("table. label. line. box. color.".split())
SILENT = ("fill", "hline", "bgcolor", "barcolor", "alert")
INPUTS = {"input": lambda v: v, "input.int": int, "input.float": float, "input.bool": bool, "input.string": str, "input.timeframe": str, "input.color": lambda v: v, "input.session": str}


@dataclass
class Expr:
    """f(run) -> value; kind: bool, float, str, na or other; constant: f may be called without a run."""

    f: object
    kind: str = "float"
    constant: bool = False

    @property
    def value(self):
        return self.f(None)


def fixed(value, kind: str | None = None) -> Expr:
    kind = kind or ("na" if value is None else "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "float")
    return Expr(lambda r: value, kind, True)


class Drawing:
    """A colour or drawn object: not plottable."""


OPAQUE = Drawing()


def truthy(x) -> bool:
    if isinstance(x, str):
        raise ScriptRuntimeError("a text isn't a condition")
    return bool(x) if x is not None else False


def _add(a, b):
    return f"{shown(a)}{shown(b)}" if isinstance(a, str) or isinstance(b, str) else a + b


def shown(x, form: str = "") -> str:
    if x is None:
        return "NaN"
    if form and isinstance(x, (int, float)):
        return f"{float(x):.{len(form.split('.', 1)[1]) if '.' in form else 0}f}"
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


BINARY = {
    "+": _add, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else None, "%": lambda a, b: math.fmod(a, b) if b else None,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
MATH = {
    "math.abs": abs, "math.max": max, "math.min": min, "math.exp": lambda x: math.exp(min(x, 700.0)), "math.log": lambda x: math.log(x) if x > 0 else None,
    "math.sqrt": lambda x: math.sqrt(x) if x >= 0 else None, "math.pow": lambda a, b: float(a) ** b, "math.floor": lambda x: float(math.floor(x)),
    "math.ceil": lambda x: float(math.ceil(x)), "math.round": lambda x, n=0: float(round(x, int(n))), "math.sign": lambda x: float((x > 0) - (x < 0)),
    "math.avg": lambda *x: sum(x) / len(x), "math.tanh": math.tanh,
}


def _get(a, i):
    if not 0 <= int(i) < len(a):
        raise ScriptRuntimeError(f"index {int(i)} of an array of {len(a)}")
    return a[int(i)]


def _numbers(a):
    return a if a and None not in a else None


ARRAY = {
    "array.push": (lambda a, x: a.append(x), "na"), "array.shift": (lambda a: a.pop(0) if a else None, "float"), "array.pop": (lambda a: a.pop() if a else None, "float"),
    "array.size": (lambda a: float(len(a)), "float"), "array.avg": (lambda a: S.mean(a) if _numbers(a) else None, "float"),
    "array.sum": (lambda a: sum(a) if _numbers(a) else None, "float"), "array.get": (_get, "float"), "array.clear": (lambda a: a.clear(), "na"),
}
#: call: (argument names, what makes its state from the length, default length)
STATEFUL = {k: (("source", "length"), lambda n, f=f: S.Rolling(n, f), None) for k, f in S.ROLLING.items()} | {
    "ta.percentrank": (("source", "length"), S.PercentRank, None), "ta.ema": (("source", "length"), S.ema, None), "ta.rma": (("source", "length"), S.rma, None),
    "ta.rsi": (("source", "length"), S.Rsi, None), "ta.change": (("source", "length"), S.Change, 1), "ta.mom": (("source", "length"), S.Change, 1),
}


@dataclass
class Variable:
    at: int
    kind: str = "na"
    kept: bool = False


@dataclass
class Column:
    name: str
    kind: str


class _Series(dict):
    """A run's series by name, each made when it is first read. given: names that come with the bars beside their own."""

    def __init__(self, bars: dict[str, list], n: int, symbol: str, given: tuple[str, ...]):
        super().__init__()
        self.bars, self.n, self.symbol, self.given = bars, n, symbol, given

    def __missing__(self, name: str) -> list:
        bars, n = self.bars, self.n
        both = lambda f, *names: [None if None in x else f(*x) for x in zip(*(bars[k] for k in names), strict=True)]
        if name in self.given or name in PRICES[:5]:
            out = bars[name]
        elif name == "hlc3":
            out = both(lambda h, l, c: (h + l + c) / 3.0, "high", "low", "close")
        elif name == "hl2":
            out = both(lambda h, l: (h + l) / 2.0, "high", "low")
        elif name == "ohlc4":
            out = both(lambda o, h, l, c: (o + h + l + c) / 4.0, "open", "high", "low", "close")
        elif name == "bar_index":
            out = [float(i) for i in range(n)]
        elif name == "session.ismarket":
            out = [s == "rth" for s in bars["session"]]
        elif name in FLAGS:
            out = [name == "barstate.isconfirmed" or i == (n - 1 if name == "barstate.islast" else 0) for i in range(n)]
        elif name in ("syminfo.tickerid", "syminfo.ticker"):
            out = [self.symbol] * n
        else:
            raise KeyError(name)
        self[name] = out
        return out


class Run:
    """One pass over bars: a dict of equally long lists ts (aware datetimes or microseconds), open, ..., session."""

    def __init__(self, program: Program, bars: dict[str, list], symbol: str = "", nested: bool = False, n: int | None = None):
        """n: the number of bars, where their times needn't be read for it."""
        n = len(bars["ts"]) if n is None else n
        self.program, self.bars, self.n, self.i, self.nested = program, bars, n, 0, nested
        self.series = _Series(bars, n, symbol, program.given)
        self.history = [[None] * n for _ in range(program.variables)]
        self.begun, self.local = set(), [None] * program.locals
        self.states: list = [None] * program.states
        self.columns = [[None] * n for _ in program.columns]
        self.captured: list[list] = [[] for _ in program.captures]
        self.higher: dict[str, tuple[list, list[list]]] = {}

    def go(self) -> Run:
        kept, statements, captures = self.program.kept, self.program.statements, self.program.captures
        for i in range(self.n):
            self.i = i
            if i:
                for at in kept:
                    if at in self.begun:
                        self.history[at][i] = self.history[at][i - 1]
            for f in statements:
                f(self)
            if self.nested:
                for k, f in enumerate(captures):
                    self.captured[k].append(f(self))
        return self

    def at_higher(self, timeframe: str, site: int, ahead: bool):
        """The value of a captured expression in the last closed bucket of a higher timeframe (ahead: in the current one)."""
        if timeframe not in self.higher:
            starts, bars = resampled(self.bars, timeframe)
            self.higher[timeframe] = starts, Run(self.program, bars, nested=True).go().captured
        starts, captured = self.higher[timeframe]
        at = bisect_right(starts, self.bars["ts"][self.i]) - (1 if ahead else 2)
        return captured[site][at] if at >= 0 else None


def bucket_start(timeframe: str, first: datetime):
    """A function from a bar's time to its bucket's start. Minutes: counted from 09:30 Eastern on the first bar's day, in absolute seconds;
    D, nD, W (from Monday) and M: by Eastern date."""
    zone, text = ZoneInfo(EASTERN), timeframe.strip().upper()
    midnight = first.astimezone(zone).replace(hour=0, minute=0, second=0, microsecond=0)
    start_of = lambda day: datetime(day.year, day.month, day.day, tzinfo=zone).astimezone(timezone.utc)
    if text.isdigit() and int(text):
        anchor, step = midnight.astimezone(timezone.utc) + timedelta(hours=9, minutes=30), timedelta(minutes=int(text))
        return lambda t: anchor + (t - anchor) // step * step
    if text in ("W", "1W"):
        return lambda t: start_of((d := t.astimezone(zone).date()) - timedelta(days=d.weekday()))
    if text in ("M", "1M"):
        return lambda t: start_of(t.astimezone(zone).date().replace(day=1))
    if text == "D" or (text.endswith("D") and text[:-1].isdigit() and int(text[:-1])):
        days, day0 = int(text[:-1] or 1), midnight.date()
        return lambda t: start_of(day0 + (t.astimezone(zone).date() - day0) // timedelta(days=days) * timedelta(days=days))
    raise ScriptUnsupportedError(f"timeframe {timeframe!r} isn't supported")


def resampled(bars: dict[str, list], timeframe: str) -> tuple[list, dict[str, list]]:
    """(starts, bars) of the buckets that have a close."""
    start = bucket_start(timeframe, bars["ts"][0])
    groups: dict = {}
    for i, t in enumerate(bars["ts"]):
        groups.setdefault(start(t), []).append(i)
    out: dict[str, list] = {k: [] for k in ("ts", "open", "high", "low", "close", "volume", "session")}
    for at in sorted(groups):
        rows = groups[at]
        have = {k: [bars[k][i] for i in rows if bars[k][i] is not None] for k in PRICES[:5]}
        if not have["close"]:
            continue
        sessions = [bars["session"][i] for i in rows]
        made = {
            "ts": at, "open": next(iter(have["open"]), None), "high": max(have["high"], default=None), "low": min(have["low"], default=None), "close": have["close"][-1],
            "volume": float(sum(have["volume"])), "session": "rth" if "rth" in sessions else sessions[0],
        }
        for k, v in made.items():
            out[k].append(v)
    return out["ts"], out


@dataclass
class Program:
    overrides: dict = field(default_factory=dict)
    title: str = ""
    shorttitle: str = ""
    statements: list = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    captures: list = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    inputs: dict = field(default_factory=dict)
    variables: int = 0
    locals: int = 0
    states: int = 0
    #: The tree; for each of its statements the bounds of its columns; kinds of global names; what each input call settles to.
    tree: list[Node] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    kinds: dict = field(default_factory=dict)
    settled: dict = field(default_factory=dict)
    #: Series beside the bars' own that a run is given, by name.
    given: tuple[str, ...] = ()
    #: What a part of a script was made of; None for a whole one.
    remade: tuple | None = None


class _Analysis:
    def __init__(self, tree: list[Node], overrides: dict, given: dict[str, str] | None = None, known: dict[str, object] | None = None):
        """given: kinds of names whose series come with the bars; known: names of constants. With either, the tree is a part of a script whose
        inputs were matched before."""
        self.p = Program(dict(overrides), tree=tree, given=tuple(given or ()))
        self.given = given or {}
        self.names: dict[str, Variable] = {}
        self.constants: dict[str, Expr] = {k: fixed(v) for k, v in (known or {}).items()}
        self.functions: dict[str, tuple] = {}
        self.scopes: list[dict[str, Variable]] = []
        self.calls: list[str] = []
        self.matched: set[str] = set()
        self.untitled = 0
        self.changed = {n.value for n in self.everything(tree) if n.kind == "again"}
        counted: dict[str, int] = {}
        for n in self.everything(tree):
            if n.kind == "let":
                counted[n.value] = counted.get(n.value, 0) + 1
        self.changed |= {k for k, c in counted.items() if c > 1}
        for n in tree:
            first = len(self.p.columns)
            f = self.statement(n)
            self.p.spans.append((first, len(self.p.columns)))
            self.p.statements += [f] if f else []
        self.p.kinds = {k: v.kind for k, v in (*self.constants.items(), *self.names.items())}
        unmatched = set(self.p.overrides) - self.matched
        if unmatched and given is None:
            raise ScriptRuntimeError(f"no input is called {', '.join(sorted(unmatched))}; inputs: {', '.join(sorted(self.p.inputs))}")

    def everything(self, nodes: list[Node]):
        for n in nodes:
            yield n
            if n.kind == "if":
                yield from self.everything(n.value[0] + n.value[1])
            elif n.kind == "function":
                yield from self.everything(n.value[2])

    def state(self) -> int:
        self.p.states += 1
        return self.p.states - 1

    # Statements: closures that return the statement's value.

    def statement(self, n: Node):
        return getattr(self, "do_" + n.kind)(n)

    def body(self, nodes: list[Node]):
        fs = [f for f in (self.statement(n) for n in nodes) if f]

        def f(r):
            out = None
            for g in fs:
                out = g(r)
            return out

        return f

    def do_do(self, n: Node):
        return self.expr(n.kids[0]).f

    def do_function(self, n: Node):
        name, params, body = n.value
        self.functions[name] = (params, body)

    def do_if(self, n: Node):
        condition = self.expr(n.kids[0]).f
        yes, no = self.body(n.value[0]), self.body(n.value[1])
        return lambda r: yes(r) if truthy(condition(r)) else no(r)

    def target(self, name: str, kind: str) -> tuple[bool, Variable]:
        """(local?, variable), declared if need be."""
        scope = self.scopes[-1] if self.scopes else self.names
        if name not in scope:
            if self.scopes:
                self.p.locals += 1
                scope[name] = Variable(self.p.locals - 1)
            else:
                self.p.variables += 1
                scope[name] = Variable(self.p.variables - 1)
        v = scope[name]
        v.kind = kind if v.kind == "na" else v.kind
        return bool(self.scopes), v

    def setter(self, name: str, kind: str):
        local, v = self.target(name, kind)
        at = v.at

        def put(r, x):
            (r.local if local else r.history[at])[at if local else r.i] = x
            return x

        return put

    def do_let(self, n: Node):
        e = self.expr(n.kids[0])
        if e.constant and not self.scopes and n.value not in self.changed and e.kind != "na":
            self.constants[n.value] = e
            return None
        put = self.setter(n.value, e.kind)
        return lambda r: put(r, e.f(r))

    def do_again(self, n: Node):
        scope = self.scopes[-1] if self.scopes else self.names
        if n.value not in scope:
            raise (ScriptUnsupportedError if self.scopes else ScriptRuntimeError)(f"{n.value!r} isn't declared here and can't be set by ':='", n.line)
        e = self.expr(n.kids[0])
        put = self.setter(n.value, e.kind)
        return lambda r: put(r, e.f(r))

    def do_var(self, n: Node):
        e = self.expr(n.kids[0])
        put = self.setter(n.value, e.kind)
        scope = self.scopes[-1] if self.scopes else self.names
        v = scope[n.value]
        v.kept = True
        if not self.scopes:
            self.p.kept.append(v.at)
        key = (v.at, bool(self.scopes))

        def f(r):
            mark = key if key[1] else key[0]
            if mark not in r.begun:
                put(r, e.f(r))
                r.begun.add(mark)

        return f

    def do_unpack(self, n: Node):
        e = self.expr(n.kids[0])
        kinds = e.kind if isinstance(e.kind, tuple) else ("float",) * len(n.value)
        if len(kinds) != len(n.value):
            raise ScriptRuntimeError(f"{len(n.value)} names for {len(kinds)} values", n.line)
        puts, line = [self.setter(k, t) for k, t in zip(n.value, kinds, strict=True)], n.line

        def f(r):
            values = e.f(r)
            if not isinstance(values, tuple) or len(values) != len(puts):
                raise ScriptRuntimeError(f"{len(puts)} values are needed", line)
            for put, x in zip(puts, values, strict=True):
                put(r, x)

        return f

    # Expressions.

    def expr(self, n: Node) -> Expr:
        return getattr(self, "on_" + n.kind)(n)

    def on_literal(self, n: Node) -> Expr:
        return fixed(n.value)

    def on_color(self, n: Node) -> Expr:
        return fixed(OPAQUE, "other")

    def on_tuple(self, n: Node) -> Expr:
        es = [self.expr(k) for k in n.kids]
        fs = [e.f for e in es]
        return Expr(lambda r: tuple(f(r) for f in fs), tuple(e.kind for e in es))

    def on_name(self, n: Node) -> Expr:
        name = n.value
        if self.scopes and name in self.scopes[-1]:
            v = self.scopes[-1][name]
            return Expr(lambda r, at=v.at: r.local[at], v.kind)
        if name in self.constants:
            return self.constants[name]
        if name in self.names:
            v = self.names[name]
            return Expr(lambda r, at=v.at: r.history[at][r.i], v.kind)
        if name in self.given:
            return Expr(lambda r: r.series[name][r.i], self.given[name])
        if name in PRICES or name in FLAGS or name == "bar_index" or name in ("syminfo.tickerid", "syminfo.ticker"):
            kind = "bool" if name in FLAGS else "str" if name.startswith("syminfo") else "float"
            return Expr(lambda r: r.series[name][r.i], kind)
        if name == "timeframe.period":
            return fixed("")
        if name.startswith(CONSTANTS):
            return fixed(name if name.startswith("barmerge.") else OPAQUE, "other")
        raise ScriptRuntimeError(f"undefined name {name!r}", n.line)

    def on_minus(self, n: Node) -> Expr:
        e = self.expr(n.kids[0])
        return self.folded(lambda r: None if (x := e.f(r)) is None else -x, "float", e)

    def on_not(self, n: Node) -> Expr:
        e = self.expr(n.kids[0])
        return self.folded(lambda r: None if (x := e.f(r)) is None else not truthy(x), "bool", e)

    @staticmethod
    def folded(f, kind, *parts: Expr) -> Expr:
        return fixed(f(None), kind) if all(p.constant for p in parts) else Expr(f, kind)

    def on_binary(self, n: Node) -> Expr:
        a, b = (self.expr(k) for k in n.kids)
        fa, fb = a.f, b.f
        if n.value in ("and", "or"):
            # Both sides are evaluated: state goes on in both.
            if n.value == "and":
                return self.folded(lambda r: bool(truthy(fa(r)) & truthy(fb(r))), "bool", a, b)
            return self.folded(lambda r: bool(truthy(fa(r)) | truthy(fb(r))), "bool", a, b)
        op, line = BINARY[n.value], n.line

        def f(r):
            x, y = fa(r), fb(r)
            if x is None or y is None:
                return None
            try:
                return op(x, y)
            except TypeError:
                raise ScriptRuntimeError(f"{n.value!r} doesn't fit its values", line) from None

        kind = "float" if n.value in "-*/%" else "bool" if n.value != "+" else "str" if "str" in (a.kind, b.kind) else "float"
        return self.folded(f, kind, a, b)

    def on_choice(self, n: Node) -> Expr:
        c, a, b = (self.expr(k) for k in n.kids)

        def f(r):
            held, x, y = truthy(c.f(r)), a.f(r), b.f(r)
            return x if held else y

        return self.folded(f, b.kind if a.kind == "na" else a.kind, c, a, b)

    def on_history(self, n: Node) -> Expr:
        target, offset = n.kids[0], self.expr(n.kids[1])
        if target.kind != "name":
            raise ScriptUnsupportedError("history is of variables and built-in series only", n.line)
        if self.scopes and target.value in self.scopes[-1]:
            raise ScriptUnsupportedError(f"{target.value!r} is local to a function and has no history", n.line)
        name, line, fo = target.value, n.line, offset.f
        if offset.constant and (offset.value or 0) < 0:
            raise ScriptUnsupportedError("a negative offset would read the future", line)
        now = self.expr(target)
        v = None if now.constant else self.names.get(name)

        def f(r):
            k = fo(r)
            if k is None:
                return None
            if k < 0:
                raise ScriptRuntimeError("a negative offset would read the future", line)
            j = r.i - int(k)
            return None if j < 0 else now.value if now.constant else (r.history[v.at] if v else r.series[name])[j]

        return Expr(f, now.kind)

    # Calls.

    def arguments(self, n: Node, names: tuple[str, ...], needed: int | None = None) -> list[Expr | None]:
        """Arguments in the order of names; other ones are analysed, so that errors in them show, and dropped."""
        out = [self.expr(k) for k in n.kids[: len(names)]]
        out += [None] * (len(names) - len(out))
        for k in n.kids[len(names) :]:
            self.expr(k)
        for key, node in n.named.items():
            e = self.expr(node)
            if key in names:
                out[names.index(key)] = e
        for name, e in zip(names[: len(names) if needed is None else needed], out, strict=False):
            if e is None:
                raise ScriptRuntimeError(f"{n.value}() needs {name}", n.line)
        return out

    def on_call(self, n: Node) -> Expr:
        name = n.value
        if name in self.functions:
            return self.inlined(n)
        if name in STATEFUL:
            names, make, default = STATEFUL[name]
            x, length = self.arguments(n, names, 1 if default else None)
            return self.stateful(make, length or fixed(float(default)), n.line, x)
        if name == "ta.atr":
            (length,) = self.arguments(n, ("length",))
            return self.stateful(S.Atr, length, n.line, *(self.on_name(Node("name", n.line, k)) for k in ("high", "low", "close")))
        if name in ("ta.crossover", "ta.crossunder"):
            a, b = self.arguments(n, ("source1", "source2"))
            return self.stateful(lambda _: S.Cross(1 if name == "ta.crossover" else -1), fixed(1.0), n.line, a, b, kind="bool")
        if name == "ta.barssince":
            (c,) = self.arguments(n, ("condition",))
            return self.stateful(lambda _: S.BarsSince(), fixed(1.0), n.line, Expr(lambda r: truthy(c.f(r)), "bool"))
        if name in MATH:
            return self.mathematics(n)
        if name in ARRAY or name.startswith("array.new"):
            return self.array(n)
        if name == "input.source" or name in INPUTS:
            return self.input(n)
        if name in ("plot", "plotchar", "plotshape", "plotarrow", "alertcondition"):
            return self.plotted(n)
        if name == "nz":
            x, other = self.arguments(n, ("source", "replacement"), 1)
            other = other or fixed(0.0)

            def nz(r):
                v, o = x.f(r), other.f(r)
                return o if v is None else v

            return self.folded(nz, x.kind, x, other)
        if name == "na":
            (x,) = self.arguments(n, ("source",), 0)
            return self.folded(lambda r: x.f(r) is None, "bool", x) if x else fixed(True)
        if name == "str.tostring":
            x, form = self.arguments(n, ("value", "format"), 1)
            form = form if form and form.kind == "str" else fixed("")
            return self.folded(lambda r: shown(x.f(r), form.f(r) or ""), "str", x, form)
        if name in ("indicator", "strategy"):
            title, short = self.arguments(n, ("title", "shorttitle"), 0)
            self.p.title, self.p.shorttitle = (str(e.value or "") if e and e.constant else "" for e in (title, short))
            return fixed(None)
        if name == "request.security":
            return self.security(n)
        if name.startswith(DRAWING) or name in SILENT:
            fs = [self.expr(k).f for k in (*n.kids, *n.named.values())]

            def drawn(r):
                for f in fs:
                    f(r)
                return OPAQUE

            return Expr(drawn, "other")
        if name.split(".")[0] in ("ta", "math", "str", "array", "request", "input"):
            raise ScriptUnsupportedError(f"{name}() isn't supported", n.line)
        raise ScriptRuntimeError(f"unknown function {name!r}", n.line)

    def stateful(self, make, length: Expr, line: int, *values: Expr, kind: str = "float") -> Expr:
        at, fs, fl = self.state(), [e.f for e in values], length.f

        def f(r):
            s = r.states[at]
            if s is None:
                n = fl(r)
                if n is None or n < 1:
                    raise ScriptRuntimeError("a length must be at least 1", line)
                s = r.states[at] = make(int(n))
            return s.step(*[g(r) for g in fs])

        return Expr(f, kind)

    def mathematics(self, n: Node) -> Expr:
        es = [self.expr(k) for k in (*n.kids, *n.named.values())]
        op, fs, line = MATH[n.value], [e.f for e in es], n.line

        def f(r):
            xs = [g(r) for g in fs]
            if None in xs:
                return None
            try:
                return op(*xs)
            except (TypeError, ValueError, OverflowError, ZeroDivisionError) as e:
                raise ScriptRuntimeError(f"{n.value}: {e}", line) from None

        if not es:
            raise ScriptRuntimeError(f"{n.value}() needs values", line)
        return self.folded(f, "float", *es)

    def array(self, n: Node) -> Expr:
        if n.value.startswith("array.new"):
            size, init = self.arguments(n, ("size", "initial_value"), 0)
            size, init = size or fixed(0.0), init or fixed(None)
            return Expr(lambda r: [init.f(r)] * int(size.f(r) or 0), "other")
        (op, kind), line = ARRAY[n.value], n.line
        a, *rest = [self.expr(k).f for k in (*n.kids, *n.named.values())] or [lambda r: None]

        def f(r):
            have = a(r)
            if not isinstance(have, list):
                raise ScriptRuntimeError(f"{n.value}: the first value must be an array", line)
            return op(have, *[g(r) for g in rest])

        return Expr(f, kind)

    def input(self, n: Node) -> Expr:
        default, title = self.arguments(n, ("defval", "title"), 0)
        title = title.value if title and title.constant and title.kind == "str" else None
        given = title in self.p.overrides
        if given:
            self.matched.add(title)
        if n.value == "input.source":
            if given and self.p.overrides[title] not in PRICES:
                raise ScriptRuntimeError(f"{title} must be one of {', '.join(PRICES)}", n.line)
            if title is not None:
                self.p.inputs[title] = self.p.overrides.get(title, "close")
            name = self.p.overrides[title] if given else "close"
            own = None if given else n.kids[0] if n.kids else n.named.get("defval")
            self.p.settled[id(n)] = "node", own or Node("name", n.line, name)
            return default if default and not given else self.on_name(Node("name", n.line, name))
        if default is None or not default.constant:
            raise ScriptUnsupportedError("an input's default must be a constant", n.line)
        value = self.p.overrides[title] if given else default.value
        if not isinstance(value, Drawing) and value is not None:
            value = INPUTS[n.value](value)
            value = float(value) if isinstance(value, int) and not isinstance(value, bool) else value
        if title is not None:
            self.p.inputs[title] = value if not isinstance(value, Drawing) else "color"
        out = fixed(value, "other" if isinstance(value, Drawing) else None)
        self.p.settled[id(n)] = "value", value, out.kind
        return out

    def plotted(self, n: Node) -> Expr:
        first = {"plot": "series", "alertcondition": "condition"}.get(n.value, "series")
        value, title = self.arguments(n, (first, "title"), 1)
        if title and not title.constant:
            raise ScriptUnsupportedError(f"the title of {n.value}() must be a constant", n.line)
        text = str(title.value or "") if title else ""
        alert = n.value == "alertcondition"
        if text.strip():
            name = slug(text)
        else:
            self.untitled += 1
            name = f"{'alert' if alert else 'plot'}_{self.untitled}"
        have, k, base = {c.name for c in self.p.columns}, 2, name
        while name in have:
            name, k = f"{base}_{k}", k + 1
        kind = "bool" if alert or value.kind == "bool" else "float"
        at = len(self.p.columns)
        self.p.columns.append(Column(name, kind))
        fv = value.f

        def f(r):
            x = fv(r)
            if alert:
                x = truthy(x)
            elif kind == "bool":
                x = None if x is None else bool(x)
            else:
                x = float(x) if isinstance(x, (int, float)) else None
            r.columns[at][r.i] = x
            return OPAQUE

        return Expr(f, "other")

    def security(self, n: Node) -> Expr:
        """Same symbol, higher timeframe: the whole script runs again over the resampled bars; there the expression is taken after each bar.
        Inside such a run, and for an empty timeframe, it is the chart's own value."""
        if len(n.kids) < 3:
            raise ScriptRuntimeError("request.security(symbol, timeframe, expression)", n.line)
        frame = self.expr(n.kids[1])
        if not frame.constant or frame.kind != "str":
            raise ScriptUnsupportedError("the timeframe must be a constant text", n.line)
        text = frame.value.strip()
        here = self.expr(n.kids[2])
        if not text:
            return here
        bucket_start(text, datetime(2000, 1, 1, tzinfo=timezone.utc))
        ahead = n.named.get("lookahead")
        ahead = ahead is not None and ahead.kind == "name" and ahead.value == "barmerge.lookahead_on"
        # A second analysis gives the captured expression state of its own: it steps once a bar, whatever the statements do.
        site, missing = len(self.p.captures), (None,) * len(here.kind) if isinstance(here.kind, tuple) else None
        self.p.captures.append(None)
        self.p.captures[site] = self.expr(n.kids[2]).f

        def f(r):
            if r.nested:
                return here.f(r)
            out = r.at_higher(text, site, ahead)
            return missing if out is None else out

        return Expr(f, here.kind)

    def inlined(self, n: Node) -> Expr:
        params, body = self.functions[n.value]
        if n.named or len(n.kids) != len(params):
            raise ScriptRuntimeError(f"{n.value}() takes {len(params)} values by position", n.line)
        if n.value in self.calls:
            raise ScriptUnsupportedError(f"{n.value}() calls itself", n.line)
        values = [self.expr(k) for k in n.kids]
        self.scopes.append({})
        self.calls.append(n.value)
        puts = [self.setter(k, e.kind) for k, e in zip(params, values, strict=True)]
        kind = "na"
        fs = []
        for s in body:
            f = self.statement_kind(s)
            if f[0]:
                fs.append(f[0])
            kind = f[1]
        scope = self.scopes.pop()
        self.calls.pop()
        fresh = [v.at for v in scope.values() if not v.kept]

        def call(r):
            xs = [e.f(r) for e in values]
            for at in fresh:
                r.local[at] = None
            for put, x in zip(puts, xs, strict=True):
                put(r, x)
            out = None
            for f in fs:
                out = f(r)
            return out

        return Expr(call, kind)

    def statement_kind(self, s: Node):
        """(closure, kind of its value)."""
        if s.kind == "do":
            e = self.expr(s.kids[0])
            return e.f, e.kind
        f = self.statement(s)
        scope = self.scopes[-1]
        return f, scope[s.value].kind if s.kind in ("let", "again", "var") and s.value in scope else "float"


@lru_cache(maxsize=64)
def _analysed(source: str, overrides: tuple) -> Program:
    return _Analysis(parse(source), dict(overrides)).p


def part(tree: list[Node], overrides: dict, given: dict[str, str], known: dict[str, object], wanted: dict[str, str]) -> Program:
    """The program of some of a script's statements, with the values of the wanted names (name -> kind) at the end of each bar as columns after its own."""
    a = _Analysis(tree, overrides, given, known)
    a.p.remade = given, known, wanted
    for name, kind in wanted.items():
        e, at = a.on_name(Node("name", 0, name)), len(a.p.columns)
        a.p.columns.append(Column(name, kind))
        a.p.statements.append(_kept_column(at, e.f, kind))
    return a.p


#: This worker's programs, by the text of what they were made of: closures don't travel, and each symbol would make them anew.
_remade: dict[str, Program] = {}


def remade(tree: list[Node], overrides: dict, more: tuple | None) -> Program:
    """The program of a tree (more: of a part of a script), made once in a worker."""
    key = repr((tree, sorted(overrides.items()), more))
    if key not in _remade:
        _remade.clear()
        _remade[key] = part(tree, overrides, *more) if more else _Analysis(tree, overrides).p
    return _remade[key]


def _kept_column(at: int, value, kind: str):
    def f(r):
        x = value(r)
        r.columns[at][r.i] = None if x is None else truthy(x) if kind == "bool" else float(x)

    return f


def analyse(source: str, overrides: dict | None = None) -> Program:
    """The program of a script; ScriptError with its line if it isn't one. overrides: input title -> value."""
    return _analysed(source, tuple(sorted((overrides or {}).items())))
