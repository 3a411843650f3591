"""Scripts as Columns: what a script computes from windows, recursions and higher timeframes becomes part of the query plan.

A script is lowered statement by statement into stages. A stage is one projection (with the window expressions that it holds), followed by the
recursions and joins whose inputs it made; a value knows the first stage that may read it. Each assignment makes a column of its own (single
assignment), a branch becomes a CASE over the branch's condition, a user function is put in at each call.

`var` becomes a window where the variable is either kept or set (the last value that was set), or counts: every statement that writes it gives
the old value times one or nothing, plus something that doesn't depend on it. Then its value is a running sum since it was last set.

`request.security` is a sub-plan: bars resampled once for each timeframe and call, the statements that the expression needs lowered over them, and
an equi-join by bucket, with the bucket before (look-ahead off) or the bar's own one (on).

What can't be lowered (arrays, other uses of `var`, state inside of a branch, history of a varying offset, texts that vary) stays in the bar-by-bar
program, an island: the statements that need it and are needed by it, no others. Columns that were lowered before are series to it, and what it
computes is a column to the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sure
from ..operators import window as w
from ..operators.recursive import Recursion, with_recursions
from ..timeframe import EASTERN, eastern, session_bucket
from .program import BINARY, CONSTANTS, DRAWING, FLAGS, INPUTS, MATH, PRICES, SILENT, Program
from .syntax import Node, ScriptRuntimeError

#: The island's stage: what reads it comes after.
ISLAND = 1000
BASE = ("symbol", "ts", "open", "high", "low", "close", "volume", "session")
PLOTS = ("plot", "plotchar", "plotshape", "plotarrow", "alertcondition")


class NotLowered(Exception):
    """This needs the bar-by-bar program."""


@dataclass
class Value:
    """column may be evaluated from stage `stage` on; name: of a column that is one by itself. A constant has its value beside it; a tuple has parts."""

    column: Column | None
    kind: str = "float"
    stage: int = 0
    constant: bool = False
    value: object = None
    parts: tuple[Value, ...] = ()
    name: str | None = None


def named(name: str, kind: str = "float", stage: int = 0) -> Value:
    return Value(F.col(name), kind, stage, name=name)


@dataclass
class Old:
    """An expression of a `var` that is being lowered: its old value (where `kept`) plus `more`; where not kept, `more` alone."""

    kept: Value
    more: Value


@dataclass
class Stage:
    columns: dict[str, Column] = field(default_factory=dict)
    recursions: list[Recursion] = field(default_factory=list)
    joins: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


def constant(value: object, kind: str | None = None) -> Value:
    kind = kind or ("na" if value is None else "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "float")
    types = {"bool": "boolean", "str": "string"}
    return Value(F.lit(value).cast(types.get(kind, "double")) if kind != "other" else None, kind, 0, True, value)


def number(v: Value) -> Column:
    if v.kind not in ("float", "bool", "na"):
        raise NotLowered(f"{v.kind} isn't a number")
    return v.column.cast("double") if v.kind == "bool" else v.column


def condition(v: Value) -> Column:
    """True or false, never NULL: missing is false."""
    if v.kind not in ("float", "bool", "na"):
        raise NotLowered(f"{v.kind} isn't a condition")
    return F.lit(False) if v.kind == "na" else sure(v.column) if v.kind == "bool" else sure(v.column != 0)


def alike(a: Value, b: Value) -> tuple[Column, Column, str]:
    """Both as one kind, the first one's unless that is missing."""
    kind = b.kind if a.kind == "na" else a.kind
    if kind not in ("float", "bool", "na"):
        raise NotLowered(f"{kind} isn't a column")
    if kind == "bool":
        return *(v.column if v.kind == "bool" else F.lit(None).cast("boolean") if v.kind == "na" else v.column != 0 for v in (a, b)), kind
    return number(a), number(b), kind


def _all_known(columns: Iterable[Column], value: Column) -> Column:
    return F.when(reduce(lambda x, y: x & y, (c.isNotNull() for c in columns)), value)


#: Functions of numbers as Columns; a missing number makes the result missing. (pow: see Lowering.mathematics.)
COLUMN_MATH = {
    "math.abs": F.abs, "math.max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0], "math.min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "math.exp": lambda x: F.exp(F.least(x, F.lit(700.0))), "math.log": lambda x: F.when(x > 0, F.ln(x)), "math.sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "math.floor": lambda x: F.floor(x).cast("double"), "math.ceil": lambda x: F.ceil(x).cast("double"), "math.round": F.rint, "math.sign": F.signum,
    "math.avg": lambda *x: reduce(lambda a, b: a + b, x) / len(x), "math.tanh": F.tanh, "math.pow": F.pow,
}
WINDOWS = {"ta.sma": w.sma, "ta.stdev": w.stdev_pop, "ta.median": w.rolling_median, "ta.highest": w.highest, "ta.lowest": w.lowest, "math.sum": w.rolling_sum}


def read_names(nodes: Iterable[Node], functions: dict[str, tuple]) -> set[str]:
    """Names that nodes read, also in the functions that they call."""
    out, seen = set(), set()

    def visit(n: Node) -> None:
        if n.kind == "name":
            out.add(n.value)
        elif n.kind in ("again",):
            out.add(n.value)
        elif n.kind == "if":
            for k in n.value[0] + n.value[1]:
                visit(k)
        elif n.kind == "call" and n.value in functions and n.value not in seen:
            seen.add(n.value)
            for k in functions[n.value][1]:
                visit(k)
        for k in (*n.kids, *n.named.values()):
            visit(k)

    for n in nodes:
        if n.kind != "function":
            visit(n)
    return out


def written_names(n: Node) -> set[str]:
    if n.kind == "if":
        return set().union(*(written_names(k) for k in n.value[0] + n.value[1]))
    return set(n.value) if n.kind == "unpack" else {n.value} if n.kind in ("let", "again", "var") else set()


def calls_of(n: Node, functions: dict[str, tuple]) -> set[str]:
    """Names of all functions that a statement calls, also within its own functions."""
    out: set[str] = set()

    def visit(k: Node) -> None:
        if k.kind == "call" and k.value not in out:
            out.add(k.value)
            for b in functions.get(k.value, ((), ()))[1]:
                visit(b)
        for x in (*k.kids, *k.named.values(), *(k.value[0] + k.value[1] if k.kind == "if" else ())):
            visit(x)

    visit(n)
    return out


class Lowering:
    """One pass over a script's statements. forced: numbers of statements that must be in the island."""

    def __init__(self, program: Program, tag: str, forced: frozenset[int] = frozenset(), nested: bool = False):
        self.p, self.tag, self.forced, self.nested = program, tag, forced, nested
        self.stages: dict[int, Stage] = {}
        self.names: dict[str, Value] = {}
        self.functions = {n.value[0]: (n.value[1], n.value[2]) for n in program.tree if n.kind == "function"}
        self.scopes: list[dict[str, Value]] = []
        self.calls: list[str] = []
        self.branch, self.made, self.memo = 0, 0, {}
        self.vars: dict[str, tuple[Value, list[int]]] = {}
        self.plots: list[Value] = []
        self.outputs: dict[int, Value] = {}
        self.island: list[int] = []
        self.island_inputs: dict[str, Value] = {}
        self.island_kinds: dict[str, str] = {}
        self.island_readers: dict[str, set[int]] = {}
        self.more: set[int] = set()
        self.at = -1

    # Stages.

    def stage(self, k: int) -> Stage:
        return self.stages.setdefault(k, Stage())

    def fresh(self) -> str:
        self.made += 1
        return f"__{self.tag}{self.made}"

    def kept(self, v: Value) -> Value:
        """v as a column of its own, but for constants and tuples."""
        return v if v.constant or v.parts or v.column is None else self.plain(v)

    def plain(self, v: Value) -> Value:
        """v as a column that windows may read."""
        if v.name:
            return v
        name = self.fresh()
        self.stage(v.stage).columns[name] = v.column
        return named(name, v.kind, v.stage + 1)

    def numeric(self, v: Value) -> Value:
        """v as a column of numbers that windows may read."""
        return self.plain(v if v.kind == "float" else Value(number(v), "float", v.stage))

    def once(self, key: tuple, make: Callable[[], Value]) -> Value:
        """What is asked for twice is made once."""
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]

    def over(self, v: Value, make: Callable[[Column], Column], key: object) -> Value:
        """A window over v, as a column of its own."""
        x = self.numeric(v)
        return self.once(("window", key, x.name), lambda: self.kept(Value(make(x.column), "float", x.stage)))

    def recursion(self, v: Value, n: int, alpha: float) -> Value:
        x = self.numeric(v)

        def make() -> Value:
            name = self.fresh()
            self.stage(x.stage).recursions.append(Recursion(name, x.name, n, alpha, "reset"))
            return named(name, "float", x.stage + 1)

        return self.once(("recursion", n, alpha, x.name), make)

    def apply(self, df: DataFrame, low: int = 0, high: int = ISLAND) -> DataFrame:
        for k in sorted(self.stages):
            if low <= k < high:
                s = self.stages[k]
                df = df.withColumns(s.columns) if s.columns else df
                df = with_recursions(df, *s.recursions) if s.recursions else df
                for join in s.joins:
                    df = join(df)
        return df

    # Statements.

    def run(self) -> Lowering:
        tree, after = self.p.tree, {}
        for i, n in enumerate(tree):
            for name in written_names(n):
                after.setdefault(name, []).append(i)
        self.writers = after
        for i, n in enumerate(tree):
            self.at = i
            if n.kind == "function":
                continue
            before, names, plots = self.copied(), dict(self.names), len(self.plots)
            try:
                if i in self.forced:
                    raise NotLowered("needed by the island")
                if any(self.in_island(x) for x in written_names(n)):
                    raise NotLowered("written by the island")
                self.statement(n)
                for k, at in enumerate(range(*self.p.spans[i])):
                    self.outputs[at] = self.plots[plots + k]
            except NotLowered as why:
                self.restored(before)
                self.names = names
                self.to_island(i, n, str(why))
            del self.plots[plots:]
            for name in read_names([n], self.functions):
                if self.in_island(name) and i not in self.island:
                    self.island_readers.setdefault(name, set()).add(i)
        return self

    def copied(self):
        return {k: Stage(dict(s.columns), list(s.recursions), list(s.joins)) for k, s in self.stages.items()}, dict(self.memo), dict(self.vars)

    def restored(self, state) -> None:
        self.stages, self.memo, self.vars = state
        self.scopes, self.calls, self.branch = [], [], 0

    def in_island(self, name: str) -> bool:
        return name in self.island_kinds

    def to_island(self, i: int, n: Node, why: str) -> None:
        if self.nested:
            for name in written_names(n):
                self.names[name] = Value(None, "missing")
            return
        if "request.security" in calls_of(n, self.functions):
            raise NotLowered(why)
        self.island.append(i)
        for name in read_names([n], self.functions):
            v = self.names.get(name)
            if any(k >= i for k in self.writers.get(name, ())):  # its history is what it will be at the end of the bar
                self.more |= {k for k in self.writers[name] if k not in self.island}
            if v is None or self.in_island(name):
                continue
            if name in self.vars or v.parts or v.kind not in ("float", "bool", "na") and not v.constant or v.stage > ISLAND:
                self.more |= {k for k in self.writers.get(name, ()) if k < i}
            else:
                self.island_inputs[name] = v if v.constant else self.kept(v)
        for name in written_names(n):
            self.more |= {k for k in self.writers[name] if k < i and k not in self.island} | self.island_readers.get(name, set())
            kind = self.p.kinds.get(name, "float")
            self.island_kinds[name] = "float" if kind == "na" else kind
            self.names[name] = named(f"__{self.tag}_{name}", self.island_kinds[name], ISLAND + 1)

    def statement(self, n: Node) -> Value | None:
        if n.kind == "do":
            return self.expr(n.kids[0])
        if n.kind in ("let", "again"):
            v = self.expr(n.kids[0])
            return self.assign(n.value, v)
        if n.kind == "unpack":
            v = self.expr(n.kids[0])
            if len(v.parts) != len(n.value):
                raise NotLowered("not a tuple")
            for name, x in zip(n.value, v.parts, strict=True):
                self.assign(name, x)
            return None
        if n.kind == "if":
            return self.branched(n)
        if n.kind == "var":
            return self.declared(n)
        raise NotLowered(n.kind)

    def scope(self) -> dict[str, Value]:
        return self.scopes[-1] if self.scopes else self.names

    def assign(self, name: str, v: Value | Old) -> Value | Old:
        if isinstance(v, Old):
            if not (self.branch or name in self.vars):
                raise NotLowered("a var in another variable")
        elif not v.parts:
            v = self.kept(v)
        if name in self.vars and not self.scopes and not self.branch:
            return self.carried(name, v)
        self.scope()[name] = v
        return v

    def branched(self, n: Node) -> None:
        c = self.expr(n.kids[0])
        if isinstance(c, Old):
            raise NotLowered("a condition on the var itself")
        c = self.kept(Value(condition(c), "bool", c.stage))
        scope, before, ends = self.scope(), dict(self.scope()), []
        for body, side in ((n.value[0], c.column), (n.value[1], ~c.column)):
            scope.clear()
            scope.update(before)
            first = len(self.plots)
            self.branch += 1
            for s in body:
                self.statement(s)
            self.branch -= 1
            for k in range(first, len(self.plots)):
                v = self.plots[k]
                self.plots[k] = Value(F.when(side, v.column), v.kind, max(v.stage, c.stage))
            ends.append(dict(scope))
        scope.clear()
        scope.update(before)
        for name in dict.fromkeys([*ends[0], *ends[1]]):
            yes, no = (e.get(name, constant(None)) for e in ends)
            if yes is no:
                continue
            v = self.chosen(c, yes, no)
            self.assign(name, v)

    def chosen(self, c: Value, yes: Value | Old, no: Value | Old) -> Value | Old:
        held = condition(c)
        if isinstance(yes, Old) or isinstance(no, Old):
            yes, no = (x if isinstance(x, Old) else Old(constant(False), x) for x in (yes, no))
            return Old(self.chosen(c, yes.kept, no.kept), self.chosen(c, yes.more, no.more))
        if yes.parts or no.parts:
            if len(yes.parts) != len(no.parts):
                raise NotLowered("a tuple or none")
            return Value(None, "tuple", parts=tuple(self.chosen(c, a, b) for a, b in zip(yes.parts, no.parts, strict=True)))
        a, b, kind = alike(yes, no)
        return Value(F.when(held, a).otherwise(b), kind, max(c.stage, yes.stage, no.stage))

    # var

    def declared(self, n: Node) -> Value | None:
        start = self.expr(n.kids[0])
        if self.scopes or self.branch or not (isinstance(start, Value) and start.constant and start.kind in ("float", "bool", "na")):
            raise NotLowered("var")
        writers = [k for k in self.writers[n.value] if k > self.at]
        if not writers:
            self.names[n.value] = start
            return None
        if len(writers) > 1 or len([k for k in self.writers[n.value] if k <= self.at]) > 1:
            raise NotLowered("a var of several statements")
        if any(n.value in read_names([s], self.functions) for s in self.p.tree[self.at + 1 : writers[0]]):
            raise NotLowered("a var that is read before it is written")
        self.vars[n.value] = start, writers
        self.names[n.value] = Old(constant(True), constant(0.0))
        return None

    def carried(self, name: str, v: Value | Old) -> Value:
        """The variable after the one statement that writes it."""
        start, _ = self.vars.pop(name)
        kind = self.p.kinds.get(name, "float")
        v = v if isinstance(v, Old) else Old(constant(False), v)
        stage = max(v.kept.stage, v.more.stage)
        kept = self.plain(Value(condition(v.kept), "bool", stage))
        every = w.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
        adds = self.adds_to(name)
        if kind == "bool":
            if adds:
                raise NotLowered("a condition that adds up")
            x = v.more.column if v.more.kind == "bool" else number(v.more) != 0
        else:
            x = number(v.more)
        more = self.plain(Value(x, kind, stage))
        at = max(kept.stage, more.stage)
        if not adds:
            last = F.last(F.when(~kept.column, F.struct(more.column.alias("x"))), ignorenulls=True).over(every)
            out = Value(F.when(last.isNotNull(), last["x"]).otherwise(start.column.cast("boolean" if kind == "bool" else "double")), kind, at)
        else:
            # A running sum within the stretch since the variable was last set; a missing addend makes it missing until it is set again.
            part = self.kept(Value(F.count_if(~kept.column).over(every), "float", at))
            own = Window.partitionBy("symbol", part.column).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
            begin = F.when(part.column == 0, number(start)).otherwise(F.lit(0.0))
            total = F.when(F.count_if(more.column.isNull()).over(own) == 0, F.coalesce(F.sum(more.column).over(own), F.lit(0.0)) + begin)
            out = Value(total, kind, part.stage)
        self.names[name] = self.kept(out)
        return self.names[name]

    def adds_to(self, name: str) -> bool:
        """Whether this statement reads the var to give it another value; else it is kept as it is, or set."""
        return name in self.value_reads(self.p.tree[self.at])

    def value_reads(self, n: Node) -> set[str]:
        """Names that are read in the statement, without those that an assignment writes."""
        if n.kind == "if":
            return read_names([n.kids[0]], self.functions).union(*(self.value_reads(k) for k in n.value[0] + n.value[1]), set())
        return read_names(n.kids, self.functions)

    # Expressions.

    def expr(self, n: Node) -> Value | Old:
        return getattr(self, "on_" + n.kind)(n)

    def sure_value(self, n: Node) -> Value:
        v = self.expr(n)
        if isinstance(v, Old):
            raise NotLowered("a var inside of an expression")
        if v.kind == "missing":
            raise NotLowered("not lowered")
        return v

    def on_literal(self, n: Node) -> Value:
        return constant(n.value)

    def on_color(self, n: Node) -> Value:
        return constant(None, "other")

    def on_tuple(self, n: Node) -> Value:
        return Value(None, "tuple", parts=tuple(self.sure_value(k) for k in n.kids))

    def on_name(self, n: Node) -> Value | Old:
        name = n.value
        for scope in (self.scopes[-1] if self.scopes else {}, self.names):
            if name in scope:
                if isinstance(scope[name], Value) and scope[name].kind == "missing":
                    raise NotLowered(name)
                return scope[name]
        if name in PRICES:
            parts = {"hlc3": ("high", "low", "close"), "hl2": ("high", "low"), "ohlc4": ("open", "high", "low", "close")}.get(name, (name,))
            total = reduce(lambda a, b: a + b, map(F.col, parts))
            return Value(total / len(parts)) if len(parts) > 1 else named(name)
        if name == "bar_index":
            return self.once((name,), lambda: self.kept(Value((w.bar_number() - 1).cast("double"))))
        if name in FLAGS:
            made = {
                "session.ismarket": sure(F.col("session") == "rth"), "barstate.isconfirmed": F.lit(True), "barstate.isfirst": w.bar_number() == 1,
                "barstate.islast": F.lead("ts").over(w.by_symbol()).isNull(),
            }[name]
            return self.once((name,), lambda: self.kept(Value(made, "bool")))
        if name == "timeframe.period" or name.startswith("syminfo."):
            return constant("")
        if name.startswith(CONSTANTS):
            return constant(name if name.startswith("barmerge.") else None, "other")
        raise NotLowered(name)

    def on_minus(self, n: Node) -> Value:
        v = self.sure_value(n.kids[0])
        return constant(None if v.value is None else -v.value, "float") if v.constant else Value(-number(v), "float", v.stage)

    def on_not(self, n: Node) -> Value:
        v = self.sure_value(n.kids[0])
        known = v.column.isNotNull() if v.kind != "na" else F.lit(False)
        return Value(F.when(known, ~condition(v)), "bool", v.stage)

    def on_binary(self, n: Node) -> Value | Old:
        a, b = (self.expr(k) for k in n.kids)
        op = n.value
        if isinstance(a, Old) or isinstance(b, Old):
            return self.shifted(op, a, b)
        stage = max(a.stage, b.stage)
        if op in ("and", "or"):
            return Value(condition(a) & condition(b) if op == "and" else condition(a) | condition(b), "bool", stage)
        if a.constant and b.constant and "other" not in (a.kind, b.kind):
            kind = "float" if op in "-*/%" else "bool" if op != "+" else "str" if "str" in (a.kind, b.kind) else "float"
            return constant(None if a.value is None or b.value is None else BINARY[op](a.value, b.value), kind)
        x, y = number(a), number(b)
        made = {
            "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y), "%": lambda: F.when(y != 0, x % y),
            "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "==": lambda: x == y, "!=": lambda: x != y,
        }[op]()
        return Value(made, "float" if op in "+-*/%" else "bool", stage)

    def shifted(self, op: str, a: Value | Old, b: Value | Old) -> Old:
        """The old value of a var with something added."""
        if op == "+" and isinstance(b, Old):
            a, b = b, a
        if op not in "+-" or not isinstance(a, Old) or isinstance(b, Old):
            raise NotLowered("a var inside of an expression")
        more = number(a.more) + number(b) if op == "+" else number(a.more) - number(b)
        return Old(a.kept, Value(more, "float", max(a.more.stage, b.stage)))

    def on_choice(self, n: Node) -> Value | Old:
        c = self.sure_value(n.kids[0])
        return self.chosen(c, self.expr(n.kids[1]), self.expr(n.kids[2]))

    def on_history(self, n: Node) -> Value:
        offset, v = self.sure_value(n.kids[1]), self.sure_value(n.kids[0])
        # Before this bar a variable has the value that its last statement gave it.
        if not offset.constant or offset.value is None or any(k >= self.at for k in self.writers.get(n.kids[0].value, ())):
            raise NotLowered("history of a varying offset, or of a variable that is still to be set")
        k = int(offset.value)
        x = self.plain(v)
        return x if not k else self.once(("lag", k, x.name), lambda: self.kept(Value(F.lag(x.column, k).over(w.by_symbol()), v.kind, x.stage)))

    # Calls.

    def args(self, n: Node, names: tuple[str, ...]) -> list[Value | None]:
        out = [self.sure_value(k) for k in n.kids[: len(names)]]
        out += [None] * (len(names) - len(out))
        for k in n.kids[len(names) :]:
            self.sure_value(k)
        for key, node in n.named.items():
            v = self.sure_value(node)
            if key in names:
                out[names.index(key)] = v
        return out

    def length(self, v: Value | None, n: Node, default: int | None = None) -> int:
        if v is None and default:
            return default
        if v is None or not v.constant:
            raise NotLowered("a length that varies")
        if v.value is None or v.value < 1:
            raise ScriptRuntimeError("a length must be at least 1", n.line)
        return int(v.value)

    def on_call(self, n: Node) -> Value | Old:
        name = n.value
        if name in self.functions:
            return self.inlined(n)
        if name == "input.source" or name in INPUTS:
            given = self.p.settled.get(id(n))
            if given is None:
                raise NotLowered("an input without a settled value")
            return constant(given[1], given[2]) if given[0] == "value" else self.expr(given[1])
        if name.startswith("ta.") or name == "math.sum":
            if self.branch:
                raise NotLowered("state inside of a branch")
            return self.stateful(n)
        if name in MATH:
            return self.mathematics(n)
        if name in PLOTS:
            return self.plotted(n)
        if name == "nz":
            x, other = self.args(n, ("source", "replacement"))
            a, b, kind = alike(x, other or constant(0.0))
            return Value(F.coalesce(a, b), kind, max(x.stage, (other or x).stage))
        if name == "na":
            (x,) = self.args(n, ("source",))
            return constant(True) if x is None else constant(x.value is None) if x.constant else Value(x.column.isNull(), "bool", x.stage)
        if name in ("indicator", "strategy") or name.startswith(DRAWING) or name in SILENT:
            for k in (*n.kids, *n.named.values()):
                self.expr(k)
            return constant(None, "other" if name not in ("indicator", "strategy") else "na")
        if name == "request.security":
            return self.security(n)
        raise NotLowered(name)

    def stateful(self, n: Node) -> Value:
        name = n.value
        if name in WINDOWS:
            x, length = self.args(n, ("source", "length"))
            k = self.length(length, n)
            return self.over(x, lambda c: WINDOWS[name](c, k), (name, k))
        if name == "ta.percentrank":
            x, length = self.args(n, ("source", "length"))
            k = self.length(length, n)
            return self.over(x, lambda c: w.percent_rank(c, k), (name, k))
        if name in ("ta.change", "ta.mom"):
            x, length = self.args(n, ("source", "length"))
            k = self.length(length, n, 1)
            return self.over(x, lambda c: w.change(c, k), ("ta.change", k))
        if name in ("ta.ema", "ta.rma"):
            x, length = self.args(n, ("source", "length"))
            k = self.length(length, n)
            return self.recursion(x, k, 2 / (k + 1) if name == "ta.ema" else 1 / k)
        if name == "ta.rsi":
            x, length = self.args(n, ("source", "length"))
            k = self.length(length, n)
            d = self.over(x, lambda c: w.change(c, 1), ("ta.change", 1))
            up, down = (self.recursion(Value(F.when(d.column.isNotNull(), F.greatest(s * d.column, F.lit(0.0))), "float", d.stage), k, 1 / k) for s in (1, -1))
            u, v = up.column, down.column
            return Value(F.when(u.isNotNull(), F.when(v == 0, 100.0).when(u == 0, 0.0).otherwise(100.0 - 100.0 / (1.0 + u / v))), "float", max(up.stage, down.stage))
        if name == "ta.atr":
            (length,) = self.args(n, ("length",))
            known = F.col("high").isNotNull() & F.col("low").isNotNull()
            tr = self.once(("range",), lambda: self.kept(Value(F.when(known, w.true_range()))))
            k = self.length(length, n)
            return self.recursion(tr, k, 1 / k)
        if name in ("ta.crossover", "ta.crossunder"):
            a, b = (self.numeric(v) for v in self.args(n, ("source1", "source2")))
            cross = w.crossover if name == "ta.crossover" else w.crossunder
            return self.kept(Value(cross(a.column, b.column), "bool", max(a.stage, b.stage)))
        if name == "ta.barssince":
            (c,) = self.args(n, ("condition",))
            held = self.plain(Value(condition(c), "bool", c.stage))
            at = self.once(("number",), lambda: self.kept(Value(w.bar_number())))
            return self.kept(Value(w.bars_since(held.column, at.column).cast("double"), "float", max(held.stage, at.stage)))
        raise NotLowered(name)

    def mathematics(self, n: Node) -> Value:
        vs = [self.sure_value(k) for k in (*n.kids, *n.named.values())]
        if all(v.constant for v in vs):
            return constant(None if any(v.value is None for v in vs) else MATH[n.value](*(v.value for v in vs)), "float")
        if n.value == "math.pow" and not (vs[1].constant and vs[1].value is not None and vs[1].value >= 0 and float(vs[1].value).is_integer()):
            raise NotLowered("a power that may have no value")
        if n.value == "math.round" and len(vs) > 1:
            raise NotLowered("rounding to digits")
        xs = [number(v) for v in vs]
        return Value(_all_known(xs, COLUMN_MATH[n.value](*xs)), "float", max(v.stage for v in vs))

    def plotted(self, n: Node) -> Value:
        first = "condition" if n.value == "alertcondition" else "series"
        v = self.args(n, (first, "title"))[0]
        if n.value == "alertcondition":
            v = Value(condition(v), "bool", v.stage)
        elif v.kind not in ("float", "bool", "na"):
            v = constant(None)
        self.plots.append(v)
        return constant(None, "other")

    def inlined(self, n: Node) -> Value | Old:
        params, body = self.functions[n.value]
        values = [self.sure_value(k) for k in n.kids]
        self.scopes.append({k: v if v.parts else self.kept(v) for k, v in zip(params, values, strict=True)})
        self.calls.append(n.value)
        branch, self.branch = self.branch, self.branch
        out: Value | Old | None = None
        for s in body:
            if s.kind == "var":
                raise NotLowered("a var of a function")
            out = self.statement(s)
            if s.kind in ("let", "again"):
                out = self.scopes[-1][s.value]
        self.branch = branch
        self.calls.pop()
        self.scopes.pop()
        if out is None:
            raise NotLowered("a function without a value")
        return out

    # Higher timeframes.

    def security(self, n: Node) -> Value:
        frame = self.sure_value(n.kids[1])
        if not frame.constant or frame.kind != "str":
            raise NotLowered("a timeframe that varies")
        text = frame.value.strip()
        if not text or self.nested:
            return self.sure_value(n.kids[2])
        if self.branch or self.scopes:
            raise NotLowered("a higher timeframe inside of a branch or a function")
        ahead = n.named.get("lookahead")
        ahead = ahead is not None and ahead.kind == "name" and ahead.value == "barmerge.lookahead_on"
        inner = Lowering(self.p, self.fresh()[2:] + "h", nested=True).run()
        inner.at = len(self.p.tree)
        value = inner.sure_value(n.kids[2])
        parts = [inner.kept(v) for v in (value.parts or (value,))]
        if any(v.kind not in ("float", "bool", "na") for v in parts):
            raise NotLowered("no column")
        names = [self.fresh() for _ in parts]
        bucket, first = self.fresh(), self.fresh()
        self.stage(0).columns[first] = F.min("ts").over(Window.partitionBy("symbol"))

        def join(df: DataFrame) -> DataFrame:
            at = bucket_start(text, F.col("ts"), F.col(first))
            bars = df.select(*BASE, at.alias(bucket))
            higher = inner.apply(resampled(bars, bucket))
            own = Window.partitionBy("symbol").orderBy("ts")
            picked = [v.column if ahead else F.lag(v.column).over(own) for v in parts]
            higher = higher.select("symbol", F.col("ts").alias(bucket), F.struct(*(c.alias(k) for c, k in zip(picked, names, strict=True))).alias(bucket + "v"))
            df = df.withColumn(bucket, at).join(higher, ["symbol", bucket], "left")
            # A bar of a bucket without a close sees what the bucket before it gave.
            return df.withColumn(bucket + "v", w.ffill(F.col(bucket + "v"))).withColumns({k: F.col(bucket + "v")[k] for k in names}).drop(bucket, bucket + "v")

        self.stage(1).joins.append(join)
        made = [named(k, v.kind, 2) for k, v in zip(names, parts, strict=True)]
        return Value(None, "tuple", parts=tuple(made)) if value.parts else made[0]


def bucket_start(timeframe: str, ts: Column, first: Column) -> Column:
    """Where a bar's bucket starts: minutes from 09:30 Eastern on the first bar's day, days, nD, weeks (from Monday) and months by Eastern date."""
    text = timeframe.strip().upper()
    day = lambda c: F.to_utc_timestamp(c.cast("timestamp"), EASTERN)
    if text.isdigit() and int(text):
        return session_bucket(ts, 60 * int(text), first)
    if text in ("W", "1W", "M", "1M"):
        return day(F.date_trunc("week" if text.endswith("W") else "month", eastern(ts)))
    if text == "D" or text.endswith("D") and text[:-1].isdigit() and int(text[:-1]):
        days = int(text[:-1] or 1)
        zero, own = F.to_date(eastern(first)), F.to_date(eastern(ts))
        return day(F.date_add(zero, (F.floor(F.date_diff(own, zero) / days) * days).cast("int")))
    raise NotLowered(f"timeframe {timeframe}")


def resampled(bars: DataFrame, bucket: str) -> DataFrame:
    """One bar for each bucket that has a close, of the values that aren't missing."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ts"))
    out = bars.groupBy("symbol", F.col(bucket)).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.when(F.bool_or(F.col("session") == "rth"), F.lit("rth")).otherwise(F.min_by("session", "ts")).alias("session"),
    )
    return out.filter("close is not null").withColumnRenamed(bucket, "ts")


def lowered(program: Program, tag: str = "s") -> Lowering | None:
    """The script's stages; None if all of it is the bar-by-bar program's."""
    forced: frozenset[int] = frozenset()
    while True:
        try:
            made = Lowering(program, tag, forced).run()
        except NotLowered:
            return None
        if made.more <= set(made.island):
            return made
        forced |= made.more | frozenset(made.island)
