"""Scripts over bars: a script's plots and alerts as columns of the plan; what can't be lowered in one grouped Arrow pass, a symbol at a time."""

from __future__ import annotations

from datetime import timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lower import ISLAND, lowered
from .program import Program, Run, analyse, part, remade
from .syntax import ScriptError, slug

#: Fixed value: the bars that a script needs before its last one counts.
WARMUP = 250
_TYPES = {"bool": (T.BooleanType(), pa.bool_()), "float": (T.DoubleType(), pa.float64())}


def prefix_of(program: Program, name: str = "script") -> str:
    return slug(program.shorttitle or program.title or name)


def with_script(bars: DataFrame, source: str, overrides: dict | None = None, prefix: str | None = None, error: str | None = None) -> DataFrame:
    """bars with a column {prefix}_{title} for each plot and alert; its type is known before any bar is read.

    What can be lowered is part of the plan (see lower); the rest runs bar by bar in one grouped Arrow pass. error: a column for what went wrong in
    a symbol's run; its script columns are NULL then. Without it such an error ends the job.
    Missing values are NULL. Ties of ts in a symbol: the order is that of the rows, so drop repeated bars before.
    """
    overrides = dict(overrides or {})
    program = analyse(source, overrides)
    prefix = prefix or prefix_of(program)
    names = [f"{prefix}_{c.name}" for c in program.columns]
    low = lowered(program, f"{prefix}_")
    if low is None:
        return _bar_by_bar(bars, program, names, error)
    df = low.apply(bars)
    done = {}
    if low.island:
        functions = [n for n in program.tree if n.kind == "function"]
        tree = [n for i, n in enumerate(program.tree) if i in low.island or n in functions]
        columns = {k: v for k, v in low.island_inputs.items() if not v.constant}
        known = {k: v.value for k, v in low.island_inputs.items() if v.constant}
        wanted = {k: kind for k, kind in low.island_kinds.items() if low.island_readers.get(k)}
        inner = part(tree, overrides, {k: v.kind for k, v in columns.items()}, known, wanted)
        plots = [at for i in low.island for at in range(*program.spans[i])]
        made = [names[at] for at in plots] + [f"__{prefix}__{k}" for k in wanted]
        df = _bar_by_bar(df, inner, made, error, {k: v.name for k, v in columns.items()})
        df = low.apply(df, ISLAND, 2 * ISLAND)
        done = {at: F.col(names[at]) for at in plots}
    out = done | {at: v.column.cast(_TYPES[program.columns[at].kind][0]) for at, v in low.outputs.items()}
    failed = [] if not error else [F.col(error) if low.island else F.lit(None).cast("string").alias(error)]
    if error and low.island:
        out = {at: F.when(F.col(error).isNull(), c) for at, c in out.items()}
    return df.select(*bars.columns, *(out[at].alias(names[at]) for at in range(len(names))), *failed)


class Columns(dict):
    """A table's columns as lists, by name (given: other names for some), each made when it is first read; ts is aware."""

    def __init__(self, table: pa.Table, given: dict[str, str]):
        super().__init__()
        self.table, self.given = table, given

    def __missing__(self, name: str) -> list:
        column = self.table[self.given.get(name, name)]
        plain = not column.null_count and pa.types.is_floating(column.type)
        values = column.to_numpy().tolist() if plain else column.to_pylist()
        if name == "ts":
            values = [t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc) for t in values]
        self[name] = values
        return values


def in_order(ts: pa.ChunkedArray) -> bool:
    """Whether times ascend, none of them missing."""
    t = ts.to_numpy()
    return not ts.null_count and bool((t[1:] >= t[:-1]).all())


def _bar_by_bar(bars: DataFrame, program: Program, names: list[str], error: str | None, given: dict[str, str] | None = None) -> DataFrame:
    """bars with the program's columns, by one grouped pass. given: where its series beside the bars' own are."""
    given = given or {}
    kinds = [_TYPES[c.kind] for c in program.columns]
    fields = [T.StructField(k, t[0]) for k, t in zip(names, kinds, strict=True)]
    schema = T.StructType([*bars.schema.fields, *fields, *([T.StructField(error, T.StringType())] if error else [])])
    tree, overrides, known = program.tree, program.overrides, program.remade

    held: list[Program] = []  # this task's program, made for its first symbol

    def run(table: pa.Table) -> pa.Table:
        if not in_order(table["ts"]):
            table = table.sort_by("ts")
        columns = Columns(table, given)
        if not held:
            held.append(remade(tree, overrides, known))
        message = None
        try:
            made = Run(held[0], columns, n=table.num_rows).go().columns
        except ScriptError as e:
            if not error:
                raise
            message, made = str(e), [[None] * table.num_rows for _ in names]
        for k, t, values in zip(names, kinds, made, strict=True):
            table = table.append_column(k, pa.array(values, t[1]))
        return table.append_column(error, pa.array([message] * table.num_rows, pa.string())) if error else table

    return bars.groupBy("symbol").applyInArrow(run, schema)


def script_engine(path: str | Path, overrides: dict | None = None):
    """The fields of a scan's Engine for a script file; a symbol's error is a column of its own."""
    source = Path(path).read_text()
    prefix = prefix_of(analyse(source, overrides), Path(path).stem)
    return source_engine(source, prefix, overrides)


def source_engine(source: str, prefix: str, overrides: dict | None = None) -> dict:
    error = f"__error_{prefix}"
    return {"prefix": prefix, "warmup": WARMUP, "compute": lambda bars: with_script(bars, source, overrides, prefix, error), "error": error}


def last_values(bars: DataFrame, columns: list[str]) -> DataFrame:
    """symbol and the columns of each symbol's last bar."""
    return bars.groupBy("symbol").agg(*(F.max_by(c, "ts").alias(c) for c in columns))
