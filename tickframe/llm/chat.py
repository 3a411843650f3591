"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most `budget` tokens. Prefix sums of the turns' tokens choose spans of whole turns: a
window takes as many new turns as fit. Every window begins with the system turn (the first turn, if its role is `system`). Later windows
repeat up to `history` tokens of the turns before their span, whole turns again. The loss mask covers assistant texts, each only in the
window in which it is new; repeated ones are masked. A turn that alone exceeds the budget has a window for itself, uncut.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside texts and roles a backslash is doubled, and one is put into every
control string of common templates (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`), so that no text can end a turn or
begin one; `unescape` gives the text back.

Turns cross one exchange by conversation and are sorted there; one pass then holds no more than the window it is making, so that a
conversation of any length costs a task time but not memory. What a window needs of the turns before it is its history, which the budget bounds.

Defined cases: null text and null role are empty strings; turns are ordered by turn (null first), then role, then text; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
BUDGET, HISTORY = 1024, 256
#: Tokens that the template adds to a turn.
OVERHEAD = 4

SCHEMA = "conv_id long, window int, text string, n_tokens long, n_kept int, first_turn int, n_new int, loss array<struct<start:int,end:int>>"


class Window(NamedTuple):
    text: str
    n_tokens: int
    n_kept: int  # turns before the new ones: the system turn, then history
    first_turn: int  # index of the first new turn
    n_new: int
    loss: list[tuple[int, int]]  # spans of text in code points


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\\\|\\n|\\", lambda m: {"\\\\": "\\", "\\n": "\n"}.get(m[0], ""), role)


def count_tokens(text: str) -> int:
    """The budget's unit: words. Any other count of a text's tokens can be given instead."""
    return len(text.split())


class Windower:
    """The windows of one conversation whose turns come one by one; holds the turns of the window being made and of the history it may repeat."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY, count=count_tokens):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[str, str] | None = None
        self.system_tokens = 0
        self.turns: list[tuple[str, str]] = []  # a run of turns, from the first that history may still take
        self.upto = [0]  # prefix sums of their tokens
        self.base = 0  # index in the conversation of turns[0]
        self.back = self.new = 0  # the open window's first history turn and first new turn, as places in turns
        self.made = 0

    def add(self, role: str, text: str) -> Iterator[Window]:
        tokens = self.count(text) + OVERHEAD
        if self.system is None and not self.base and not self.turns and role == "system":
            self.system, self.system_tokens, self.base = (role, text), tokens, 1
            return
        self.turns.append((role, text))
        self.upto.append(self.upto[-1] + tokens)
        room, last = self.budget - self.system_tokens, len(self.turns) - 1
        if last == self.new:
            self._open(room)
        elif self.upto[last + 1] - self.upto[self.back] > room:
            yield self._close(last)
            self._open(room)

    def end(self) -> Iterator[Window]:
        if len(self.turns) > self.new or (self.system and not self.made):
            yield self._close(len(self.turns))

    def _open(self, room: int) -> None:
        """History of the window that begins with the turn at new: back while both bounds hold."""
        at = self.back = self.new
        while self.back > 0 and self.upto[at] - self.upto[self.back - 1] <= self.history and self.upto[at + 1] - self.upto[self.back - 1] <= room:
            self.back -= 1

    def _close(self, end: int) -> Window:
        """The window before the turn at end; from then on, turns that no later history reaches are forgotten."""
        kept, fresh = self.turns[self.back : self.new], self.turns[self.new : end]
        first = self.base + self.new
        if self.system:
            if self.made:
                kept = [self.system, *kept]
            else:  # the system turn itself is new in the first window
                fresh, first = [self.system, *fresh], 0
        n_tokens = self.system_tokens + self.upto[end] - self.upto[self.back]
        parts, at, loss = [], 0, []
        for i, (role, text) in enumerate((*kept, *fresh)):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if role == "assistant" and i >= len(kept):
                loss.append((at + len(head), at + len(head) + len(body)))
            parts += head, body, END, "\n"
            at += len(head) + len(body) + len(END) + 1
        cut = end
        while cut > 0 and self.upto[end] - self.upto[cut - 1] <= self.history:
            cut -= 1
        self.turns, self.upto, self.base = self.turns[cut:], [x - self.upto[cut] for x in self.upto[cut:]], self.base + cut
        self.new = end - cut
        self.made += 1
        return Window("".join(parts), n_tokens, len(kept), first, len(fresh), loss)


def windows(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, count=count_tokens) -> Iterator[Window]:
    """The windows of one conversation, given as (role, text) in order."""
    maker = Windower(budget, history, count)
    for role, text in turns:
        yield from maker.add(role, text)
    yield from maker.end()


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(text):
        line, end = text.find("\n", at), text.find(END + "\n", at)
        if not text.startswith(START, at) or line < 0 or end < line:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


_KIND = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_kept", pa.int32()), ("first_turn", pa.int32()), ("n_new", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
#: Characters of window texts that are given on at once, and rows of digests.
FLUSH_CHARS, FLUSH_ROWS = 1 << 20, 4096


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """SCHEMA, one row for each window, from rows (conv_id, turn, role, text). The windows of a conversation come in a row, in order."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars, n = [], 0, 0

        def put(conv, made: Iterator[Window]) -> None:
            nonlocal chars, n
            for w in made:
                out.append({"conv_id": conv, "window": n} | w._asdict() | {"loss": [{"start": a, "end": b} for a, b in w.loss]})
                chars += len(w.text)
                n += 1

        conv, maker = None, None
        for batch in batches:
            for at, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if maker is None or at != conv:
                    if maker is not None:
                        put(conv, maker.end())
                    conv, maker, n = at, Windower(budget, history), 0
                put(conv, maker.add(role, text))
                if chars >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _KIND)
                    out, chars = [], 0
        if maker is not None:
            put(conv, maker.end())
        if out:
            yield pa.RecordBatch.from_pylist(out, _KIND)

    return sorted_rows.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """For each conversation, from the windows' texts and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    in_order: the windows of a conversation are in one partition, in a row and in order, as format_conversations gives them; otherwise they are
    brought together and sorted first.
    """
    rows = formatted.select("conv_id", "window", "text", "n_kept", "loss")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_windows": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, state = [], None, None

        def finish() -> None:
            if state is not None:
                n, turns, lost, loss, chars, count = state
                done.append(dict(zip(kinds, (conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, count), strict=True)))

        for batch in batches:
            for i, at in enumerate(batch["conv_id"].to_pylist()):
                if state is None or at != conv:
                    finish()
                    conv, state = at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = batch["text"][i].as_py()
                for role, said in parse(text)[batch["n_kept"][i].as_py() :]:
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[0] += 1
                for span in batch["loss"][i].as_py():
                    target = unescape(text[span["start"] : span["end"]])
                    state[3].update(target.encode())
                    state[2] += len(target)
                state[4] += len(text)
                state[5] += 1
            if len(done) >= FLUSH_ROWS:
                yield pa.RecordBatch.from_pylist(done, pa.schema(list(kinds.items())))
                done = []
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema(list(kinds.items())))

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all conversations and the control conversation -7, read back from their windows."""
    own = spark.sql(f"SELECT -7L AS conv_id, i AS turn, if(i = 0, 'user', 'assistant') AS role, '{CONTROL_TEXT}' AS text FROM range(2) AS r(i)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(own)), in_order=True)
