"""Chat formatting in budgeted windows.

Turns are tokenised where they lie. With their numbers of tokens they come to a task in
order, a conversation after the other, as a stream. Prefix sums of the tokens choose the longest span of whole turns that fits a window's budget. Each
later window repeats the system turn and a limited history (the last turns
that fit HISTORY tokens), and its loss mask leaves repeated turns out, so every
assistant text is a target once. A task holds the open window's turns, not the conversation.

Template: `<|im_start|>role NEWLINE text<|im_end|> NEWLINE` a turn. Inside texts and
roles every `<|`, with any backslashes between its two characters, gets one
backslash more, which takes the control strings away and can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import col, stored, text_steps, tokenizer_path
from tallyward.llm.words import held_encoder

BUDGET, HISTORY, FRAME_TOKENS = 2048, 256, 6
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role ends its line, so its line ends are written as a backslash and n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Open:
    """What a task keeps of the conversation it reads."""

    conv: object
    window: int = 0
    system: Turn | None = None
    history: list[Turn] = field(default_factory=list)
    turns: list[Turn] = field(default_factory=list)
    held: int = 0

    def cut(self, last: bool, budget: int, history: int) -> Iterator[dict]:
        """The windows that are complete; with last, all."""
        while self.turns:
            total = np.cumsum([t.tokens for t in self.turns])
            head = [self.system] if self.window and self.system else []
            room = budget - sum(t.tokens for t in head)
            old = self.history
            n = int(np.searchsorted(total, room - sum(t.tokens for t in old), side="right"))
            if not n:  # rather a turn without history, and over budget rather than cut
                old, n = [], max(1, int(np.searchsorted(total, room, side="right")))
            if n == len(self.turns) and not last:
                return
            yield self.write(head + old, self.turns[:n])
            done, self.turns = self.turns[:n], self.turns[n:]
            self.held -= int(total[n - 1])
            self.history, left = [], history
            for t in reversed(old + [t for t in done if t is not self.system]):
                left -= t.tokens
                if left < 0:
                    break
                self.history.insert(0, t)

    def write(self, repeated: list[Turn], new: list[Turn]) -> dict:
        out, spans, at = [], [], 0
        for i, t in enumerate(repeated + new):
            head, text = f"{START}{escape_role(t.role)}\n", escape(t.text)
            if i >= len(repeated) and t.role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(text)})
            out += [head, text, END, "\n"]
            at += len(head) + len(text) + len(END) + 1
        self.window += 1
        return {"conv_id": self.conv, "window": self.window - 1, "text": "".join(out), "loss": spans, "repeated": len(repeated), "turns": len(new), "tokens": sum(t.tokens for t in repeated + new)}


_TURN_COLUMNS = ("conv_id", "turn", "role", "text")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_windows(turns: DataFrame, path: str | None = None, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss (spans in code points), repeated (turns that lead the window again), turns (new ones), tokens.

    turns has conv_id, turn, role, text. Null text and roles count as empty, null turns come first, ties are ordered by role
    and text, and repeated rows are turns of their own; null conv_ids are one conversation. A turn larger than the budget
    has a window to itself (with the system turn). The system turn is a first turn of that role. An empty table
    gives no windows. Other columns are not read.
    """
    path = path or tokenizer_path()
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, window long, text string, loss array<struct<start:long,end:long>>, repeated long, turns long, tokens long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(path)
        for part, texts in text_steps(batches):
            _, at = encoder.encode([escape(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*(col(part, c) for c in _TURN_COLUMNS), pa.array(np.diff(at) + FRAME_TOKENS)], [*_TURN_COLUMNS, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, like = None, pa.int64()

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"conv_id": like, "window": pa.int64(), "text": pa.string(), "loss": _SPANS, "repeated": pa.int64(), "turns": pa.int64(), "tokens": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            like = col(batch, "conv_id").type
            for part, texts in text_steps([batch]):
                rows: list[dict] = []
                for conv, role, text, n in zip(col(part, "conv_id").to_pylist(), col(part, "role").to_pylist(), texts, col(part, "tokens").to_pylist(), strict=True):
                    if open_ is None or open_.conv != conv:
                        if open_ is not None:
                            rows += open_.cut(True, budget, history)
                        open_ = Open(conv)
                    turn = Turn(role or "", text, n)
                    if not open_.window and not open_.turns and role == "system":
                        open_.system = turn
                    open_.turns.append(turn)
                    open_.held += n
                    if open_.held > budget:
                        rows += open_.cut(False, budget, history)
                if rows:
                    yield batch_of(rows)
        if open_ is not None:
            yield batch_of(list(open_.cut(True, budget, history)))

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in _TURN_COLUMNS)
    order = [F.col(c).asc_nulls_first() for c in _TURN_COLUMNS]
    with_tokens = turns.select(*_TURN_COLUMNS).mapInArrow(counted, f"{kinds}, tokens long")
    return with_tokens.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def read_windows(windows: DataFrame) -> DataFrame:
    """What format_windows wrote, read back from its text and loss spans, a row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, windows.

    Digests go on from window to window; a task holds one window.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, like = None, [], pa.int64()

        def out(rows: list[list]) -> pa.RecordBatch:
            kinds = [like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            values = zip(*([c, n, t.hexdigest(), m, s.hexdigest(), f, w] for c, n, t, m, s, f, w in rows), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            like = col(batch, "conv_id").type
            for conv, text, loss, repeated in zip(*(col(batch, c).to_pylist() for c in ("conv_id", "text", "loss", "repeated")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= repeated:
                        now[1] += 1
                        now[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
                now[6] += 1
                if len(done) >= 1000:
                    yield out(done)
                    done = []
        if now is not None:
            yield out([*done, now])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "window")]
    return windows.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def write_and_read(turns: DataFrame, path: str | None = None, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    return read_windows(stored(format_windows(turns, path, budget=budget, history=history), "windows"))
