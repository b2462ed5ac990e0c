r"""Conversations as budgeted windows of a chat template, with a loss mask.

Each turn is written as `<|role|>`, a line feed, its text, `<|end|>` and a line feed. In roles and texts `<`, `[`, `|`
and `\` are followed by a backslash, so no control string of this or another template (`</s>`, `[INST]`, `<|end|>`)
stands in them, and taking these backslashes away gives the text back.

Running sums of the turns' tokens choose the windows: a window ends before the turn that would lift the sum since its
start over the budget, less what the window repeats. It repeats the conversation's system turn and the last turns of
the window before it, as far as they fit HISTORY of the budget. The loss mask covers the assistant turns that are new in
a window; repeated ones are not learned twice. A turn above the budget is a window of its own, marked over_budget.

Conversations of more than LONG turns are windowed in segments by turn number, of about LONG / 4 turns each, so none
needs to pass through one task; a segment begins with the system turn and without history.

Defined results: null roles and texts are empty; turns of equal number follow each other by role and text; rows without
conv_id form one conversation; an empty table gives no windows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.tables import bounded_batches, stage
from tabgate.llm.tokens import encoder

BUDGET = 1024
HISTORY = 0.25
LONG = 4096
SYSTEM, ASSISTANT = "system", "assistant"
END = "<|end|>\n"
TO_ESCAPE = re.compile(r"[<\[|\\]")
ESCAPED = re.compile(r"([<\[|\\])\\")
PART = re.compile(r"<\|((?:[^|]|\|\\)*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def part(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, what stands after it."""
    return f"<|{escape(role)}|>\n", escape(text), END


def parts_of(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window, read back."""
    return [(unescape(r), unescape(t)) for r, t in PART.findall(window)]


class Windows:
    """The windows of one segment of a conversation, from its turns in order."""

    def __init__(self, budget: int, system: tuple[str, int] | None = None) -> None:
        self.budget = budget
        self.system = [(SYSTEM, *system)] if system else []  # role, text, tokens
        self.first, self.total, self.start = True, 0, 0
        self.history: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []

    def _repeated(self) -> list[tuple[str, str, int]]:
        return self.system + self.history

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        """A window that this turn ends, if any."""
        done = None
        room = self.budget - sum(t for *_, t in self._repeated())
        if self.new and self.total + tokens - self.start > room:
            done = self.close()
        if not self.new and sum(t for *_, t in self._repeated()) + tokens > self.budget:
            self.history = []  # a long turn goes before history
        self.new.append((role, text, tokens))
        self.total += tokens
        return done

    def close(self) -> dict | None:
        if not self.new:
            return None
        repeated, text, loss = self._repeated(), [], []
        at = 0
        for i, (role, own, _) in enumerate(repeated + self.new):
            pieces = part(role, own)
            if i >= len(repeated) and role == ASSISTANT:
                loss.append((at + len(pieces[0]), at + len(pieces[0]) + len(pieces[1])))
            text.extend(pieces)
            at += sum(map(len, pieces))
        tokens = sum(t for *_, t in repeated + self.new)
        window = {
            "text": "".join(text), "n_repeated": len(repeated), "n_turns": len(repeated) + len(self.new), "n_tokens": tokens,
            "loss": [x for span in loss for x in span], "over_budget": tokens > self.budget,
        }
        turns = self.new
        if self.first and turns[0][0] == SYSTEM and not self.system:
            self.system, turns = [turns[0]], turns[1:]
        self.first = False
        room, self.history = int(self.budget * HISTORY), []
        for turn in reversed(turns):  # turns of this window from the end, while their sum fits
            room -= turn[2]
            if room < 0:
                break
            self.history.insert(0, turn)
        self.start, self.new = self.total, []
        return window


WINDOWS = (
    "conv_id long, segment long, window long, text string, n_repeated int, n_turns int, n_tokens long, loss array<int>,"
    " over_budget boolean"
)
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]


def _window_rows(batches: Iterator[pa.RecordBatch], path: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation, segment and turn -> windows; only those of one window are held."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    open_key, windows, number = None, None, 0
    out: list[tuple] = []

    def put(window: dict | None) -> None:
        nonlocal number
        if window:
            out.append((*open_key, number, *[window[c] for c in names[3:]]))
            number += 1

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names)

    for batch in batches:
        step = 512
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            turns = list(zip(*[some[c].to_pylist() for c in ("conv_id", "segment", "role", "text", "system")]))
            shown = ["".join(part(role, text)) for _, _, role, text, _ in turns]
            shown += ["".join(part(SYSTEM, system)) if system is not None else "" for *_, system in turns]
            _, offsets = encoder(path).encode(pa.array(shown, pa.string()))
            counts = [b - a - 1 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            for i, (conv, segment, role, text, system) in enumerate(turns):
                if windows is None or open_key != (conv, segment):
                    if windows is not None:
                        put(windows.close())
                    open_key, number = (conv, segment), 0
                    windows = Windows(budget, (system, counts[len(turns) + i]) if system is not None else None)
                put(windows.add(role, text, counts[i]))
            if out:
                yield rows()
                out.clear()
    if windows is not None:
        put(windows.close())
    if out:
        yield rows()


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET) -> DataFrame:
    """conv_id, segment, window (from 0), text, n_repeated (leading turns that an earlier window has), n_turns, n_tokens,
    loss (from, to, ... in code points of the text) and over_budget, for (conv_id, turn, role, text) rows."""
    bounded_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    first = F.min_by(F.struct("role", "text"), F.struct("turn", "role", "text"))
    long = stage(
        rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
        .filter(F.col("n") > LONG), "long-conversations",
    )
    if long.isEmpty():
        dealt = rows.withColumns({"segment": F.lit(0).cast("long"), "system": F.lit(None).cast("string")})
    else:
        # A system turn at the start of a long conversation; the other columns of it are numbers.
        heads = rows.join(long, rows["conv_id"].eqNullSafe(long["conv_id"])).filter("turn <=> low").groupBy(rows["conv_id"]).agg(first.alias("head"))
        heads = stage(heads.filter(F.col("head.role") == SYSTEM).select(F.col("conv_id").alias("_of"), F.col("head.text").alias("system")), "system-turns")
        sized = rows.join(long.withColumnRenamed("conv_id", "_long"), F.col("conv_id").eqNullSafe(F.col("_long")), "left")
        width = F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") * 4 / F.lit(LONG)))
        segment = F.coalesce(F.floor((F.col("turn") - F.col("low")) / width).cast("long"), F.lit(0).cast("long"))
        dealt = sized.withColumn("segment", segment).join(
            heads, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("segment") > 0), "left"
        ).select("conv_id", "turn", "role", "text", "segment", "system")
    ordered = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "role", "text", "system").mapInArrow(lambda b: _window_rows(b, tokenizer, budget), WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    key, state, out = None, None, []

    def put() -> None:
        if state:
            n, turns, chars, loss, formatted, windows = state
            out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows))

    def rows() -> pa.RecordBatch:
        kinds = [pa.string() if c.endswith("256") else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    for batch in batches:
        for conv, text, n_repeated, loss in zip(*[batch[c].to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")]):
            if state is None or conv != key:
                put()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, own in parts_of(text)[n_repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{own}\n".encode())
            for a, b in zip(loss[::2], loss[1::2]):
                own = unescape(text[a:b])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(text)
            state[5] += 1
        if out:
            yield rows()
            out.clear()
    put()
    if out:
        yield rows()


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, what they and the text under the loss mask hash to.

    A hash over all turns in order can't be put together from parts, so the windows of a conversation pass through one
    task here, one at a time.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.select("conv_id", "text", "n_repeated", "loss").mapInArrow(_digest_rows, DIGESTS)
