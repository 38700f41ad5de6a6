"""Chat formatting in budgeted windows.

Turns of a conversation are read in order. Prefix sums of their token counts choose spans of whole
turns that fit the budget; every window repeats the system turn and a limited tail of the turns before
it, and the loss mask leaves everything repeated out, so each assistant text is a target once.

Turns are shuffled by conversation and streamed in sorted order: a worker holds one window, not one
conversation. (A conversation's digest is sequential, so all its turns pass through one task.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: fixed values of the public ChatML format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

WINDOW_SCHEMA = (
    "conv_id long, window int, repeated_turns int, new_turns int, n_tokens long, over_budget boolean, "
    "formatted string, loss_spans array<array<int>>"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
)
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""No ``<|`` is left: one backslash more between ``<`` and ``|``, whatever number is there."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: str) -> int:
    """Words and a turn's four marks; any monotone count may replace it."""
    return len(text.split()) + 4


class Windows:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.tail: list[tuple[str, str, int]] = []  # the last turns of earlier windows, within the history's budget
        self.new: list[tuple[str, str, int]] = []
        self.prefix = [0]  # prefix sums of the new turns
        self.made = 0
        self.begun = False

    def _lead(self) -> list[tuple[str, str, int]]:
        return ([self.system] if self.system else []) + self.tail

    def add(self, role: str, text: str):
        """Takes a turn; gives the window that it closes, if any."""
        turn = (role, text, count_tokens(text))
        closed = None
        lead = sum(t[2] for t in self._lead()) if self.made else 0
        if self.new and lead + self.prefix[-1] + turn[2] > self.budget:
            closed = self.close()
            lead = sum(t[2] for t in self._lead())
        if not self.new and self.made:  # history gives way to a long turn
            while self.tail and lead + turn[2] > self.budget:
                lead -= self.tail.pop(0)[2]
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + turn[2])
        if not self.begun and role == "system":
            self.system = turn
        self.begun = True
        return closed

    def close(self):
        lead = self._lead() if self.made else []
        parts, spans, at = [], [], 0
        for i, (role, text, _) in enumerate(lead + self.new):
            head, body = f"{TURN_START}{escape_role(role)}\n", escape(text)
            if i >= len(lead) and role == "assistant":
                spans.append([at + len(head), at + len(head) + len(body)])
            parts.append(f"{head}{body}{TURN_END}\n")
            at += len(parts[-1])
        tokens = sum(t[2] for t in lead) + self.prefix[-1]
        row = (self.made, len(lead), len(self.new), tokens, tokens > self.budget, "".join(parts), spans)
        past = [t for t in self.tail + self.new if t is not self.system]
        kept, room = [], self.history
        for turn in reversed(past):
            if turn[2] > room:
                break
            kept.insert(0, turn)
            room -= turn[2]
        self.tail, self.new, self.prefix, self.made = kept, [], [0], self.made + 1
        return row


def format_windows(turns: DataFrame, budget: int = 4096, history: int = 512) -> DataFrame:
    """Windows of every conversation of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Order: turn, then role and text (nulls first), so repeated turn numbers have a defined order; repeated rows
    count as turns of their own. A null text or role is empty; rows with a null conversation are one conversation.
    A turn longer than the budget is a window of its own, whole and flagged. ``history`` is at most half the budget.
    """
    history = min(history, budget // 2)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = object(), None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != key:
                    if open_ is not None:
                        out.append((key, *open_.close()))
                    key, open_ = conv, Windows(budget, history)
                closed = open_.add(role or "", text or "")
                if closed:
                    out.append((conv, *closed))
            yield from _batches(out)
        if open_ is not None:
            yield from _batches([(key, *open_.close())])

    return rows.mapInArrow(run, WINDOW_SCHEMA)


def _batches(rows: list[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.list_(pa.int32()))]
    names = ["conv_id", "window", "repeated_turns", "new_turns", "n_tokens", "over_budget", "formatted", "loss_spans"]
    for start in range(0, len(rows), size):
        columns = zip(*rows[start : start + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window."""
    turns = []
    for part in formatted.split(TURN_START)[1:]:
        role, _, body = part.partition("\n")
        turns.append((unescape_role(role), unescape(body.removesuffix(f"{TURN_END}\n"))))
    return turns


def digest_windows(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from them: turns without the repeated ones, and all text under the loss mask.

    ``windows`` as :func:`format_windows` gives them, in its order and partitioning; nothing is shuffled again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def done():
            turns, loss = state[1], state[3]
            return (key, state[0], turns.hexdigest(), state[2], loss.hexdigest(), state[4], state[5])

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "repeated_turns", "formatted", "loss_spans"))
            for conv, repeated, formatted, spans in zip(*columns, strict=True):
                if conv != key:
                    if state:
                        out.append(done())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in read_turns(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for start, end in spans:
                    text = unescape(formatted[start:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += 1
            yield from _digests(out)
        if state:
            yield from _digests([done()])

    return windows.select("conv_id", "repeated_turns", "formatted", "loss_spans").mapInArrow(run, DIGEST_SCHEMA)


def _digests(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
