"""Chat formatting: conversations to budgeted, turn-aligned training windows and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
BEGIN, END, OPEN, CLOSE, SYS_OPEN, SYS_CLOSE = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
ROLE_OPEN, ROLE_CLOSE = "<|role:", "|>"
CONTROL = (BEGIN, END, OPEN, CLOSE, SYS_OPEN, SYS_CLOSE, ROLE_OPEN)

# A backslash goes behind the first character of a control string, and behind that of one that
# already has backslashes there; taking one away undoes it. So no escaped text holds a control string.
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def role_tag(role: str | None) -> str:
    """[INST], <<SYS>> and plain text mark the three usual roles; others are named in a tag."""
    name = "" if role is None else "=" + re.sub(r"[^A-Za-z0-9]", lambda m: f"%{ord(m[0]):x};", role)
    return f"{ROLE_OPEN}{name}{ROLE_CLOSE}"


def mark(role: str | None, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what stands behind it."""
    body = escape(text)
    if role == "user":
        return OPEN, body, CLOSE
    if role == "assistant":
        return BEGIN, body, END
    if role == "system":
        return SYS_OPEN, body, SYS_CLOSE
    return role_tag(role) + BEGIN, body, END


_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|(?:<\|role:(?P<role>[^|]*)\|>)?<s>(?P<other>.*?)</s>",
    re.DOTALL,
)


def read_back(formatted: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, first, end) of every turn of a formatted window; the span is the text's."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not formatted text at {at}")
        at = m.end()
        kind = next(k for k in ("user", "system", "other") if m[k] is not None)
        role = kind
        if kind == "other":
            tag = m["role"]
            role = "assistant" if tag is None else re.sub(r"%([0-9a-f]+);", lambda x: chr(int(x[1], 16)), tag[1:]) if tag else None
        out.append((role, unescape(m[kind]), *m.span(kind)))
    if at != len(formatted):
        raise ValueError(f"not formatted text at {at}")
    return out


def estimate(text: str) -> int:
    """Tokens of a text for the budget where no tokenizer is given: its words, and one for every
    four characters at least."""
    return max(len(text.split()), -(-len(text) // 4))


USUAL = ("user", "assistant", "system")


def turn_tokens(text: str, role: str | None = "user", count: Callable[[str], int] = estimate) -> int:
    """Tokens of a turn: its text's, three of the template, and those of an unusual role's name."""
    return count(text) + 3 + (0 if role in USUAL else count(role_tag(role)))


def cut_to(text: str, most: int, count: Callable[[str], int]) -> str:
    """The longest beginning of text, or nearly so, that counts at most so many tokens."""
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count(text[:middle]) <= most else (low, middle - 1)
    return text[:low]


SCHEMA = (
    "conv_id long, window long, first_turn long, n_new long, formatted string, n_tokens long, over_budget boolean, "
    "loss_spans array<struct<first: long, end: long>>, repeated long, system_cut boolean"
)


class Windows:
    """Turns of one conversation, in order, to windows.

    With P the prefix sums of the turns' tokens, a window takes the new turns from i up to the
    last j with P[j] - P[i] within what the budget leaves beside the system turn and the
    repeated history: as many of the last turns before i as fit into `history` tokens. Each
    turn is new in exactly one window; loss spans are texts of new assistant turns, so targets
    that come again as history are masked. A single turn over the budget has a window of its
    own, marked, and is not cut. The system turn is whole where it is new; where it is repeated,
    `system` tokens are its bound, and a cut one is marked. So what is repeated never takes more
    than that and the history, whatever the conversation. Only the
    system turn, the history and one window are held.
    """

    def __init__(self, budget: int, history: int, system: int | None = None, count: Callable[[str], int] = estimate) -> None:
        self.budget, self.history, self.count = budget, history, count
        self.most = budget // 4 if system is None else system
        self.system_cut = False
        self.system: tuple | None = None
        self.past: list[tuple] = []
        self.new: list[tuple] = []
        self.prefix = [0]
        self.seen = 0
        self.number = 0

    def _kept(self) -> list[tuple]:
        """The turns that are repeated before the next new ones."""
        out, room = [], self.history
        for turn in reversed(self.past):
            if turn[2] > room:
                break
            out.append(turn)
            room -= turn[2]
        return out[::-1]

    def add(self, role: str | None, text: str) -> Iterator[dict]:
        turn = (role, text, turn_tokens(text, role, self.count))
        fixed = (self.system[2] if self.system else 0) + sum(t[2] for t in self.past)
        if self.new and fixed + self.prefix[-1] + turn[2] > self.budget:
            yield self.flush()
        if not self.new and self.past:
            fixed = self.system[2] if self.system else 0
            while self.past and fixed + sum(t[2] for t in self.past) + turn[2] > self.budget:
                self.past.pop(0)
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + turn[2])

    def flush(self) -> dict:
        parts, spans, at = [], [], 0
        repeated = ([self.system] if self.system else []) + self.past
        for k, (role, text, _) in enumerate(repeated + self.new):
            before, body, behind = mark(role, text)
            if k >= len(repeated) and role == "assistant":
                spans.append({"first": at + len(before), "end": at + len(before) + len(body)})
            parts += (before, body, behind)
            at += len(before) + len(body) + len(behind)
        tokens = sum(t[2] for t in repeated + self.new)
        row = {"window": self.number, "first_turn": self.seen, "n_new": len(self.new), "formatted": "".join(parts), "n_tokens": tokens, "over_budget": tokens > self.budget, "loss_spans": spans, "repeated": len(repeated), "system_cut": bool(repeated) and self.system_cut}
        self.number += 1
        if not self.seen and self.new[0][0] == "system":
            role, text, n = self.new[0]
            self.system_cut = n > self.most
            if self.system_cut:
                text = cut_to(text, self.most - 3, self.count)
                n = turn_tokens(text, role, self.count)
            self.system = (role, text, n)
            tail = self.new[1:]
        else:
            tail = self.new
        self.seen += len(self.new)
        self.past = self.past + tail
        self.past = self._kept()
        self.new, self.prefix = [], [0]
        return row


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, system: int | None = None, count: Callable[[str], int] = estimate) -> DataFrame:
    """Windows of every conversation: the formatted text, its loss spans and counts.

    budget, history and system, the bounds of a window, of its repeated turns and of its repeated
    system turn (None: a quarter of the budget), are in tokens as count gives them (a tokenizer's
    count goes there).

    conversations: conv_id, turn, role, text; other columns are not read. Turns are ordered by
    turn, then role and text, nulls first, so ties and repeated rows have one order. A null text
    is an empty turn, a null role is kept as such, rows with a null conv_id are one conversation.
    The rows of a conversation go through one task in order, as a stream: memory holds a window,
    not the conversation, so a hot one costs time in proportion to its length and no memory.
    Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_new", pa.int64()), ("formatted", pa.string()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss_spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("repeated", pa.int64()), ("system_cut", pa.bool_())]
        )
        now, state, rows = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append({"conv_id": now} | state.flush())
                    now, state = conv, Windows(budget, history, system, count)
                rows += ({"conv_id": now} | w for w in state.add(role, text or ""))
            if len(rows) >= 512:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if state is not None:
            rows.append({"conv_id": now} | state.flush())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    return turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(windows: DataFrame) -> DataFrame:
    """What can be read back from the windows of each conversation, streamed in window order.

    Repeated turns are skipped by the window's own count of them; digests run over the new
    turns. A conversation without rows has no windows and no row here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state, out = None, None, []

        def done() -> None:
            n, turns, chars, loss, formatted = state
            out.append({"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})

        for batch in batches:
            for conv, formatted, spans, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "repeated")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_back(formatted)[repeated:]
                for role, text, _, _ in turns:
                    state[1].update(f"{role or ''}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["first"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[0] += len(turns)
                state[4] += len(formatted)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = windows.select("conv_id", "window", "formatted", "loss_spans", "repeated")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGESTS)
