r"""Formatting conversations into budgeted training windows.

A conversation's turns are laid out under a template; windows are spans of
whole turns whose tokens, by the prefix sums of the turns' tokens, fit the
budget.  Every window after the first begins with the conversation's system
turn and the last few turns before its span, repeated as context as far as the
budget allows.  The loss mask covers assistant texts where they stand for the
first time, so each is a target once.

Template: ``### Role: text </turn>\n`` for each turn.  In texts (and unusual
role names) a backslash goes before ``\``, ``###`` and ``</turn>``, so no
text can pass for a marker and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Budget of a window and, of it, what repeated history may take; tokens.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
#: Tokens that the template adds to a turn.
FRAME_TOKENS = 4

_ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMED = {v: k for k, v in _ROLES.items()}
_END = " </turn>\n"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CONTROL, _ROLE_CONTROL = re.compile(r"\\|###|</turn>"), re.compile(r"\\|:|###|</turn>")
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    name = _ROLES.get(role) or "=" + _ROLE_CONTROL.sub(lambda m: "\\" + m.group(), role)
    return f"### {name}: "


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for piece in window.split(_END)[:-1]:
        head = _HEADER.match(piece)
        name = head.group(1)
        turns.append((unescape(name[1:]) if name.startswith("=") else _NAMED[name], unescape(piece[head.end() :])))
    return turns


def token_counter(tokenizer: str | None):
    """Tokens of a turn: words, or what the tokenizer in the given file
    makes, and the template's."""
    if tokenizer is None:
        return lambda text: FRAME_TOKENS + sum(1 for _ in _WORD.finditer(text))
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    return lambda text: FRAME_TOKENS + len(loaded.encode(text, add_special_tokens=False).ids)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int
    upto: int  # prefix sum of tokens, this turn's included


class Spans:
    """Cuts one conversation's turns, as they come, into windows.

    Holds the open window's turns and what of the past may be repeated, never
    the whole conversation.
    """

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system: Turn | None = None
        self.repeated: list[Turn] = []
        self.fresh: list[Turn] = []
        self.past: list[Turn] = []
        self.total = self.start = self.fixed = self.seen = 0

    def push(self, role: str, text: str, tokens: int) -> tuple[list[Turn], list[Turn]] | None:
        """Takes a turn; returns the window (repeated turns, fresh turns)
        that closes before it, if one does."""
        closed = None
        self.total += tokens
        turn = Turn(role, text, tokens, self.total)
        if self.fresh and turn.upto - self.start > self.budget - self.fixed:
            closed = (self.repeated, self.fresh)
            self._open(turn)
        self.fresh.append(turn)
        if not self.seen and role == "system":
            self.system = turn
        else:
            self.past = [*self.past, turn][-self.history_turns :] if self.history_turns else []
        self.seen += 1
        return closed

    def _open(self, first: Turn) -> None:
        """A new window that begins with the turn first: the system turn comes
        before it, and as much of the past as both limits leave room for."""
        held = [self.system] if self.system else []
        room = min(self.history_tokens, self.budget - first.tokens - sum(t.tokens for t in held))
        near = []
        for turn in reversed(self.past):
            if turn.tokens > room:
                break
            room -= turn.tokens
            near.insert(0, turn)
        self.repeated = [*held, *near]
        self.fresh, self.start = [], first.upto - first.tokens
        self.fixed = sum(t.tokens for t in self.repeated)

    def close(self) -> tuple[list[Turn], list[Turn]] | None:
        return (self.repeated, self.fresh) if self.fresh else None


def render(repeated: list[Turn], fresh: list[Turn]) -> tuple[str, list[dict]]:
    """A window's text, and its loss mask in code points."""
    parts, mask, at = [], [], 0
    for k, turn in enumerate([*repeated, *fresh]):
        head, body = header(turn.role), escape(turn.text)
        if turn.role == "assistant" and k >= len(repeated) and body:
            mask.append({"first": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, _END]
        at += len(head) + len(body) + len(_END)
    return "".join(parts), mask


_WINDOW = "conv_id long, window int, text string, mask array<struct<first:int,stop:int>>, n_repeated int, n_turns int, tokens long, over_budget boolean"
_MASK = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
_KINDS = [pa.int64(), pa.int32(), pa.string(), _MASK, pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
_NAMES = ["conv_id", "window", "text", "mask", "n_repeated", "n_turns", "tokens", "over_budget"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def format_windows(
    turns: DataFrame, *, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokenizer: str | None = None,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Windows of every conversation: conv_id, window (from 0), text, mask
    (code point spans under the loss), n_repeated (leading turns that repeat
    earlier ones), n_turns (all of the window's turns), tokens and over_budget.

    No window exceeds the budget unless a turn, with the system turn that
    every later window retains, does: that turn is whole in a window of its
    own, after the system turn and without history, marked over_budget.

    Defined results: null text and null role are empty; turns are ordered by
    turn (null last), then role, then text, so repeated rows stay and ties
    are settled; conv_id is an integer, and rows with a null one form one
    conversation; very long texts are never cut; an empty table gives no
    window; extra columns are ignored.  A conversation streams through one
    task in order; no more than a window of it is held.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        spans, conv, number, out, held = None, None, 0, [], 0

        def emit(window) -> None:
            nonlocal number, held
            if window:
                repeated, fresh = window
                text, mask = render(repeated, fresh)
                tokens = sum(t.tokens for t in [*repeated, *fresh])
                out.append((conv, number, text, mask, len(repeated), len(repeated) + len(fresh), tokens, tokens > budget))
                number, held = number + 1, held + len(text)

        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if spans is None or c != conv:
                    if spans is not None:
                        emit(spans.close())
                    spans, conv, number = Spans(budget, history_turns, history_tokens), c, 0
                emit(spans.push(role, text, count(text)))
                if held > 4 << 20:
                    yield _batch(out)
                    out.clear()
                    held = 0
        if spans is not None:
            emit(spans.close())
        if out:
            yield _batch(out)

    return rows.select("conv_id", "role", "text").mapInArrow(cut, _WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, per conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.  Turns are parsed
    from the text, repeated ones left out; the loss text is what the mask
    covers, unescaped.  A null conv_id is a conversation like any other; an
    empty table gives no row."""
    rows = windows.select("conv_id", "window", "text", "mask", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, begun = None, [], False

        def finish() -> None:
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            for conv, text, mask, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "mask", "n_repeated")), strict=True):
                if not begun or conv != now:
                    if begun:
                        finish()
                    now, begun, n, chars, formatted = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in mask:
                    target = unescape(text[span["first"] : span["stop"]])
                    chars += len(target)
                    loss.update(target.encode())
                formatted += len(text)
        if begun:
            finish()
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRICKY = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return read_back(format_windows(turns.unionByName(extra)))


_ESC = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
ORACLE = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i,
         {FRAME_TOKENS} + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n,
         4 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(replace({_ESC.format('role')}, ':', '\:')) END
           + 2 + length({_ESC.format('text')}) + {len(_END)} AS chars
  FROM c),
p AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
         sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS chars_upto,
         first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS sys_n,
         first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS sys_chars,
         lag(n, 1, 0) OVER (PARTITION BY conv_id ORDER BY i) AS n1, lag(n, 2, 0) OVER (PARTITION BY conv_id ORDER BY i) AS n2,
         lag(chars, 1, 0) OVER (PARTITION BY conv_id ORDER BY i) AS c1, lag(chars, 2, 0) OVER (PARTITION BY conv_id ORDER BY i) AS c2
  FROM t),
h AS (
  SELECT *, i > 1 AND NOT (i = 2 AND sys_n > 0) AND n1 <= {HISTORY_TOKENS} AND sys_n + n1 + n <= {BUDGET} AS one,
         i > 2 AND NOT (i = 3 AND sys_n > 0) AND n1 + n2 <= {HISTORY_TOKENS} AND sys_n + n1 + n2 + n <= {BUDGET} AS two FROM p),
o AS (
  SELECT conv_id, i, upto - n AS from_n, chars_upto - chars AS from_chars,
         CASE WHEN i = 1 THEN 0 ELSE sys_n + CASE WHEN two THEN n1 + n2 WHEN one THEN n1 ELSE 0 END END AS fixed,
         CASE WHEN i = 1 THEN 0 ELSE sys_chars + CASE WHEN two THEN c1 + c2 WHEN one THEN c1 ELSE 0 END END AS again
  FROM h),
w AS (
  SELECT o.conv_id, o.i, greatest(o.i, coalesce(max(p.i), o.i)) AS last, any_value(again) AS again, any_value(from_chars) AS from_chars
  FROM o LEFT JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i >= o.i AND p.upto - o.from_n <= {BUDGET} - o.fixed
  GROUP BY o.conv_id, o.i),
r AS (
  SELECT conv_id, i, last, again, from_chars FROM w WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.i, w.last, w.again, w.from_chars FROM r JOIN w ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = r.last + 1),
f AS (
  SELECT r.conv_id, sum(again + p.chars_upto - r.from_chars)::BIGINT AS formatted_chars
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = r.last GROUP BY r.conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
