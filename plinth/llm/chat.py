r"""Chat formatting with a grammar that is parsed back.

    conversation := turn*
    turn := "[INST] " text " [/INST]"      user
          | "<s> " text " </s>"            assistant
          | "[SYS] " text " [/SYS]"        system
          | "[ROLE:" role "] " text " [/ROLE]"   any other role, percent-encoded

A turn is rendered, reparsed by a deterministic parser and compared with its source.
Where they differ, its text holds control strings: these are escaped by a backslash
after their first character (one more where there are some already), and the turn is
rendered again; parsing takes one backslash away.

Conversations are streamed: rows are sorted by conversation and turn, and digests are
updated turn by turn, so a conversation is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, map_arrow, utf8

#: The marks of roles that have their own.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
_CONTROL = re.compile(r"([\[<])(\\*)(/?(?:INST\]|SYS\]|ROLE[:\]]|s>))")
_ESCAPED = re.compile(r"([\[<])\\(\\*/?(?:INST\]|SYS\]|ROLE[:\]]|s>))")
_BARE = re.compile(r"[\[<]/?(?:INST\]|SYS\]|ROLE[:\]]|s>)")
_OPEN = re.compile(r"\[INST\] |<s> |\[SYS\] |\[ROLE:([^\]]*)\] ")
_ROLES = {mark[0]: (role, mark[1]) for role, mark in MARKS.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _written(role: str, text: str) -> tuple[str, int]:
    """A turn with its text as it is, and where the text begins."""
    before, after = MARKS.get(role) or (f"[ROLE:{quote(role, safe='')}] ", " [/ROLE]")
    return before + text + after, len(before)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first, end) of each turn; first and end are the text's place. Raises ValueError off the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        mark = _OPEN.match(rendered, at)
        if not mark:
            raise ValueError(f"no turn begins at {at}")
        role, close = _ROLES.get(mark[0]) or (unquote(mark[1]), " [/ROLE]")
        bare = _BARE.search(rendered, mark.end())
        end = bare.start() - 1 if bare else -1
        if end < mark.end() or not rendered.startswith(close, end):
            raise ValueError(f"the turn at {at} has no end")
        turns.append((role, unescape(rendered[mark.end() : end]), mark.end(), end))
        at = end + len(close)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to (role, text), and the place of its text."""
    for content in (text, escape(text)):
        out, first = _written(role, content)
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out, first, first + len(content)
        except ValueError:
            pass
    raise ValueError("the turn doesn't come back from its rendering")


FORMATTED = "conv_id long, part long, segment string, first long, loss_first long, loss_end long"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("segment", pa.string()), ("first", pa.int64()), ("loss_first", pa.int64()), ("loss_end", pa.int64())])


def _format(batches):
    at, part, offset, before, told = object(), 0, 0, "", ("", "")
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != at:
                at, part, offset, before = conv, 0, 0, ""
            turn = role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
            segment, first, end = render(*turn)
            # A turn ends where the grammar says, whatever follows; so turns that parse in pairs parse as a whole.
            if before and [t[:2] for t in parse(before + segment)] != [told, turn]:
                raise ValueError(f"turns {part - 1} and {part} of a conversation don't come back from their rendering")
            before, told = segment, turn
            under = role == b"assistant"
            out.append((conv, part, segment, offset, offset + first if under else None, offset + end if under else None))
            part, offset = part + 1, offset + len(segment)
        columns = zip(*out, strict=True) if out else [[]] * len(_FORMATTED)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FORMATTED, strict=True)], schema=_FORMATTED)


def format_conversations(rows: DataFrame) -> DataFrame:
    """The rendered turns of ``rows`` (conv_id, turn, role, text): conv_id, part, segment, first, loss_first, loss_end.

    A conversation's text is its segments joined in the order of ``part``; ``first`` is
    where a segment begins in it and [loss_first, loss_end) is the part under the loss
    mask (assistant texts; else null), all in code points. Turns are ordered by turn,
    then role, then text, nulls first; repeated rows are all turns. A null text or role
    is an empty one. Rows with a null conv_id form one conversation. An empty table
    gives no rows; other columns are not read. The rows of a conversation lie side by
    side and in order in one partition.
    """
    ordered = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), utf8("role").alias("role"), utf8("text").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(ordered.select("conv_id", "role", "text"), _format, FORMATTED)


def _read_back(batches):
    def row():
        return (at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    at, n, loss_chars, chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for conv, segment, offset, first, end in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "segment", "first", "loss_first", "loss_end")), strict=True):
            if n and conv != at:
                done.append(row())
                n, loss_chars, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            at = conv
            for role, text, _, _ in parse(segment):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            chars += len(segment)
            if first is not None:
                under = unescape(segment[first - offset : end - offset])
                loss_chars += len(under)
                loss.update(under.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text of each conversation says when it is parsed.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars.
    ``formatted`` is a result of :func:`format_conversations`, not dealt out anew.
    """
    return map_arrow(formatted, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
