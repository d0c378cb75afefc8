"""Chat formatting with a grammar round trip.

A conversation is rendered as a sequence of turns, parsed back by a deterministic parser and compared with its
source. Only content that does not survive is escaped, until what is recovered is identical.

    conversation := turn*
    turn         := "<s>" role "\\n" text "</s>"          (turns under the loss mask)
                  | "[INST]" role "\\n" text "[/INST]"    (all others)

Control strings inside a role or text get a backslash before their last character; one that already has n
backslashes there gets n + 1, and the parser takes one away, so escaping is reversible for every string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"(</?s|\[/?INST)(\\*)([>\]])")
_ESCAPED = re.compile(r"(</?s|\[/?INST)(\\*)\\([>\]])")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>|\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.DOTALL)
_ROLE_ESCAPES = str.maketrans({"\\": "\\\\", "\n": "\\n"})
_ROLE_ESCAPED = re.compile(r"\\(n|\\)")

SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, n_escaped long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_line(role: str) -> str:
    return escape(role.translate(_ROLE_ESCAPES))


def _role_of(line: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(line))


def _render(role: str, text: str, masked: bool) -> str:
    return f"<s>{_role_line(role)}\n{text}</s>" if masked else f"[INST]{_role_line(role)}\n{text}[/INST]"


def parse(formatted: str) -> list[tuple[str, str, bool, int, int]] | None:
    """Turns as (role, text, under the loss mask, start and end of the escaped text); None if it is no conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            return None
        masked = m[1] is not None
        role, group = (m[1], 2) if masked else (m[3], 4)
        turns.append((_role_of(role), unescape(m[group]), masked, m.start(group), m.end(group)))
        at = m.end()
    return turns


def format_turns(turns: Sequence[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]], int]:
    """(formatted text, loss spans, number of escaped texts); each span is a whole escaped text in the formatted one."""
    out, escaped = [], 0
    for role, text in turns:
        masked, content = role == loss_role, text
        rendered = _render(role, content, masked)
        recovered = parse(rendered)
        if recovered is None or len(recovered) != 1 or recovered[0][:2] != (role, text):
            content, escaped = escape(text), escaped + 1
            rendered = _render(role, content, masked)
        out.append(rendered)
    formatted = "".join(out)
    recovered = parse(formatted)
    if recovered is None or [(r, t) for r, t, *_ in recovered] != list(turns):
        raise ValueError("the conversation does not survive its round trip")
    return formatted, [(a, b) for _, _, masked, a, b in recovered if masked], escaped


def _formatter(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"conv_id": [], "n_turns": [], "formatted": [], "loss_spans": [], "n_escaped": []}
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                formatted, spans, escaped = format_turns([(t["role"], t["text"]) for t in turns], loss_role)
                out["conv_id"].append(conv)
                out["n_turns"].append(len(turns))
                out["formatted"].append(formatted)
                out["loss_spans"].append([{"start": a, "end": b} for a, b in spans])
                out["n_escaped"].append(escaped)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "loss_spans": span, "n_escaped": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))

    return run


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code points, end exclusive), n_escaped.

    Rows are put in the order of turn (null first), then role and text, so ties and repeated rows have one result;
    every row stays a turn. Null text and null role are empty, rows without a conversation id form one conversation
    of id null, other columns are ignored, an empty table gives an empty result. Turns of `loss_role` are the ones
    under the loss mask. A conversation is one output value, so its turns meet in one row; nothing larger does.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    return whole.mapInArrow(_formatter(loss_role), SCHEMA)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        conv, formatted, spans, escaped = (batch.column(c) for c in ("conv_id", "formatted", "loss_spans", "n_escaped"))
        rows = []
        for text, under in zip(formatted.to_pylist(), spans.to_pylist()):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in under)
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t, *_ in turns)), len(loss), digest(loss), len(text)))
        cols = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(cols, types)]
        yield pa.RecordBatch.from_arrays([conv, *arrays, escaped], names=[f.split()[0] for f in READ_BACK.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from the formatted text and of the text under the loss mask."""
    return formatted.mapInArrow(_read_back, READ_BACK)
