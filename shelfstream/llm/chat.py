"""Chat formatting by incremental rendering of a template that is a black box."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A template: (turns, role of the turn to come or None) -> text.
Template = Callable[[list[tuple[str, str]], str | None], str]

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_TEXT, _ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)


def turn_template(turns: list[tuple[str, str]], coming: str | None = None) -> str:
    """``### role: text </turn>`` a turn. A backslash stands before each
    backslash, # and < of a text (and : of a role), so that no text can hold
    one of the control strings."""
    out = [f"{OPEN}{_ROLE.sub(r'\\\g<0>', role)}{MIDDLE}{_TEXT.sub(r'\\\g<0>', text)}{CLOSE}" for role, text in turns]
    return "".join(out) + (f"{OPEN}{_ROLE.sub(r'\\\g<0>', coming)}{MIDDLE}" if coming is not None else "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turn(span: str) -> tuple[str, str]:
    """Role and text of one turn that ``turn_template`` rendered."""
    at = re.match(r"(?:\\.|[^\\:])*", span[len(OPEN) :], re.S).end() + len(OPEN)
    return unescape(span[len(OPEN) : at]), unescape(span[at + len(MIDDLE) : len(span) - len(CLOSE)])


def spans_of(turns: list[tuple[str, str]], render: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Rendered text, (start, end, text start, text end) of each turn, and whether the template rewrites history.

    Each prefix of the turns is rendered and held against the one before: what
    it adds is the turn. The place of the turn's own text inside follows from
    the rendering that only announces the turn, and its length from the turn
    rendered empty. A prefix that the next rendering does not begin with means
    that the template rewrites history; no spans are given then.
    """
    before, spans = render([], None), []
    for k, (role, _) in enumerate(turns):
        after = render(turns[: k + 1], None)
        head = render(turns[:k], role)
        if not after.startswith(before) or not after.startswith(head):
            return render(turns, None), [], True
        size = len(after) - len(render([*turns[:k], (role, "")], None))
        spans.append((len(before), len(after), len(head), len(head) + size))
        before = after
    return before, spans, False


def format_chats(conversations: DataFrame, render: Template = turn_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted text, spans of its turns
    (start, end, text_start, text_end, in_loss), rewrites_history.

    Rows are taken in order of turn, then role and text where turns tie or
    repeat; a null turn comes first. A null text or role counts as empty. Rows
    with a null conv_id form one conversation. An empty table gives no rows;
    other columns are not read. A conversation is one unit of work, rendered
    whole as often as it has turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])
        for batch in batches:
            texts, spans, flags = [], [], []
            for turns in batch.column(1).to_pylist():
                text, found, rewrites = spans_of([(t["role"], t["text"]) for t in turns], render)
                texts.append(text)
                flags.append(rewrites)
                spans.append([(*s, t["role"] == loss_role) for s, t in zip(found, turns)])
            rows = pa.array([[dict(zip(("start", "end", "text_start", "text_end", "in_loss"), s)) for s in x] for x in spans], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), rows, pa.array(flags, pa.bool_())], ["conv_id", "formatted", "spans", "rewrites_history"])

    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    chats = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chats.select("conv_id", "turns").mapInArrow(
        run,
        "conv_id long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,in_loss:boolean>>, rewrites_history boolean",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of ``turn_template``'s output gets: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = [read_turn(text[s["start"] : s["end"]]) for s in spans]
                loss = unescape("".join(text[s["text_start"] : s["text_end"]] for s in spans if s["in_loss"]))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
