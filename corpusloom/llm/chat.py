"""Chat formatting with a grammar that reads its own output back.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Every rendered turn is parsed again by a deterministic parser and compared with
its source. Where they differ, or the text holds something that the grammar
reads as a marker, conflicting content is escaped once more until they are
identical: "<", any backslashes and "|" get one more backslash, and the parser
takes one away. A role that holds a line break or a backslash has them escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import bounded_batches

START, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LEVELS = 2


class GrammarError(ValueError):
    """The text is not a conversation of this grammar."""


def _escape(text: str, level: int) -> str:
    return _OPEN.sub(r"<\\\1|", text) if level else text


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return _escape(role, 1).replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return _unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and begin and end of the text as it stands, of every turn."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = text.find("\n", at)
        end = text.find(END, line)
        if line < 0 or end < 0 or not text.startswith("\n", end + len(END)) or "<|" in text[at + 2 : line] or "<|" in text[line:end]:
            raise GrammarError(f"the turn at {at} is not closed")
        out.append((_role_in(text[at + len(START) : line]), _unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def render(role: str, text: str) -> str:
    """One turn that parses to exactly this role and text."""
    for level in range(_LEVELS):
        out = f"{START}{_role_out(role)}\n{_escape(text, level)}{END}\n"
        try:
            turns = parse(out)
        except GrammarError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return out
    raise GrammarError("a turn does not survive its round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, learn_from, learn_to: a row for each turn.

    rendered is the turn's part of the formatted conversation, which is their
    concatenation in order; learn_from and learn_to delimit, in code points of it,
    what the loss covers, and are null but for the role ``assistant``. A null role
    or text is empty. Rows are rendered alone, so a long conversation spreads over
    tasks; repeated rows are turns each; other columns are dropped.
    """
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rendered, begin, end = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out = render(role, text)
                _, _, a, b = parse(out)[0]
                learned = role == LEARNED
                rendered.append(out)
                begin.append(a if learned else None)
                end.append(b if learned else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(rendered, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["conv_id", "turn", "role", "text", "rendered", "learn_from", "learn_to"])

    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string, learn_from long, learn_to long")


def read_back(turns: DataFrame) -> DataFrame:
    """A row for each conversation, read from the rendered text alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns
    come in the order of turn (null first), role and text. A conversation streams
    through its task turn by turn; only its running digests are held, so its length
    does not matter for memory. Null conv_ids make one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now: list | None = None

        def closed() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            done = []
            for conv, rendered, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    loss = _unescape(rendered[a:b])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(rendered)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [()] * 6, kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds, strict=True)], names=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered", "learn_from", "learn_to")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
