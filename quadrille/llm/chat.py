"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it, written by the template, with only that reply
under the loss mask. A conversation whose last turns follow its last reply (or that has no reply) gives one more row,
of kind 'rest', without a mask, so that the output holds every turn.

The template writes a turn as ``### role: text </turn>\\n``. Inside roles and texts, a backslash, ``###`` and
``</turn>`` (in roles also a colon) get a backslash before them, so that marks are told from text and the escape can
be undone. The rows of a conversation are sorted within a partition and streamed; memory holds the longest example,
which is one output row.

Defined cases: null text and null role are empty; rows come by turn, then role and text (null turns first); a null
conv_id is a conversation; repeated rows are repeated turns; an empty table gives none; extra columns are not read;
very long texts are read back in one pass, in memory of a few times their size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = "conv_id long, example long, kind string, text string, loss_start long, loss_end long, n_turns long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
OPEN, CLOSE = "### ", " </turn>\n"
_IN_TEXT = re.compile(r"(\\|###|</turn>)")
_IN_ROLE = re.compile(r"(\\|###|</turn>|:)")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as written, and where its text begins."""
    head = OPEN + escape(role, True) + ": "
    return head + escape(text) + CLOSE, len(head)


def _bare(text: str, mark: str, at: int) -> int:
    """Where the next mark without a backslash of its own begins; -1 if there is none. Looks at each mark once."""
    while (at := text.find(mark, at)) >= 0:
        run = at
        while run and text[run - 1] == "\\":
            run -= 1
        if (at - run) % 2 == 0:
            return at
        at += 1
    return -1


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; an error if any part of it is no turn."""
    out, at = [], 0
    while at < len(text):
        colon = _bare(text, ": ", at + len(OPEN))
        end = _bare(text, CLOSE[1:-1], colon + 2) if colon >= 0 else -1
        if not text.startswith(OPEN, at) or end < 0 or text[end - 1 : end + len(CLOSE) - 1] != CLOSE or end - 1 < colon + 2:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(text[at + len(OPEN) : colon]), unescape(text[colon + 2 : end - 1])))
        at = end + len(CLOSE) - 1
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "kind", "text", "loss_start", "loss_end", "n_turns"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    held = 0
    conv, begun, parts, length, done, turns, examples = None, False, [], 0, 0, 0, 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def rest() -> list[tuple]:
        return [(conv, examples, "rest", "".join(parts), length, length, turns)] if begun and done < turns else []

    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if not begun or c != conv:
                rows += rest()
                conv, begun, parts, length, done, turns, examples = c, True, [], 0, 0, 0, 0
            turn, at = format_turn(role or "", text or "")
            parts.append(turn)
            turns += 1
            if role == "assistant":
                whole = "".join(parts)
                parts = [whole]
                rows.append((conv, examples, "target", whole, length + at, len(whole) - len(CLOSE), turns))
                examples, done = examples + 1, turns
                held += len(whole)
            length += len(turn)
            if held > 4_000_000 or len(rows) >= 4096:
                yield flush()
                rows, held = [], 0
    rows += rest()
    if rows:
        yield flush()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row an example: conv_id, example (from 0), kind, text, loss_start, loss_end, n_turns; offsets in code points."""
    sorted_rows = (
        conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(_format, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in DIGESTS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    rows: list[tuple] = []
    conv, begun, last, loss, loss_chars, chars, count = None, False, "", None, 0, 0, 0

    def close() -> None:
        turns = parse_turns(last)
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        rows.append((conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars, count))

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    for batch in batches:
        for c, text, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss_start", "loss_end"))):
            if not begun or c != conv:
                if begun:
                    close()
                conv, begun, loss, loss_chars, chars, count = c, True, hashlib.sha256(), 0, 0, 0
            last = text
            target = unescape(text[a:b])
            loss.update(target.encode("utf-8", "surrogatepass"))
            loss_chars, chars, count = loss_chars + len(target), chars + len(text), count + 1
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
    if begun:
        close()
    if rows:
        yield flush()


def digest_examples(examples: DataFrame) -> DataFrame:
    """What format_conversations() wrote, read back by its marks alone: one row a conversation. The examples must come
    in the order in which they were written."""
    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(_read_back, DIGESTS)
