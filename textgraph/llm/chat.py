r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Name: body</turn>`` and a line feed. A deterministic
parser reads it back; if role and text are not what they were, the text is
escaped and rendered again until they are. ``\`` before a character takes it as
it is; a body may hold no bare ``</turn>`` and no bare ``### ``. Roles other than
system, user and assistant are named ``@role``, escaped.

Turns are rendered row by row where they are. Digests need the turns of a
conversation in order: they are sorted by conversation and turn (spilling) and
streamed through a running hash, so memory does not grow with a conversation. A
digest of one sequence is sequential by nature: the rendered turns of one
conversation pass through one task, whatever its length.

Defined results: a null text or role is empty; a null conversation is a
conversation, a null turn comes first; turns of equal number go by role and text;
repeated rows are turns like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The template.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, CLOSE = "### ", "</turn>"
TRAINED = "assistant"
HARD = (-7, r"\### Assistant: </turn> ok")

_ROLES = {name: role for role, name in NAMES.items()}
_BODY = r"(?:[^\\<#]++|\\.|<(?!/turn>)|\#(?!\#\#\x20))*+"
_TURN = re.compile(rf"\#\#\#\x20(@(?:[^\\:]|\\.)*+|{'|'.join(_ROLES)}):\x20({_BODY})</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, also: str = "") -> str:
    text = text.replace("\\", "\\\\")
    for control in (OPEN, CLOSE, *also):
        text = text.replace(control, "\\" + control)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns of a formatted text as (role, text, body's start, body's end); None if it is malformed."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            return None
        name = found[1]
        role = unescape(name[1:]) if name[0] == "@" else _ROLES[name]
        turns.append((role, unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as far as the round trip needs."""
    name = NAMES.get(role) or "@" + escape(role, ":")
    for body in (text, escape(text)):
        formatted = f"{OPEN}{name}: {body}{CLOSE}\n"
        turns = parse(formatted)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return formatted
    raise AssertionError("an escaped turn must read back")


def _render_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, turn, role, text = (c.to_pylist() for c in batch.columns)
        formatted = [render(r or "", t or "") for r, t in zip(role, text)]
        yield pa.RecordBatch.from_pydict({"conv_id": conv, "turn": turn, "role": role, "text": text, "formatted": formatted}, _ROWS)


_ROWS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()),
])


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, formatted``; a conversation is its turns' formatted texts in order."""
    columns = [F.col(c).cast("long") for c in ("conv_id", "turn")] + [F.col("role"), F.col("text")]
    return conversations.select(*columns).mapInArrow(
        _render_rows, "conv_id long, turn long, role string, text string, formatted string")


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == TRAINED:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> dict:
        return dict(zip(_DIGESTS.names, (
            self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)))


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(formatted)
        if done:
            yield pa.RecordBatch.from_pylist(done, _DIGESTS)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], _DIGESTS)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "formatted").mapInArrow(_digest_rows, DIGEST)


def hard_case(spark: SparkSession) -> DataFrame:
    """A conversation that says the template's own control strings."""
    conv, text = HARD
    return spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
