"""Chat formatting from event logs.

The log is partitioned by conversation and sorted by sequence. A fold over it gives the final
messages: streamed deltas are appended, edits rewind to the message they replace, a
regeneration throws the last answer away. Messages are rendered into one text per
conversation, with the spans that a loss is taken on.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A turn is `<|role|>text<|end|>`. Within roles and texts a backslash follows every `<`, `[`
# and `|`, and doubles a backslash: no mark, and no control string of another template that
# begins with one of them, is left whole, and taking the backslashes out restores the text.
_END = "<|end|>"
ASSISTANT = "assistant"

_CHATS = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
_DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def escaped(text: str) -> str:
    return re.sub(r"([<\[|\\])", r"\1\\", text)


def unescaped(text: str) -> str:
    return re.sub(r"([<\[|\\])\\", r"\1", text)


def fold(messages: list[tuple[str, list[str]]], kind: str | None, role: str, text: str) -> None:
    """Apply one event to the messages so far, each a role and the parts of its text.

    delta: appended to the last message if that is of the role, else a message of its own.
    edit: the last message of the role gets the text, later ones go. regenerate: the last
    message, if of the role, is replaced. Without a message to work on, and for any other or
    no kind, the event is a new message.
    """
    if kind in ("delta", "regenerate") and messages and messages[-1][0] == role:
        if kind == "regenerate":
            messages[-1][1].clear()
        messages[-1][1].append(text)
        return
    if kind == "edit":
        for at in range(len(messages) - 1, -1, -1):
            if messages[at][0] == role:
                messages[at][1][:] = [text]
                del messages[at + 1 :]
                return
    messages.append((role, [text]))


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted conversation and the spans, in code points, of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<|{escaped(role)}|>", escaped(text)
        parts += [head, body, _END]
        if role == ASSISTANT:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        at += len(head) + len(body) + len(_END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. No mark is whole within a role or text, so the
    next one ends it."""
    turns, at = [], 0
    while at < len(formatted):
        middle = formatted.find("|>", at + 2) if formatted.startswith("<|", at) else -1
        end = formatted.find(_END, middle + 2) if middle > 0 else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(formatted[at + 2 : middle]), unescaped(formatted[middle + 2 : end])))
        at = end + len(_END)
    return turns


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the sorted events of a task, one conversation after the other."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(span)]
    columns = ("conv_id", "kind", "role", "text")
    current, messages, done, chars = None, [], [], 0

    def finished():
        return (current[0], len(messages), *render([(role, "".join(parts)) for role, parts in messages]))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
            names=["conv_id", "n_turns", "formatted", "loss"],
        )

    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in columns)):
            if current is None or current[0] != conv:
                if current is not None:
                    done.append(finished())
                    chars += len(done[-1][2])
                current, messages = (conv,), []
                if chars > 1 << 22:
                    yield batch_of(done)
                    done, chars = [], 0
            fold(messages, kind, role or "", text or "")
    if current is not None:
        done.append(finished())
        yield batch_of(done)


#: Characters of a streamed delta in a log that is made from finished turns.
DELTA_CHARS = 200


def event_log(
    turns: DataFrame, conv_id: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A log (conv_id, seq, role, text, kind) that a chat service could have kept of the turns.

    An answer is begun, half streamed, regenerated and streamed whole in deltas; any other turn
    is sent with its first half and edited. Folding the log gives the turns again, in the order
    of seq (null first), role and text; equal rows follow each other. The events come in the
    order of a hash. Nulls are as in `format_chats`.
    """
    chosen = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(seq).alias("seq"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    numbered = chosen.withColumn(
        "seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "role", "text"))
    )
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))

    def event(kind: str | None, said: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), said.alias("said"))

    answer = F.concat(
        F.array(event(None, F.lit("")), event("delta", half), event("regenerate", F.lit(""))),
        F.transform(pieces, lambda piece: event("delta", piece)),
    )
    other = F.array(event(None, half), event("edit", F.col("text")))
    events = F.when(F.col("role") == ASSISTANT, answer).otherwise(other)
    log = numbered.select("conv_id", "seq", "role", F.posexplode(events).alias("step", "event"))
    return log.select(
        "conv_id", F.struct("seq", "step").alias("seq"), "role", F.col("event.said").alias("text"), "event.kind"
    ).sortWithinPartitions(F.xxhash64("conv_id", "seq"))


def format_chats(
    events: DataFrame,
    conv_id: str = "conv_id",
    seq: str = "turn",
    role: str = "role",
    text: str = "text",
    kind: str | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans of code points).

    A null text or role is an empty one; rows of a null conversation are one conversation. A
    null seq comes first, and events of one seq go by role, then text, so equal rows are equal
    turns. `kind` names the column of event kinds (see `fold`); without it all are messages. A
    conversation is one row, so it has to fit a task's memory; others stream past it.
    """
    chosen = events.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(seq).alias("seq"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        (F.lit(None) if kind is None else F.col(kind)).cast("string").alias("kind"),
    )
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text", "kind")
    return dealt.mapInArrow(_formatted, _CHATS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for chat in batch.to_pylist():
            formatted = chat["formatted"]
            read = read_back(formatted)
            turns = "".join(f"{role}\n{text}\n" for role, text in read)
            loss = "".join(unescaped(formatted[span["start"] : span["end"]]) for span in chat["loss"])
            rows.append(
                {
                    "conv_id": chat["conv_id"],
                    "n_turns": len(read),
                    "turns_sha256": hashlib.sha256(turns.encode()).hexdigest(),
                    "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                    "formatted_chars": len(formatted),
                }
            )
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[name] for row in rows], k) for name, k in zip(names, kinds)], names=names
        )


def digest(chats: DataFrame) -> DataFrame:
    """Formatted conversations read back: turns, and the text under the loss spans, as hashes."""
    return chats.mapInArrow(_digests, _DIGEST)


# Two turns that say what another template would take for its marks.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_EXTRA = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in TRICKY)
_LONGER = r"length(regexp_replace({}, '([<\[|\\])', '\1\\', 'g'))"
SQL = rf"""
WITH e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {_EXTRA}),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{ASSISTANT}'), '') AS loss,
        sum({_LONGER.format('role')} + {_LONGER.format('text')} + {len('<||>' + _END)})::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
