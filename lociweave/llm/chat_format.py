r"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation becomes a sequence of segments, each with a loss flag; their concatenation is the
formatted text. Per turn there are three: the opening mark, the escaped text, and the closing mark.
The marks cannot occur in an escaped text:

    \    -> \\        every backslash
    #    -> \h        where two more # follow, so that ### never stands in a text
    <    -> \l        where /turn> follows

so reading back is a plain scan. Segments, not whole conversations, are the unit of output, so a
conversation of any length needs the memory of its longest turn only.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.runtime import shuffle_partitions

#: role -> label in the opening mark, whether the text of the turn is learned
ROLES = {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True), "tool": ("Tool", False)}
OPEN, CLOSE = "### {label}: ", " </turn>\n"
#: state -> role -> next state; whatever is missing is a fault in turn order
MACHINE = {
    "start": {"system": "opened", "user": "asked"},
    "opened": {"user": "asked"},
    "asked": {"assistant": "answered", "tool": "asked"},
    "answered": {"user": "asked", "tool": "asked"},
}
FINAL = ("answered",)


@dataclass(frozen=True)
class Template:
    """What a turn looks like. A role without an entry is labelled ``=`` and its own escaped name, without loss."""

    roles: tuple = tuple((k, *v) for k, v in ROLES.items())
    open: str = OPEN
    close: str = CLOSE

    def label(self, role: str) -> str:
        return next((x[1] for x in self.roles if x[0] == role), "=" + escape(role).replace(":", r"\c").replace("\n", r"\n"))

    def learned(self, role: str) -> bool:
        return next((x[2] for x in self.roles if x[0] == role), False)

    def role(self, label: str) -> str:
        return unescape(label[1:]) if label[:1] == "=" else next(x[0] for x in self.roles if x[1] == label)


def escape(text: str) -> str:
    return re.sub(r"<(?=/turn>)", r"\\l", re.sub(r"#(?=##)", r"\\h", text.replace("\\", "\\\\")))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"h": "#", "l": "<", "c": ":", "n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def segments_of(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    return [(template.open.format(label=template.label(role)), False), (escape(text), template.learned(role)), (template.close, False)]


SEGMENTS = "conv_id long, seg long, text string, loss boolean, fault string"


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, role, text) -> segments (conv_id, seg, text, loss, fault), each conversation whole and in order within a partition.

    Turns go by number (null first), equal numbers by role and text. Null role or text counts as empty; a
    null conv_id is a conversation of its own. ``fault`` tells on the last segment of a turn why it breaks
    the order of roles, or on the last turn why the conversation may not end there; nothing is dropped.
    Columns beside the four are ignored. An empty table gives no segments.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def run(batches):
        last, seg, state, held = object(), 0, "start", None  # held: the closing segment of the latest turn

        def ended(row):
            return row if row[4] or state in FINAL else (*row[:4], "ends in state " + state)

        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last or held is None:
                    if held is not None:
                        out.append(ended(held))
                    last, seg, state = conv, 0, "start"
                elif held is not None:
                    out.append(held)
                following = MACHINE[state].get(role)
                fault = None if following else f"{role or 'no role'} after {state}"
                state = following or state
                *head, close = [(conv, seg + i, t, loss, None) for i, (t, loss) in enumerate(segments_of(role, text, template))]
                out += head
                held, seg = (*close[:4], fault), seg + 3
            if out:
                yield _arrow(out)
        if held is not None:
            yield _arrow([ended(held)])

    return dealt.mapInArrow(run, SEGMENTS)


def _arrow(rows):
    kinds = [("conv_id", pa.int64()), ("seg", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("fault", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, faults long"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, taken from the formatted text and the loss flags alone.

    Expects the segments of a conversation together and in order, as :func:`format_conversations` leaves them.
    """
    before, after = (re.escape(x) for x in template.open.split("{label}"))
    mark = re.compile(f"{before}([^:\\n]+){after}(.*){re.escape(template.close)}", re.S)

    def run(batches):
        now = None

        def result(c):
            return c["id"], c["turns"], c["all"].hexdigest(), c["learned"], c["loss"].hexdigest(), c["chars"], c["faults"]

        for batch in batches:
            out = []
            for conv, seg, text, loss, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or seg == 0:
                    if now:
                        out.append(result(now))
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "learned": 0, "loss": hashlib.sha256(), "chars": 0, "faults": 0, "open": ""}
                now["open"] += text
                now["chars"] += len(text)
                now["faults"] += fault is not None
                if loss:
                    plain = unescape(text)
                    now["learned"] += len(plain)
                    now["loss"].update(plain.encode())
                if now["open"].endswith(template.close):
                    label, body = mark.fullmatch(now["open"]).groups()
                    now["all"].update(f"{template.role(label)}\n{unescape(body)}\n".encode())
                    now["turns"] += 1
                    now["open"] = ""
            if out:
                yield _digests(out)
        if now:
            yield _digests([result(now)])

    return segments.mapInArrow(run, DIGESTS)


def _digests(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])


PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op5_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe))).drop("faults")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : ') + length(role) + length(' </turn>') + 1 + length(text)
           + length(text) - length(replace(text, '\', ''))
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
           + (length(text) - length(replace(text, '</turn>', ''))) // 7)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
