r"""Chat formatting: a finite-state machine over roles and a declarative template give text segments with loss flags.

A Template names the marks around a turn, the role order (states and transitions) and the roles whose text is
learned. Formatting a conversation streams over its turns in order: rows are dealt by conversation, sorted within
partitions, and passed through one small state, so a conversation of any length needs the memory of one batch.
Every turn becomes three segments: the opening mark with the role, the text, and the closing mark. The segment of
an assistant's text, and nothing else, has the loss flag.

Texts and roles may hold anything, marks included: `\` and the first character of each of the template's control strings get a `\` in
front, and in roles also the character that ends the role in the opening mark, so that reading the output back is exact. Escapes and reader come
from the template; one that can't be read back is refused.

The machine starts at "start"; a turn whose role has no transition leaves the state as it is and makes the
conversation invalid from there on (`valid` false on that segment and all later ones). Invalid conversations are
formatted all the same.

Defined results: null texts and roles count as empty; turns are ordered by turn (null last), then role, then
text, so ties and repeated rows give all their turns in a fixed order; a null conv_id is a conversation of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table


@dataclass(frozen=True)
class Template:
    """Marks of a turn, transitions (state, role) -> state, and learned roles."""

    opening: str = "<turn:{role}>\n"
    closing: str = "</turn>\n"
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    learned: tuple[str, ...] = ("assistant",)
    #: How marks begin; texts hold none of these unescaped.
    controls: tuple[str, ...] = ("<turn", "</turn")

    def __post_init__(self) -> None:
        before, _, after = self.opening.partition("{role}")
        if not after or "\\" in self.opening + self.closing + "".join(self.controls):
            raise ValueError("a role needs an end in the opening mark, and marks can't hold a backslash")
        if not all(self.controls) or not all(any(mark.startswith(c) for c in self.controls) for mark in (before, self.closing)):
            raise ValueError("both marks have to begin with a control string")
        # A text's last characters and the closing mark together must not look like a control string.
        if any(self.closing.startswith(rest) or rest.startswith(self.closing) for c in self.controls for rest in (c[i:] for i in range(1, len(c)))):
            raise ValueError("a control string runs into the closing mark")

    def control(self) -> str:
        return "|".join(re.escape(c) for c in self.controls)

    def escape(self, text: str) -> str:
        return re.sub(rf"\\|(?={self.control()}).", lambda m: "\\" + m[0], text, flags=re.S)

    def role_end(self) -> str:
        return re.escape(self.opening.partition("{role}")[2][0])

    def escape_role(self, role: str) -> str:
        return re.sub(rf"[\\{self.role_end()}]", lambda m: "\\" + m[0], role)

    def turn(self) -> re.Pattern:
        """One whole turn at the start of a buffer: role, text."""
        before, _, after = self.opening.partition("{role}")
        return re.compile(rf"{re.escape(before)}((?:[^\\{self.role_end()}]|\\.)*){re.escape(after)}((?:\\.|(?!{self.control()})[^\\])*){re.escape(self.closing)}", re.S)

    def open(self, role: str) -> str:
        return self.opening.replace("{role}", self.escape_role(role))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, segment long, text string, loss boolean, valid boolean"


def write_segments(template: Template):
    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, valid, at = object(), "start", True, 0
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, role, text in zip(ids, batch["role"], batch["text"], strict=True):
                if conv != now:
                    now, state, valid, at = conv, "start", True, 0
                role, text = role or "", text or ""
                after = template.moves.get((state, role))
                valid, state = valid and after is not None, after or state
                for part, loss in ((template.open(role), False), (template.escape(text), role in template.learned), (template.closing, False)):
                    out.append((conv, at, part, loss, valid))
                    at += 1
            yield pd.DataFrame(out, columns=["conv_id", "segment", "text", "loss", "valid"]).astype({"conv_id": "Int64"})

    return formatted


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, segment, text, loss, valid. The formatted text of one is its segments' texts in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    return ordered.mapInPandas(write_segments(template or Template()), SEGMENTS)


def read_segments(template: Template):
    """Digest rows of conversations, read back from their segments. Turns are parsed from the joined text, the loss mask gives the learned text."""
    state: dict = {}

    def start(conv) -> None:
        state.update(conv=conv, buffer="", turns=0, all=hashlib.sha256(), learned=hashlib.sha256(), loss=0, chars=0, valid=True)

    def done() -> tuple:
        if state["buffer"]:
            raise ValueError(f"conversation {state['conv']} can't be read back")
        return (state["conv"], state["turns"], state["all"].hexdigest(), state["loss"], state["learned"].hexdigest(), state["chars"], state["valid"])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    turn = template.turn()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state.clear()
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, text, loss, valid in zip(ids, batch["text"], batch["loss"], batch["valid"], strict=True):
                if not state or conv != state["conv"]:
                    if state:
                        out.append(done())
                    start(conv)
                state["chars"] += len(text)
                state["valid"] = state["valid"] and bool(valid)
                if loss:
                    learned = unescape(text)
                    state["loss"] += len(learned)
                    state["learned"].update(learned.encode())
                state["buffer"] += text
                while m := turn.match(state["buffer"]):
                    state["all"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    state["turns"] += 1
                    state["buffer"] = state["buffer"][m.end() :]
            yield frame(out)
        if state:
            yield frame([done()])

    return run


def read_back(segments: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """One row per conversation from its segments alone. in_order: segments come as format_chat gives them, so that nothing needs to move."""
    ordered = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInPandas(read_segments(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: The contract's extra conversation (fixed value): both turns say this.
EXTRA = r"\### Assistant: </turn> ok"


def op6_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return read_back(format_chat(rows.unionByName(extra)), in_order=True).drop("valid")


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS body,
         replace(replace(role, '\', '\\'), '>', '\>') AS mark FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn:>') + 1 + length(mark) + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
