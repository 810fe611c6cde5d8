"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment.

Turns are shuffled by conversation once and sorted inside their partition. The formatter
streams over them with the machine's state as all that it keeps, so a conversation may be
longer than memory. Its output, segments of text with a loss flag, can be read back turn by
turn: control strings inside texts are escaped in a way that ``unescape`` undoes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn of each role, which roles may follow which, and who is learned.

    ``other`` surrounds the turns of roles without an entry, ``{role}`` being the escaped role.
    ``moves`` maps a state to the roles allowed next; a turn's role is the state after it. The
    first state is ``start``; a conversation may end in a state of ``ends``.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")})
    other: tuple[str, str] = ("<|turn:{role}|>", "<|/turn|>")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """Strings that no text may hold: every marker, stripped of white space, and what opens a free one."""
        marks = [self.begin, *(m for pair in self.turns.values() for m in pair), self.other[1], *self.other[0].split("{role}")]
        return sorted({m.strip() for m in marks if m.strip()}, key=lambda m: (-len(m), m))

    def escape(self, text: str) -> str:
        """A single escape sign goes behind the first character of each control string, own ones are doubled."""
        starts = "|".join(map(re.escape, self.controls()))
        return re.sub(f"(?=(?:{starts}))(.)", lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2), flags=re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


TEMPLATE = Template()


def _ordered(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    narrow = rows.select(
        F.col(id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    return narrow.repartition("conv_id").sortWithinPartitions(*order)


def format_turns(rows: DataFrame, template: Template = TEMPLATE, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, first, state, valid, segments): a row per turn, in order inside its partition.

    ``segments`` are (text, loss); joined over a conversation they are its formatted string.
    ``state`` is the machine's after the turn, ``error`` once a role was not allowed and from then
    on; ``valid`` says whether the conversation may end here. Invalid conversations are formatted all the same.
    A null role or text is empty, a null turn comes last, equal turns are ordered by role and
    text, rows with a null id form one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), "start"
        for batch in batches:
            first, states, segments = [], [], []
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, who, said in zip(ids, roles, texts):
                new = conv != current
                if new:
                    current, state = conv, "start"
                state = who if who in template.moves.get(state, ()) else "error"
                before, after = template.turns.get(who) or (template.other[0].replace("{role}", template.escape(who)), template.other[1])
                first.append(new)
                states.append(state)
                segments.append([
                    {"text": (template.begin if new else "") + before, "loss": False},
                    {"text": template.escape(said), "loss": who in template.learned},
                    {"text": after, "loss": False},
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first, pa.bool_()), pa.array(states, pa.string()), pa.array([s in template.ends for s in states], pa.bool_()),
                 pa.array(segments, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))],
                names=["conv_id", "turn", "first", "state", "valid", "segments"],
            )

    return _ordered(rows, id, turn, role, text).mapInArrow(run, "conv_id long, turn long, first boolean, state string, valid boolean, segments array<struct<text:string,loss:boolean>>")


class Scanner:
    """Reads turns from the formatted string of a conversation, which may come in pieces of any size.

    What is between turns and roles is known from the markers alone. No more than the turn
    that is not yet complete is held.
    """

    def __init__(self, template: Template = TEMPLATE) -> None:
        lead, close = template.other[0].split("{role}")
        openings = [(before, after, who) for who, (before, after) in template.turns.items()] + [(lead, template.other[1], None)]
        if not all(before.strip() and after.strip() for before, after, _ in openings) or not close.strip():
            raise ValueError("every turn needs a marker before and after it")
        self.template, self.close = template, close
        self.openings = sorted(openings, key=lambda o: -len(o[0]))
        self.held, self.at, self.begun = "", 0, False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that the piece completes."""
        self.held += piece
        if not self.begun:
            if len(self.held) < len(self.template.begin):
                return
            if not self.held.startswith(self.template.begin):
                raise ValueError("the conversation does not open as its template says")
            self.held, self.begun = self.held[len(self.template.begin) :], True
        start = 0
        while start < len(self.held):
            opening = next((o for o in self.openings if self.held.startswith(o[0], start)), None)
            if opening is None:
                if len(self.held) - start < len(self.openings[0][0]):
                    break
                raise ValueError(f"no turn begins with {self.held[start : start + 20]!r}")
            before, after, who = opening
            body = start + len(before)
            end = self.held.find(after, max(body, self.at - len(after)))
            if end < 0:
                self.at = len(self.held) - start
                break
            said = self.held[body:end]
            if who is None:
                head, mark, said = said.partition(self.close)
                if not mark:
                    raise ValueError("a turn's role has no end")
                yield unescape(head), unescape(said)
            else:
                yield who, unescape(said)
            start, self.at = end + len(after), 0
        self.held = self.held[start:]

    def finish(self) -> None:
        if self.held or not self.begun:
            raise ValueError("the conversation ends inside a turn")


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of each conversation, from the output of ``format_turns`` directly (its order is needed).

    Of that only the formatted strings are read, and where a conversation begins: turns, roles and
    what is learned are found by a ``Scanner`` in the string of the whole conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    Scanner(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, scanner, state, done = None, None, "start", []

        def close() -> None:
            if open_one is not None:
                scanner.finish()
                conv, n, turns, chars, loss, length = open_one
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, state in template.ends))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["first"]:
                    close()
                    open_one, scanner, state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Scanner(template), "start"
                whole = "".join(s["text"] for s in row["segments"])
                open_one[5] += len(whole)
                for who, said in scanner.feed(whole):
                    state = who if who in template.moves.get(state, ()) else "error"
                    open_one[1] += 1
                    open_one[2].update(f"{who}\n{said}\n".encode())
                    if who in template.learned:
                        open_one[3] += len(said)
                        open_one[4].update(said.encode())
            if done:
                yield flush()
        close()
        yield flush()

    return formatted.select("conv_id", "first", "segments").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op7(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    hard = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(rows.unionByName(hard)))


#: ``formatted_chars`` here: the markers' lengths, and an escape sign for each backslash and each control string.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS prev,
         CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 18 + length(role) END
           + length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
           + len(regexp_extract_all(text, '<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[OUT\]|<\|turn:|<\|/turn\|>|\|>')) AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), g AS (
  SELECT *, CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS fine FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars,
       bool_and(fine) AND arg_max(role, n) = 'assistant' AS valid
FROM g GROUP BY conv_id
"""
