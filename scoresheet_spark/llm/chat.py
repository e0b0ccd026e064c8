"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: `message` (a whole turn), `delta` (text appended to a turn), `edit` (new
text for a turn) and `regenerate` (a turn starts anew). An event says which turn it acts on by that turn's
sequence number; without one a regeneration acts on the latest assistant turn, which it makes the latest turn
again, and deltas and edits act on the latest turn of their role, or of all where none has it. The log is partitioned by conversation, sorted by sequence number and folded into the final
messages, which are rendered with a template that marks turns and escapes every control string inside roles
and texts.

Events are streamed: Spark partitions and sorts them (spilling where needed), by conversation, by the turn
that an event acts on, and by sequence. So a worker holds one turn at a time, and a long conversation leaves
as many parts as it needs: no conversation, however large, is gathered in memory. It is one task's stream, as
the digest of a conversation is one over all of its turns in order: a conversation with a third of all rows
takes a third of the rendering time, in bounded memory.

Edge cases: a null text is '', a null role is '', a null event is a message. Null sequence numbers sort
first, ties by kind (messages first), role and text; repeated rows are events of their own. Rows whose
conversation is null form one conversation. An event without a turn to act on opens one with the role given:
the first event of a conversation, a regeneration before any assistant turn, and one that names a turn that
isn't there. An empty table gives no parts. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Control strings of this template and of other widespread ones; fixed values.
CONTROLS = (
    "<|turn|>",
    "<|text|>",
    "<|end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|im_start|>",
    "<|im_end|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
TURN, TEXT, END = CONTROLS[:3]
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Characters of formatted text in one part, unless a single turn is longer.
PART_CHARS = 1 << 20

SCHEMA = "conv_id bigint, part int, formatted string, loss_start array<bigint>, loss_end array<bigint>"


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends in it."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part: the inverse of `render`."""
    for turn in formatted.split(END)[:-1]:
        head, _, body = turn.partition(TEXT)
        yield unescape(head.removeprefix(TURN)), unescape(body)


def _fold(events: Iterator[tuple]) -> Iterator[tuple[object, str, str]]:
    """(conversation, role, text) of each final message. Events come sorted by conversation, target turn and sequence."""
    now, role, parts = None, "", []
    for conv, target, seq, event, r, text in events:
        key = (conv, target, seq) if event == "message" else (conv, target, None)
        opens = now is None or now[:2] != key[:2] or event == "message"
        if opens:
            if now is not None:
                yield now[0], role, "".join(parts)
            now, role, parts = key, r, [text]
        elif event == "delta":
            parts.append(text)
        else:  # an edit or a regeneration replaces what the turn said so far
            parts = [text]
    if now is not None:
        yield now[0], role, "".join(parts)


def _aimed(rows: DataFrame) -> DataFrame:
    """`rows` (conv, target, seq, event, role, text) with `aim`, the sequence number of the turn that each acts on, null targets resolved."""
    order = Window.partitionBy("conv").orderBy("seq", F.col("event") != "message", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    message, restart = F.col("event") == "message", (F.col("event") == "regenerate") & F.col("target").isNull()
    answers = F.when((message & (F.col("role") == "assistant")) | restart, F.lit(True))
    rows = rows.withColumn("_number", F.row_number().over(order)).withColumn("_answered", F.coalesce(F.last(answers, True).over(before), F.lit(False)))
    opens = message | (F.col("_number") == 1) | (restart & ~F.col("_answered"))
    # a struct, so that the number itself may be null
    opened = F.struct(F.when(message, F.col("seq")).otherwise(F.coalesce("target", "seq")).alias("seq"))
    rows = rows.withColumn("_opened", F.when(opens, opened))
    rows = rows.withColumn("_answer", F.last(F.when(answers & opens, F.col("_opened")), True).over(before))
    again = F.when(F.col("event") == "regenerate", F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("seq"))).otherwise(F.col("_answer")))
    rows = rows.withColumn("_begun", F.coalesce("_opened", again))
    of_role = Window.partitionBy("conv", "role").orderBy("seq", F.col("event") != "message", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_latest", F.last("_begun", True).over(before)).withColumn("_same", F.last("_begun", True).over(of_role))
    own = F.when(F.col("_opened").isNotNull(), F.col("_opened.seq"))
    said = F.when(F.col("_same").isNotNull(), F.col("_same.seq")).otherwise(F.col("_latest.seq"))
    aim = own.when(F.col("target").isNotNull(), F.col("target")).when(restart, F.col("_answer.seq")).otherwise(said)
    return rows.withColumn("aim", aim)


def format_conversations(df: DataFrame, conv: str = "conv_id", seq: str = "turn", event: str | None = None, target: str | None = None) -> DataFrame:
    """Formatted parts of every conversation, with the spans of assistant texts (the loss mask) in each part.

    `event` and `target` name the columns with an event's kind and the turn that it acts on; without them
    every row is a whole message. A message's target is its own sequence number.
    """
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(seq).cast("bigint").alias("seq"),
        (F.coalesce(F.col(event), F.lit("message")) if event else F.lit("message")).alias("event"),
        (F.col(target).cast("bigint") if event and target else F.lit(None).cast("bigint")).alias("target"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv")
    rows = _aimed(rows) if event else rows.withColumn("aim", F.col("seq"))
    ordered = rows.select("conv", "aim", "seq", "event", "role", "text").sortWithinPartitions("conv", "aim", "seq", (F.col("event") != "message"), "role", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out, held = [], 0
        pieces: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        now, part, at = None, 0, 0
        begun = False

        def close() -> None:
            nonlocal pieces, starts, ends, part, at, held
            out.append((now, part, "".join(pieces), starts, ends))
            held += at
            pieces, starts, ends, part, at = [], [], [], part + 1, 0

        def emit() -> pa.RecordBatch:
            nonlocal out, held
            cols, held = list(zip(*out, strict=True)), 0
            out = []
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "part", "formatted", "loss_start", "loss_end"])

        for conv_id, role, text in _fold(events()):
            if begun and conv_id != now:
                close()
                part = 0
            elif begun and at >= PART_CHARS:
                close()
            if held >= 4 * PART_CHARS or len(out) >= 5000:
                yield emit()
            now, begun = conv_id, True
            turn, a, b = render(role, text)
            pieces.append(turn)
            if role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            at += len(turn)
        if begun:
            close()
            yield emit()

    return ordered.mapInArrow(build, SCHEMA)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts say: counts and digests of its turns and of the text under the loss mask.

    Takes the parts as `format_conversations` leaves them, in order within each partition.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out, now = [], None

        def done() -> None:
            conv, n, turns, chars, loss, size = now
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, part, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    if now:
                        done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for s, e in zip(starts, ends, strict=True):
                    said = unescape(text[s:e])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if now:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation that the registered query adds: its texts consist of control strings.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(rows.unionByName(probe)))


def chat_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations told as event logs: each turn a message with the first half of its text and a delta with the rest, without targets.

    In every third conversation assistant turns are generated anew from a delta; in every fifth users edit their turns afterwards.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), (F.col("turn") * 10).cast("bigint").alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    again = (F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0)
    edited = (F.col("role") == "user") & (F.col("conv_id") % 5 == 0)
    say = lambda if_, after, event, text, target=None: F.when(if_, F.struct((F.col("at") + after).alias("seq"), F.lit(event).alias("event"), (F.lit(None).cast("bigint") if target is None else target).alias("target"), text.alias("text")))
    events = F.array(
        say(F.lit(True), 0, "message", F.substring("text", F.lit(1), half)),
        say(F.lit(True), 1, "delta", F.substring("text", half + 1, F.length("text"))),
        say(again, 2, "regenerate", F.lit("Once more: ")),
        say(again, 3, "delta", F.col("text")),
        say(edited, 1_000_000, "edit", F.concat(F.lit("Rather: "), "text"), F.col("at")),
    )
    log = rows.select("conv_id", "role", F.explode(F.array_compact(events)).alias("e")).select("conv_id", "role", "e.*")
    return read_back(format_conversations(log, seq="seq", event="event", target="target"))


QUERIES = {"op7_chat_format": op7_chat_format, "chat_event_log": chat_event_log}
_DIGEST_SQL = f"""
escaped AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '(<)([|]turn[|]>|[|]text[|]>|[|]end[|]>|[|]endoftext[|]>|[|]startoftext[|]>|[|]im_start[|]>|[|]im_end[|]>|s>|/s>|<SYS>>|</SYS>>)', '\\1\\\\\\2', 'g') AS e FROM logged)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + {len(TURN + TEXT + END)} + length(regexp_replace(e, '(\\[)(/?INST\\])', '\\1\\\\\\2', 'g'))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""
ORACLE = {
    "op7_chat_format": f"""
WITH logged AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),{_DIGEST_SQL}""",
    "chat_event_log": f"""
WITH logged AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role,
         CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'Once more: ' WHEN role = 'user' AND conv_id % 5 = 0 THEN 'Rather: ' ELSE '' END || coalesce(text, '') AS text
  FROM conversations),{_DIGEST_SQL}""",
}
