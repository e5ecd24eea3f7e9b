"""Chat formatting by event sourcing.

A conversation is a log of events. The log is dealt by conversation, sorted by
sequence number and folded, one event at a time, into final messages, which are
then rendered. Only the messages of the conversation at hand are held, and a
task streams through as many conversations as it is dealt.

Events (conv_id, seq, kind, ref, role, text):

* message: a message of its own, known later by its seq
* delta: text to append to message ref, or to the last message if ref is null
* edit: the new text of message ref (last if null)
* regenerate: message ref (last if null) is started afresh with this text, and
  every message after it goes

An event whose ref is no message that is still there does nothing.

A rendered turn is OPEN role NEWLINE text CLOSE NEWLINE. OPEN, CLOSE and the
escape sign itself are escaped inside roles and texts, so rendering can be read
back exactly whatever a text says. The loss mask covers the text of assistant
turns.

Defined cases: a null text is empty, a null role is an empty role, a line feed
in a role is escaped; events with a null seq come first; equal seqs are ordered by
kind, ref, role and text, so repeated rows are messages of their own; rows without
conv_id form one conversation under null; a conversation whose messages are all
gone renders to an empty string; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import held_names, partitions, table

OPEN, CLOSE, ESCAPE = "<|turn|>", "<|end|>", "\\"
#: What ordinary templates use; escaped too, so that no text can act as control.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]")
FIELDS = ("conv_id", "seq", "kind", "ref", "role", "text")


def escape(text: str) -> str:
    """text without any control string; unescape() turns it back."""
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for x in CONTROL:
        text = text.replace(x, x[0] + ESCAPE + x[1:])
    return text


def escape_role(role: str) -> str:
    """A role ends at the line feed, so its own ones are escaped too."""
    return escape(role).replace("\n", ESCAPE + "n")


def unescape(text: str) -> str:
    # an escape sign stands before another one or an n, or inside a control string
    out, at = [], 0
    while (k := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:k])
        if text[k + 1 : k + 2] == ESCAPE:
            out.append(ESCAPE)
            at = k + 2
        elif text[k + 1 : k + 2] == "n":  # no control string has it there
            out.append("\n")
            at = k + 2
        else:
            at = k + 1
    out.append(text[at:])
    return "".join(out)


class Fold:
    """The messages of one conversation after the events so far."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}  # seq -> [role, pieces of text]

    def apply(self, seq, kind: str, ref, role: str | None, text: str | None) -> None:
        text = text or ""
        if kind == "message":
            key = seq if seq not in self.messages else (seq, len(self.messages))
            self.messages[key] = [role or "", [text]]
            return
        key = ref if ref is not None else next(reversed(self.messages), None)
        if key not in self.messages:
            return
        if kind == "delta":
            self.messages[key][1].append(text)
        elif kind in ("edit", "regenerate"):
            self.messages[key][1] = [text]
            if kind == "regenerate":
                keys = list(self.messages)
                for later in keys[keys.index(key) + 1 :]:
                    del self.messages[later]

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(text)) for role, text in self.messages.values()]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it that the loss mask covers."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}{CLOSE}\n"
        out.append(part)
        at += len(part)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in formatted.split(CLOSE + "\n"):
        if part:
            role, _, text = part.removeprefix(OPEN).partition("\n")
            turns.append((unescape(role), unescape(text)))
    return turns


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, formatted, mask_starts and mask_ends of each conversation."""
    held_names(events, *FIELDS)
    n = partitions(events.sparkSession)
    order = [F.asc_nulls_first(x) for x in ("conv_id", "seq", "kind", "ref", "role", "text")]
    rows = events.select(*FIELDS).repartition(n, "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, starts, ends = [], [], [], []
        now, fold = None, None

        def close() -> None:
            formatted, mask = render(fold.turns())
            ids.append(now)
            texts.append(formatted)
            starts.append([a for a, _ in mask])
            ends.append([b for _, b in mask])

        def out() -> pa.RecordBatch:
            kinds = pa.int64(), pa.large_string(), pa.list_(pa.int64()), pa.list_(pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, texts, starts, ends), kinds, strict=True)], names=["conv_id", "formatted", "mask_starts", "mask_ends"])
            for x in (ids, texts, starts, ends):
                x.clear()
            return batch.set_column(1, "formatted", batch[1].cast(pa.string()))

        for batch in batches:
            for conv, *event in zip(*(batch[x].to_pylist() for x in FIELDS), strict=True):
                if fold is None or conv != now:
                    if fold is not None:
                        close()
                    now, fold = conv, Fold()
                fold.apply(*event)
            if len(ids) >= 512 or sum(map(len, texts)) > 1 << 24:
                yield out()
        if fold is not None:
            close()
        yield out()

    return rows.mapInArrow(run, "conv_id long, formatted string, mask_starts array<long>, mask_ends array<long>")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch[x].to_pylist() for x in ("conv_id", "formatted", "mask_starts", "mask_ends")), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
                rows.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as messages."""
    held_names(turns, "conv_id", "turn", "role", "text")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("ref"), "role", "text")


def as_log(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text) as the log of a chat that ends in them.

    By its number in its conversation a turn is said at once, streamed in deltas, mended
    by an edit, or answered, taken back with its answer and said anew. Turns are
    numbered by turn, role and text, nulls first, so that equal turns keep apart.
    """
    held_names(turns, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(*(F.asc_nulls_first(x) for x in ("turn", "role", "text")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(order).cast("long"))
    seq, text, half = F.col("nth") * 4, F.col("text"), F.ceil(F.length("text") / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(after: int, kind: str, body, ref=None, role=F.col("role")):
        ref = F.lit(None) if ref is None else ref
        return F.struct((seq + after).alias("seq"), F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), role.cast("string").alias("role"), body.alias("text"))

    nobody = F.lit(None)
    said = F.array(event(0, "message", text))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", first, seq, nobody), event(2, "delta", rest, None, nobody))
    edited = F.array(event(0, "message", F.concat(rest, F.lit("?"), first)), event(1, "edit", text, seq, nobody))
    again = F.array(event(0, "message", F.lit("a draft")), event(1, "message", F.lit("an answer to it"), None, F.lit("user")), event(2, "regenerate", first, seq, nobody), event(3, "delta", rest, None, nobody))
    turn = F.col("nth") % 4
    log = F.when(turn == 1, streamed).when(turn == 2, edited).when(turn == 3, again).otherwise(said)
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digest(reconstruct(as_log(turns)))


_CONTROL = r"replace(replace(replace(replace(replace(replace(replace({}, '\', '\\'), '<|turn|>', '<\|turn|>'), '<|end|>', '<\|end|>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(replace({_CONTROL.format('role')}, chr(10), '\n')) + length({_CONTROL.format('text')}) + 17)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
