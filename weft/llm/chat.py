"""Conversations from event logs: folded into final messages, rendered with a template, and read back."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Fixed strings that steer common templates; a text must not contain one unescaped.
CONTROL = ["<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
#: First character of each control string, where one begins; looking ahead finds overlapping ones as well.
_BEGINS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    r"""Doubles each backslash and puts one behind the first character of each control string."""
    return _BEGINS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies in it."""
    plain = role if re.fullmatch(r"[A-Za-z0-9_-]+", role) else escape(json.dumps(role))
    head = f"{START}{plain}{MIDDLE}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, rest = turn.removeprefix(START).partition(MIDDLE)
    role = json.loads(unescape(head)) if head.startswith('"') else head
    return role, unescape(rest.removesuffix(END))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text).

    By seq: `message` starts a message with a text, `delta` appends to it, `edit` replaces its text, `regenerate` empties it and
    drops all later messages that had begun by then (deltas fill it anew). A message's text is the last start, edit or
    regeneration and the deltas behind it. Events without a message number are dropped; null texts are empty, null roles
    too; equal seqs go by kind, role and text. Conversations are folded by grouping messages and one running
    window, which spills; nothing gathers a conversation in memory, a single message's own events only.
    """
    e = events.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "kind", F.struct(F.col("seq").alias("seq"), F.expr("decode(kind, 'message', 0, 'edit', 1, 'regenerate', 2, 3)").alias("k"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t")).alias("at")).filter("message is not null")
    one = Window.partitionBy("conv_id", "message")
    reset = e.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(one))
    messages = (
        reset.filter("at >= reset or reset is null")
        .groupBy("conv_id", "message")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))).alias("parts"),
        )
    )
    begun = e.groupBy("conv_id", "message").agg(F.min("at").alias("begun"), F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("redone"), F.min_by("role", F.when(F.col("role") != "", F.col("at"))).alias("role"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    kept = begun.withColumn("cut", F.max("redone").over(earlier)).filter("cut is null or cut < begun").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), F.coalesce("role", F.lit("")).alias("role"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    return messages.join(kept, F.expr("conv_id <=> c and message = m")).select("conv_id", "message", "role", text.alias("text"))


def _render(trained: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        roles = batch.column("role").to_pylist()
        spans = [(a, b) if r in trained else (0, 0) for r, (_, a, b) in zip(roles, out, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("message"), pa.array([x[0] for x in out], pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], ["conv_id", "message", "formatted", "loss_start", "loss_end"])


def rendered(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each message in the template: (conv_id, message, formatted, loss_start, loss_end); joined in order they are the conversation.

    The loss mask of a message is the span of its text (code points of `formatted`) if its role is trained on, else empty.
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    return messages.select("conv_id", "message", "role", "text").mapInArrow(functools.partial(_render, trained), f"conv_id {kinds['conv_id']}, message {kinds['message']}, formatted string, loss_start long, loss_end long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, turn by turn: rows come sorted, so a conversation of any length needs no memory."""
    state = None

    def row(s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]).cast(k) for x, k in ((s[0], kind), (s[1], pa.int64()), (s[2].hexdigest(), pa.string()), (s[3], pa.int64()), (s[4].hexdigest(), pa.string()), (s[5], pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done = []
        for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(formatted)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            masked = unescape(formatted[a:b])
            state[3] += len(masked)
            state[4].update(masked.encode())
            state[5] += len(formatted)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if state is not None:
        yield row(state)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads rendered turns back: turns, loss text and their SHA-256 by conversation. Each conversation streams through one task, which a digest of all its text requires."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Code points of a text that one event of a log carries.
PIECE = 512


def events_of(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Stored conversations (conv_id, turn, role, text) as a log: a `message` event with the beginning of each row's text, and a `delta` for each further piece.

    Rows that repeat a turn are messages of their own, by role and text; null turns come first.
    """
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(place)).cast("long")
    numbered = turns.select("conv_id", "role", "text", number.alias("message"))
    rows = numbered.select("conv_id", "message", "role", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(piece)}}}"), F.lit(0))).alias("piece", "text"))
    first = F.coalesce(F.col("piece"), F.lit(0)) == 0
    seq = F.col("message") * (1 << 24) + F.coalesce("piece", F.lit(0))
    return rows.select("conv_id", seq.alias("seq"), F.when(first, "message").otherwise("delta").alias("kind"), "message", F.when(first, F.col("role")).alias("role"), "text")
