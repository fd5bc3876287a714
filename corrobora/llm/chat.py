"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template turns turns into segments with loss flags.

Turns of a conversation are ordered by turn, then role, then text (nulls first); a null text is empty, a null role is the role "". A turn is allowed if
the machine has a step from the previous turn's role to its own; turns that are not are formatted all the same and marked.

The template names, for each role, what stands before and after the text and whether the text is learned from. Control strings all begin with `<` or
`[`; inside texts every `<`, `[` and backslash is followed by a backslash that the reader takes away again, so no text can contain a control string.
Roles that the template does not know are written with their own name.

Scale: a conversation is never gathered: the previous role is a lag, formatting is per turn, and digests of whole conversations are taken while sorted
rows stream by. A very long conversation only makes one stream longer. Repeated rows are turns of their own; an empty table has no turns.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Part:
    role: str
    before: str
    after: str
    learned: bool


TEMPLATE = (Part("system", "<<SYS>>\n", "\n<</SYS>>\n\n", False), Part("user", "<s>[INST] ", " [/INST]", False), Part("assistant", " ", " </s>", True))
STEPS = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
OTHER_BEFORE, OTHER_NAMED, OTHER_AFTER = "<<ROLE ", ">>\n", "\n<</ROLE>>\n"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescaped(text: Column) -> Column:
    """Left to right, `<\\`, `[\\` and two backslashes lose their last backslash."""
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def _choose(role: Column, template: tuple[Part, ...], value, other: Column) -> Column:
    out = other
    for part in template:
        out = F.when(role == part.role, value(part)).otherwise(out)
    return out


def turns(conversations: DataFrame, steps: dict[str, tuple[str, ...]] = STEPS) -> DataFrame:
    """(conv_id, position, role, text, allowed): turns in order, from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("position", F.row_number().over(order) - 1).withColumn("previous", F.coalesce(F.lag("role").over(order), F.lit(START)))
    first = F.col("position") == 0
    allowed = F.lit(False)
    for state, following in steps.items():
        allowed = allowed | ((first if state == START else ~first & (F.col("previous") == state)) & F.col("role").isin(*following))
    return rows.select("conv_id", F.col("position").cast("long").alias("position"), "role", "text", allowed.alias("allowed"))


def segments(conversations: DataFrame, template: tuple[Part, ...] = TEMPLATE, steps: dict[str, tuple[str, ...]] = STEPS) -> DataFrame:
    """(conv_id, position, allowed, segments): before, text and after of each turn as array<struct<text, loss>>."""
    role = F.col("role")
    before = _choose(role, template, lambda p: F.lit(p.before), F.concat(F.lit(OTHER_BEFORE), escaped(role), F.lit(OTHER_NAMED)))
    after = _choose(role, template, lambda p: F.lit(p.after), F.lit(OTHER_AFTER))
    learned = _choose(role, template, lambda p: F.lit(p.learned), F.lit(False))
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return turns(conversations, steps).select("conv_id", "position", "allowed", F.array(one(before, F.lit(False)), one(escaped(F.col("text")), learned), one(after, F.lit(False))).alias("segments"))


def read_back(formatted: DataFrame, template: tuple[Part, ...] = TEMPLATE) -> DataFrame:
    """From formatted turns to role, text, learned text and formatted length, using the written segments alone."""
    whole = F.array_join(F.transform("segments", lambda s: s.text), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), "")
    rows = formatted.select("conv_id", "position", "allowed", whole.alias("whole"), loss.alias("loss"))
    w = F.col("whole")
    name_end = F.instr(w, OTHER_NAMED)
    role = unescaped(F.substring(w, F.lit(len(OTHER_BEFORE) + 1), name_end - len(OTHER_BEFORE) - 1))
    text = F.substring(w, name_end + len(OTHER_NAMED), F.length(w) - name_end - len(OTHER_NAMED) + 1 - len(OTHER_AFTER))
    for part in sorted(template, key=lambda p: len(p.before)):          # the longest beginning is tried first
        here = w.startswith(part.before) & (F.lit(False) if OTHER_BEFORE.startswith(part.before) else ~w.startswith(OTHER_BEFORE)) & w.endswith(part.after)
        role = F.when(here, F.lit(part.role)).otherwise(role)
        text = F.when(here, F.substring(w, F.lit(len(part.before) + 1), F.length(w) - len(part.before) - len(part.after))).otherwise(text)
    return rows.select("conv_id", "position", "allowed", role.alias("role"), unescaped(text).alias("text"), unescaped(F.col("loss")).alias("loss"), F.length(w).cast("long").alias("chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by conversation and position."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_bad_turns"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now: list | None = None

    def row() -> list:
        conv, n, turns_hash, chars, loss_hash, formatted, bad = now
        return [conv, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, bad]
    for batch in batches:
        done = []
        for conv, role, text, loss, chars, allowed in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv:
                done += [row()] if now is not None else []
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += chars
            now[6] += not allowed
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names)


def digests(read: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_bad_turns of each conversation."""
    parts = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "loss", "chars", "allowed").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_bad_turns long")
