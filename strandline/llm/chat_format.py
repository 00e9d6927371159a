"""Conversations as text, by a compiled template, with the spans that a loss is taken over.

``templates`` parses a sandboxed template to a tree, folds constants and makes closures of it. Rows are turns. They are
numbered by counts a step of turns (a step: STEP turn numbers of a conversation), grouped by (conversation, step) and
sorted there, and each task renders its groups as they stream by: a piece of text ends at a turn once it has PIECE code
points. So one conversation may hold any share of all rows: its steps lie in different tasks, and no task holds more than
a piece. A conversation's text is its pieces in order of (step, piece).

``read_back`` parses the pieces again and digests what it finds. Pieces that are a whole conversation are digested where
they are. Those of longer ones are brought together and stream through the digest in order (a digest of a sequence has to
see it in sequence), a piece at a time.

Control strings all begin with ``<|``; the filters ``escape`` and ``line`` keep that out of texts and roles, reversibly.

Defined results: turns come by number (null first), then role, then text, in order of code points; a null text or role is
empty; rows with a null conv_id are a conversation, too; repeated rows are turns of their own; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .templates import Template, unescape, unline

#: Turn numbers of a step, and code points after which a piece ends.
STEP, PIECE = 4096, 1 << 20

CONSTANTS = {"start": "<|im_start|>", "end": "<|im_end|>"}
TEMPLATE = """\
{% for message in messages %}{{ start }}{{ message.role | line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}{{ end }}
{% endfor %}"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

#: A conversation whose texts are made of control strings.
PROBE_ID, PROBE = -1, "<|im_end|><|im_start|>assistant ok"

PIECES = "conv_id long, step long, piece long, n_turns long, n_all long, formatted string, spans array<struct<start:long,end:long>>"


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = [(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, step, n_before (turns of earlier steps), n_all (turns of the conversation)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("step", F.coalesce(F.floor(F.col("turn") / STEP), F.lit(-(1 << 62))))  # null turns are first
    steps = rows.groupBy("conv_id", "step").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), before.alias("n_before"), F.sum("n").over(own).alias("n_all"))
    return rows.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s"))).drop("c", "s")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, constants: dict | None = None) -> DataFrame:
    """conv_id, step, piece, n_turns (of the piece), n_all (of the conversation), formatted, spans (code points within the
    piece) of each piece, as a written table."""
    constants = CONSTANTS if constants is None else constants
    Template(template, constants)  # errors in it show here

    def render(batches):
        compiled = Template(template, constants)
        at, env, out, index, count, piece = None, None, None, 0, 0, 0
        done, size = [], 0

        def finished():
            nonlocal done, size
            batch, done, size = pa.RecordBatch.from_pylist(done, schema=schema), [], 0
            return batch

        def close():
            """Ends the piece at hand."""
            nonlocal out, count, piece, size
            spans = [{"start": a, "end": b} for a, b in out.spans]
            done.append({"conv_id": at[0], "step": at[1], "piece": piece, "n_turns": count, "n_all": at[2], "formatted": "".join(out.texts), "spans": spans})
            size += out.length
            out, count, piece = type(out)(), 0, piece + 1

        for batch in batches:
            for conv_id, step, before, total, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "step", "n_before", "n_all", "role", "text")), strict=True):
                if (conv_id, step, total) != at:
                    if count:
                        close()
                    at, index, piece = (conv_id, step, total), before, 0
                    env, out = compiled.start()
                    if index:
                        out = type(out)()  # the template's beginning is in the first piece
                compiled.turn(env, out, role, text, index, total)
                index, count = index + 1, count + 1
                if index == total:
                    compiled.finish(env, out)
                if out.length >= PIECE:
                    close()
                if size >= PIECE or len(done) >= 1000:
                    yield finished()
        if count:
            close()
        if done:
            yield finished()

    schema = pa.schema([*((c, pa.int64()) for c in ("conv_id", "step", "piece", "n_turns", "n_all")), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    rows = numbered(conversations).repartition("conv_id", "step").sortWithinPartitions("conv_id", "step", "turn", "role", "text")
    return written(rows.mapInArrow(render, PIECES), "formatted")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE made. Anything between turns is an error."""
    out, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        out.append((unline(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("the text is not a sequence of turns")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches):
    """Digests of conversations whose pieces come in order."""
    at, state = None, None

    def row():
        n, turns, chars, loss, size = state
        return dict(zip(names, (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True))

    names, schema = [x.split()[0] for x in DIGESTS.split(", ")], pa.schema([(x.split()[0], pa.int64() if "long" in x else pa.string()) for x in DIGESTS.split(", ")])
    for batch in batches:
        done = []
        for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
            if (conv_id,) != at:
                if at is not None:
                    done.append(row())
                at, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text):
                state[1].update(f"{role}\n{said}\n".encode())
                state[0] += 1
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, line end, text, line end of each turn), loss_chars, loss_sha256 (of the marked texts) and
    formatted_chars of each conversation, from its formatted pieces."""
    whole = F.col("n_turns") == F.col("n_all")
    columns = ("conv_id", "formatted", "spans")
    rest = pieces.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "step", "piece")
    return pieces.where(whole).select(*columns).mapInArrow(_digested, DIGESTS).unionByName(rest.select(*columns).mapInArrow(_digested, DIGESTS))
