"""Chat formatting from an event log.

A log row is (conv_id, turn, seq, event, role, text).  Rows of a message are folded in sequence: ``open`` starts it
with a role and a first text, ``delta`` appends, ``edit`` replaces the text, ``regenerate`` throws the text away
so that the following deltas stream a new one, ``retract`` removes the message.  Messages, not conversations,
are the unit of the fold, so a conversation of any length is many small groups.  Rendering is a column
expression per message; a conversation is its rendered messages in turn order, and readers that need it whole
stream them.

Texts may hold the template's control strings: a backslash is put behind the first character of each (and behind every
backslash), which no control string survives and which ``unescape`` reverts exactly.

Null texts and roles are empty.  A null conv_id is a conversation of its own, null turns come first.  Rows that repeat a
turn are messages of their own, ordered by role and text; ties are only between equal ones.  Unknown events are errors.  Texts and
conversations of any length are streamed.  An empty table gives no rows.  Extra columns are not passed, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import stored

# fixed values: the template's marks and the control strings that texts must not spell
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = r"\\|(?:" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + ")"
#: A message streamed by ``log_of`` comes in deltas of at most this many characters.
DELTA = 256
LOG = "conv_id, turn, message, seq, event, role, text"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def log_of(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """The event log that streaming a table of finished turns (conv_id, turn, role, text) leaves.

    Each turn is opened empty, drafted with its first delta, regenerated and streamed anew; user turns are typed whole
    and edited to their text.
    """
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(rows.withColumn("message", F.monotonically_increasing_id()), "turns")  # a lost task must not number them anew
    n = F.ceil(F.length("text") / delta).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr("text", i * delta + 1, F.lit(delta)))
    event = lambda name, text: F.array(F.struct(F.lit(name).alias("event"), text.alias("text")))
    streamed = F.concat(event("open", F.lit("")), event("delta", cuts[0]), event("regenerate", F.lit("")), F.transform(cuts, lambda c: F.struct(F.lit("delta").alias("event"), c.alias("text"))))
    typed = F.concat(event("open", F.lit("")), event("delta", F.upper(cuts[0])), event("edit", F.col("text")))
    out = rows.select("conv_id", "turn", "message", "role", F.posexplode(F.when(F.col("role") == "user", typed).otherwise(streamed)).alias("seq", "e"))
    return out.select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "e.event", "role", "e.text")


def _fold(batches):
    key, role, parts, alive = None, "", [], False
    out: list[tuple] = []
    schema = None

    def done():
        if alive:
            out.append((*key, role, "".join(parts)))

    def batch_of():
        cols = list(zip(*out)) or [[], [], [], [], []]
        types = (schema.field(0).type, schema.field(1).type, schema.field(2).type, pa.string(), pa.string())
        got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["conv_id", "turn", "message", "role", "text"])
        out.clear()
        return got

    for batch in batches:
        schema = batch.schema
        for conv, turn, message, _, event, who, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (conv, turn, message) != key:
                done()
                key, role, parts, alive = (conv, turn, message), "", [], False
            text = text or ""
            if event == "open":
                role, parts, alive = who or "", [text], True
            elif event == "delta":
                parts.append(text)
            elif event == "edit":
                parts = [text]
            elif event == "regenerate":
                parts = []
            elif event == "retract":
                alive = False
            else:
                raise ValueError(f"unknown event {event!r}")
        if out:
            yield batch_of()
    done()
    if out:
        yield batch_of()


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, message, role, text) of an event log."""
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    rows = log.selectExpr(*LOG.split(", ")).repartition("conv_id", "turn", "message").sortWithinPartitions("conv_id", "turn", "message", "seq")
    return rows.mapInArrow(_fold, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, message {kinds['message']}, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with formatted, and loss_start and loss_end: the code points of formatted under the loss mask."""
    head = F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    body = escape(F.col("text"))
    out = messages.withColumn("formatted", F.concat(head, body, F.lit(END + "\n")))
    own = F.col("role") == "assistant"
    return out.withColumn("loss_start", F.length(head)).withColumn("loss_end", F.when(own, F.length(head) + F.length(body)).otherwise(F.length(head)))


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digest(batches):
    key, state, first = None, None, True
    schema = None

    def row():
        return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def batch_of(rows):
        types = (schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        schema, rows = batch.schema, []
        for conv, formatted, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if first or conv != key:
                if not first:
                    rows.append(row())
                key, state, first = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], False
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            loss = unescape(formatted[start:end])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(formatted)
        if rows:
            yield batch_of(rows)
    if not first:
        yield batch_of([row()])


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    kind = rendered.schema["conv_id"].dataType.simpleString()
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "message")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
