"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: ``start`` opens a message with its role, ``delta`` adds streamed text to it,
``edit`` replaces its text, ``regenerate`` drops it and all later messages (a new ``start`` follows), ``end`` closes it.
Logs are partitioned by conversation and sorted by sequence number; a fold turns them into the final messages, which a
template renders.  Texts are escaped so that no control string stands inside them, reversibly: a backslash goes into
every ``<|``, and one more into every ``<\\|`` that a text has already.

The rendered text and its loss mask (spans of assistant texts, in code points) can be parsed back.

Conversations are dealt out by a hash of their id and sorted within a task; the fold holds one conversation at a time.

Defined results: null texts and roles are empty; events without a conversation form one conversation whose id is null;
events that share a sequence number are taken in the order of kind, message, role and text, and an event that is delivered
twice, with an equal sequence number and content, counts once; an event for a message that
was never started opens it with an empty role; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"  # BREAK: a line break inside a role
EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def fold(events: Iterable[tuple[str, int, str, str]]) -> list[tuple[str, str]]:
    """Final (role, text) messages of a conversation from its events (kind, message, role, text) in order."""
    roles: dict[int, str] = {}
    texts: dict[int, list[str]] = {}
    for kind, message, role, text in events:
        if kind == "regenerate":
            for later in list(roles)[list(roles).index(message) :] if message in roles else ():
                del roles[later], texts[later]
            continue
        if message not in roles or kind == "start":
            roles.setdefault(message, role)
            texts.setdefault(message, [])
        if kind == "delta":
            texts[message].append(text)
        elif kind == "edit":
            texts[message] = [text]
    return [(roles[m], "".join(texts[m])) for m in roles]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask (escaped assistant texts)."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape(role).replace(chr(10), BREAK)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    return [(unescape(m[1].replace(BREAK, "\n")), unescape(m[2])) for m in _TURN.finditer(formatted)]


def events_of_turns(turns: DataFrame, piece: int = 400) -> DataFrame:
    """The event log of a table of finished turns: for each row a start, its text in deltas of ``piece`` characters, an end.

    Rows are numbered within their conversation by turn, role and text, so that repeated rows are messages of their own.
    """
    from pyspark.sql import Window

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = base.withColumn("message", F.row_number().over(order).cast("long"))
    deltas = F.expr(f"transform(sequence(0, (length(text) - 1) div {piece}), k -> struct('delta' as kind, '' as role, substring(text, k * {piece} + 1, {piece}) as text))")
    log = F.concat(
        F.array(F.struct(F.lit("start").alias("kind"), "role", F.lit("").alias("text"))),
        F.when(F.length("text") > 0, deltas).otherwise(F.expr("cast(array() as array<struct<kind:string,role:string,text:string>>)")),
        F.array(F.struct(F.lit("end").alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))),
    )
    each = numbered.select("conv_id", "message", F.posexplode(log).alias("k", "event"))
    return each.select("conv_id", (F.col("message") * F.lit(2**31).cast("long") + F.col("k")).alias("seq"), F.col("event.kind").alias("kind"), "message", F.col("event.role").alias("role"), F.col("event.text").alias("text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of each conversation of an event log (columns of ``EVENTS``)."""
    parts = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "formatted", "mask"]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def close(conv: int | None, log: list[tuple]) -> None:
            formatted, mask = render(fold(log))
            out.append((conv, formatted, [{"start": a, "end": b} for a, b in mask]))

        held: list[tuple] | None = None
        key = before = None
        for b in batches:
            for event in zip(*[b.column(c).to_pylist() for c in ("conv_id", "seq", "kind", "message", "role", "text")], strict=True):
                conv, seq, kind, message, role, text = event
                if held is not None and conv != key:
                    close(key, held)
                    held = None
                    if len(out) >= 500:
                        yield flush()
                if seq is not None and event == before:
                    continue
                key, before = conv, event
                held = [] if held is None else held
                held.append((kind, message, role or "", text or ""))
        if held is not None:
            close(key, held)
        if out:
            yield flush()

    ordered = events.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq", "kind", "message", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, formatted string, mask array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from formatted conversations."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, mask in zip(*[c.to_pylist() for c in b.columns], strict=True):
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, schema)
