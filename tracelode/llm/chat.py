r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are
context, and only that reply is trainable.  A turn is written as

    <s>[role]\n text </s>\n        (without the blanks shown here)

with role and text escaped: a backslash is doubled, and a backslash is put
after every ``<``, ``[`` and ``]``.  So no control string can occur inside a text,
and unescaping restores it exactly.  The loss mask of an example is one code
point range, that of the reply's text.

A conversation whose last turn is not an assistant's gets one more example
with an empty mask, so that the output always holds every turn.

Rows are dealt by conversation and sorted on disk; the formatter then streams
turns and holds one conversation's prefix at a time.  Batches are cut by size.

Defined results: turns are ordered by turn (null first), then role and text;
a null text or role is empty; a null conversation id is a conversation of its
own; repeated turns are kept; very long texts are kept whole; an empty table
gives no example; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>\n"
#: Characters of text after which a batch of examples is handed on.
_FLUSH = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\").replace("]", "]\\")


def unescape(text: str) -> str:
    return text.replace("]\\", "]").replace("[\\", "[").replace("<\\", "<").replace("\\\\", "\\")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the range of its text."""
    head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        mid = formatted.index(MIDDLE, at)
        end = formatted.index(CLOSE, mid)
        yield unescape(formatted[at + len(OPEN) : mid]), unescape(formatted[mid + len(MIDDLE) : end])
        at = end + len(CLOSE)


_ROWS = [("target", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]


class _Out:
    """Collects example rows and hands them on in batches of bounded size."""

    def __init__(self, id_type: pa.DataType):
        self.schema = pa.schema([("conv_id", id_type), *_ROWS])
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[3])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def prefix_target_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, target (its turn's number from 0; null: none), n_turns, text, loss_start, loss_end."""
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, parts, n, pending = None, (), [], 0, False
        for b in batches:
            out = out or _Out(b.schema.field(0).type)
            ids, roles, texts = (b.column(k).to_pylist() for k in (0, 2, 3))
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if now != (conv,):
                    if pending:
                        out.add((now[0], None, n, "".join(parts), 0, 0))
                    now, parts, n = (conv,), [], 0
                piece, s, e = format_turn(role, text)
                before = sum(map(len, parts))
                parts = ["".join([*parts, piece])] if role == target_role else [*parts, piece]
                if pending := role != target_role:
                    n += 1
                else:
                    out.add((conv, n, n + 1, parts[0], before + s, before + e))
                    n += 1
                if out.size > _FLUSH:
                    yield out.batch()
        if out:
            if pending:
                out.add((now[0], None, n, "".join(parts), 0, 0))
            yield out.batch()

    return dealt.mapInArrow(run, f"conv_id {kind}, target bigint, n_turns bigint, text string, loss_start bigint, loss_end bigint")


def read_back(examples: DataFrame) -> DataFrame:
    """Digests read from formatted examples, one row per conversation.

    Expects the rows of a conversation together and in order, as
    ``prefix_target_examples`` gives them; holds one example at a time.
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss, n_loss, total = (), "", hashlib.sha256(), 0, 0

        def row(id_type):
            turns, n = hashlib.sha256(), 0
            for role, text in read_turns(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            values = (now[0], n, turns.hexdigest(), n_loss, loss.hexdigest(), total)
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        done, id_type = [], None
        for b in batches:
            id_type = b.schema.field(0).type
            for k in range(b.num_rows):
                conv, _, _, text, start, end = (c[k].as_py() for c in b.columns)
                if now != (conv,):
                    if now:
                        done.append(row(id_type))
                    now, loss, n_loss, total = (conv,), hashlib.sha256(), 0, 0
                trained = unescape(text[start:end])
                loss.update(trained.encode())
                n_loss += len(trained)
                total += len(text)
                last = text
            if len(done) > 1000:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if now:
            done.append(row(id_type))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    return examples.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
