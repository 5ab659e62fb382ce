"""Chat formatting by columnar byte assembly.

Every turn becomes <|turn|>role<|text|>text<|end|>. Control strings inside roles and texts are
broken by a backslash after their first character and backslashes are doubled, so the output
holds exactly the template's own control strings and can be read back. Segment lengths, cumulative
offsets and scatter indices are computed in numpy per Arrow batch; headers and contents are copied
into one preallocated buffer. Turns of a conversation are consecutive rows of a sorted partition
and results are carried from batch to batch, so a conversation of any length needs the memory of
a batch.

Defined cases: a null role or text is empty; rows of equal (conv_id, turn) follow each other by
role and text; a null conv_id is a conversation of its own; an empty table gives an empty result.
Columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_strings, code_points, flat, frugal, ranges, slices
from .staging import partitions

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
#: Broken inside texts besides the template's own: control strings of common chat templates.
FOREIGN = (b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
_CONTROL = re.compile(b"(?s)(?=" + b"|".join(map(re.escape, (TURN, TEXT, END, *FOREIGN))) + b")(.)")
_ESCAPED = re.compile(rb"(?s)\\(.)")


def escape(raw: bytes) -> bytes:
    return _CONTROL.sub(rb"\1\\", raw.replace(b"\\", b"\\\\"))


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def _escaped(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of escaped texts; only texts with something to escape are touched one by one."""
    raw = data.tobytes()
    if b"\\" not in raw and not _CONTROL.search(raw):
        return data, offs
    rows = [escape(raw[i:j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold one segment of each part, in order: one buffer and row offsets."""
    lens = np.stack([np.diff(o) for _, o in parts], axis=1)
    ends = np.cumsum(lens.ravel()).reshape(lens.shape)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (data, offs) in enumerate(parts):
        to = ranges(ends[:, k] - lens[:, k], lens[:, k])
        out[to] = data[: len(to)] if len(data) == len(to) else data[ranges(offs[:-1], lens[:, k])]
    return out, np.concatenate([[0], ends[:, -1]]) if len(ends) else np.zeros(1, np.int64)


def _constant(word: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(word, np.uint8), n), np.arange(n + 1) * len(word)


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per turn, sorted by conversation and turn within partitions: conv_id, turn, formatted,
    and the byte range [loss_start, loss_end) of `formatted` that counts for the loss (empty unless
    the role is loss_role). A conversation's sample is its rows' `formatted`, concatenated."""
    c = conversations
    src = c.select(c[conv_col].alias("conv_id"), c[turn_col].alias("turn"), F.coalesce(c[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(c[text_col].cast("string"), F.lit("")).alias("text"))
    src = src.repartition(partitions(c.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = T.StructType().add(src.schema["conv_id"]).add(src.schema["turn"]).add("formatted", T.StringType()).add("loss_start", T.LongType()).add("loss_end", T.LongType())

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                n = b.num_rows
                role, text = _escaped(*flat(b.column("role"))), _escaped(*flat(b.column("text")))
                data, offs = assemble([_constant(TURN, n), role, _constant(TEXT, n), text, _constant(END, n)])
                counts = np.array([r == loss_role for r in b.column("role").to_pylist()], bool)
                end = np.diff(offs) - len(END)
                start = np.where(counts, end - np.diff(text[1]), end)
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), as_strings(data, offs), pa.array(start), pa.array(end)], names=out.fieldNames())

    return src.mapInArrow(frugal(run), out)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of whole conversations, read from format_turns' output alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Input partitions must be format_turns'."""
    out = T.StructType().add(formatted.schema["conv_id"])
    for name, kind in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())):
        out = out.add(name, kind)
    parse = re.compile(b"(?s)" + re.escape(TURN) + b"(.*?)" + re.escape(TEXT) + b"(.*?)" + re.escape(END))

    def run(batches):
        held = None
        for b in batches:
            rows = []
            data, offs = flat(b.column("formatted"))
            raw, chars = data.tobytes(), code_points(data, offs).tolist()
            cols = zip(b.column("conv_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), chars)
            for conv, i, j, start, end, size in cols:
                if held is None or held[0] != conv:
                    if held:
                        rows.append(_close(held))
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in parse.finditer(raw[i:j]):
                    held[1] += 1
                    held[2].update(unescape(m[1]) + b"\n" + unescape(m[2]) + b"\n")
                if end > start:
                    loss = unescape(raw[i + start : i + end])
                    held[3] += len(loss.decode())
                    held[4].update(loss)
                held[5] += size
            if rows:
                yield _rows(rows, out)
        if held:
            yield _rows([_close(held)], out)

    return formatted.mapInArrow(frugal(run), out)


def _close(held: list) -> tuple:
    return (held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5])


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], names=schema.fieldNames())
