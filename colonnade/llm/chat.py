"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import map_arrow
from ._text import binary, slices

OPEN, AFTER_ROLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: What follows < or [ in a control string.
_TAIL = r"(\||/?s>|/?INST\]|/?SYS>>)"
#: Escaping puts one more backslash between the first character of a control string and the rest.
_CONTROL, _ESCAPED = r"([<\[]\\*)" + _TAIL, r"([<\[]\\*)\\" + _TAIL
_ESCAPED_BYTES = re.compile(_ESCAPED.encode())
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
FORMATTED = "part int, formatted string, n_turns long, loss_starts array<int>, loss_ends array<int>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _CONTROL, r"\1\\\2")


def unescape(text: bytes) -> bytes:
    return _ESCAPED_BYTES.sub(rb"\1\2", text)


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(roles)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(n|\\)", lambda m: b"\n" if m[1] == b"n" else b"\\", unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; each turn's end in it; for each turn the start and end of its content."""
    (role, role_at), (text, text_at) = binary(escape_role(roles)), binary(escape(texts))
    source = np.concatenate([np.frombuffer(OPEN + AFTER_ROLE + CLOSE, np.uint8), role, text])
    n = len(roles)
    begin, length = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    fixed = len(OPEN) + len(AFTER_ROLE) + len(CLOSE)
    for k, (b, m) in enumerate((
        (0, len(OPEN)), (fixed + role_at[:-1], np.diff(role_at)), (len(OPEN), len(AFTER_ROLE)),
        (fixed + len(role) + text_at[:-1], np.diff(text_at)), (len(OPEN) + len(AFTER_ROLE), len(CLOSE)),
    )):
        begin[:, k], length[:, k] = b, m
    ends = np.cumsum(length.ravel())
    out = np.empty(ends[-1] if n else 0, np.uint8)
    out[:] = source[np.repeat(begin.ravel() - (ends - length.ravel()), length.ravel()) + np.arange(len(out))]
    ends = ends.reshape(n, 5)
    return out, ends[:, 4], np.stack([ends[:, 2], ends[:, 3]], 1)


def _changes(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before; nulls are equal."""
    before, after = keys.slice(0, len(keys) - 1), keys.slice(1)
    null = pc.not_equal(before.is_null(), after.is_null())
    return np.asarray(pc.or_(null, pc.fill_null(pc.not_equal(before, after), False)))


def _format(batches: Iterator[pa.RecordBatch], schema: pa.Schema, trained: str, piece: int) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for batch in batches:
        for rows in slices(batch, "text", piece):
            keys = rows.column(0)
            blank = pa.scalar("", rows.column("role").type)
            roles, texts = rows.column("role").fill_null(blank), rows.column("text").fill_null(blank)
            data, ends, content = assemble(roles, texts)
            cuts = [0, *(np.flatnonzero(_changes(keys)) + 1).tolist(), len(rows)]
            loss = np.asarray(pc.fill_null(pc.equal(rows.column("role"), trained), False))
            parts, starts, stops, turns = [], [], [], []
            bounds = np.concatenate([[0], ends[np.array(cuts[1:]) - 1]])
            for a, b, base in zip(cuts, cuts[1:], bounds, strict=False):
                part = part + 1 if (keys[a].as_py(),) == last else 0
                last = (keys[a].as_py(),)
                parts.append(part)
                turns.append(b - a)
                spans = content[a:b][loss[a:b]] - base
                starts.append(spans[:, 0])
                stops.append(spans[:, 1])
            text = pa.StringArray.from_buffers(len(parts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)]
            columns = [keys.take(pa.array(cuts[:-1])), pa.array(parts, pa.int32()), text, pa.array(turns, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", piece: int = 1 << 20) -> DataFrame:
    """Rows (conv_id, part, formatted, n_turns, loss_starts, loss_ends), parts of a conversation in order in one partition.

    A turn becomes <|im_start|>role, a line feed, the text, <|im_end|> and a line feed.  Control strings inside
    texts and roles (<|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>) get a backslash after their first
    character, and those that have some get one more, so unescape() restores every text.  The loss mask is given
    as byte spans of the part that cover the trained role's texts alone.  Segment lengths, offsets and gather
    indices of about piece bytes of text are computed at once, and one preallocated buffer is filled.  A
    conversation longer than that has several parts, so no row grows without bound.  Turns are ordered by
    turn, role, text (nulls first); null text or role is empty; a null conv_id is a conversation of its own.
    Equal rows are turns like others.  Other columns are ignored; an empty table gives no rows.  conv_id may be
    of any atomic type.  A conversation's turns are put in order in one task, which holds a piece at a time and
    spills the rest; so the longest conversation (and all turns without a conv_id) must fit a disk, not memory.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {FORMATTED}"
    string, ints = pa.string(), pa.list_(pa.int32())
    ids = to_arrow_type(kind)
    arrow = pa.schema([("conv_id", ids), ("part", pa.int32()), ("formatted", string), ("n_turns", pa.int64()), ("loss_starts", ints), ("loss_ends", ints)])
    return map_arrow(rows, lambda batches: _format(batches, arrow, trained, piece), schema)


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns (role, text) of a formatted part."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted parts alone: turns and their digest, loss text and its digest, length."""

    def parts(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def digest(batches):
        found = []
        for conv, rows in groupby(parts(batches), key=lambda r: r[0]):
            turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, text, _, starts, ends in rows:
                total += len(text)
                text = text.encode()
                for role, said in read_back(text):
                    turns.update(role + b"\n" + said + b"\n")
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    loss.update(said)
                    chars += len(said.decode())
            found.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=arrow)
                found = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=arrow)

    kind = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = pa.schema(list(zip(names, [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
    return map_arrow(formatted, digest, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
