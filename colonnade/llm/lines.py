"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import RK, RK_SQL, cut, drop_finished, map_arrow, numbered

#: Rows of a batch that is given back at once, by bytes of text.
PIECE = 1 << 21


def line_chunks(lines: list[str], divisor: int = 2, window: int = 2, least: int = 2) -> list[tuple[int, int]]:
    """Ranges of lines.

    A rolling hash over the hashes of `window` successive lines ends a chunk where it is divisible by divisor and
    the chunk has `least` lines; so a line put in or taken out moves only the boundaries near it.  A line's hash is
    the first 28 bits of its MD5.  A smaller divisor and window reach more of short passages (see the README).
    """
    out, first, hashes = [], 0, [0] * window
    for i, line in enumerate(lines):
        hashes = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16), *hashes[:-1]]
        ends = i + 1 - first >= least and sum(31**k * h for k, h in enumerate(hashes)) % divisor == 0
        if ends or i == len(lines) - 1:
            out.append((first, i + 1))
            first = i + 1
    return out


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _batches(rows: Iterator[tuple], schema: pa.Schema, width: int) -> Iterator[pa.RecordBatch]:
    """Rows into batches of about PIECE bytes in the column width."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[width]) + 64
        if size >= PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def dedup_lines(docs: DataFrame, divisor: int = 2, doc_id: str = "doc_id", text: str = "text", window: int = 2, least: int = 2) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed (lines), n_chunks_removed, kept (the text that is left).

    Documents are cut into chunks of lines at content-defined boundaries.  A chunk of two lines or more whose
    bytes occur elsewhere too, in any document, stays only where it occurs first (least doc_id, then place).
    A 64-bit hash finds candidates; then the chunks' own bytes are grouped, so a collision removes nothing.
    Null and empty texts have no lines.  A null doc_id comes first.  Rows equal in id and text are documents
    like others: one of them comes first.  Other columns are ignored; an empty table gives no rows.  doc_id is a long.
    """
    base = numbered(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text))
    chunk_schema = pa.schema([("doc_id", pa.int64()), ("rk", RK), ("k", pa.int32()), ("bytes", pa.string())])
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_chunks_removed", pa.int64()), ("kept", pa.string())])

    def chunks(batches):
        def rows():
            for batch in batches:
                for doc, text, rk in zip(*batch.columns, strict=True):
                    lines = _lines(text.as_py())
                    for k, (a, b) in enumerate(line_chunks(lines, divisor, window, least)):
                        if b - a > 1:
                            yield doc.as_py(), rk.as_py(), k, "\n".join(lines[a:b])

        return _batches(rows(), chunk_schema, 3)

    def remove(batches):
        def rows():
            for batch in batches:
                for doc, text, gone in zip(*batch.columns, strict=True):
                    lines, gone = _lines(text.as_py()), set(gone.as_py() or ())
                    if not gone:
                        yield doc.as_py(), len(lines), 0, 0, text.as_py() or ""
                        continue
                    cuts = line_chunks(lines, divisor, window, least)
                    kept = [line for k, (a, b) in enumerate(cuts) if k not in gone for line in lines[a:b]]
                    yield doc.as_py(), len(lines), len(lines) - len(kept), len(gone), "\n".join(kept)

        return _batches(rows(), out_schema, 4)

    chunk = map_arrow(base, chunks, f"doc_id long, rk {RK_SQL}, k int, bytes string").withColumn("h", F.xxhash64("bytes"))
    again = cut(chunk.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "line-hashes")
    # What is joined here grows with the corpus and is never broadcast, so the plan is one at every size.
    again = cut(chunk.join(again.hint("merge"), "h", "left_semi"), "line-chunks", again)
    place = F.struct("doc_id", "rk", "k")
    # Written, so that both sides of the join are plain tables: the planner can then split the rows of a hot chunk.
    groups = cut(again.groupBy("bytes").agg(F.min(place).alias("kept_at"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-groups")
    gone = again.join(groups.hint("merge"), "bytes").where(~place.eqNullSafe(F.col("kept_at")))
    gone = cut(gone.groupBy("rk").agg(F.collect_set("k").alias("gone")), "line-gone", again)
    drop_finished(docs.sparkSession)  # the chunks' shuffle files, before the texts are shuffled
    joined = base.join(gone.hint("merge"), "rk", "left").select("doc_id", "text", "gone")
    return map_arrow(joined, remove, "doc_id long, n_lines long, n_removed long, n_chunks_removed long, kept string")
