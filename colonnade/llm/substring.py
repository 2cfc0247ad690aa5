"""Removal of long word passages that occur more than once in a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import RK, RK_SQL, cut, map_arrow, numbered
from ._text import Words, binary, grams, slices, sliding

#: Words of the runs among whose hashes each window picks its anchor.
ANCHOR = 8
#: Bits of an anchor's key that hold its place in the piece of text at hand; a text has fewer than 2**31 bytes.
_PLACE = 31
#: Bytes of the BLAKE2b digests by which runs and windows are taken for equal.
DIGEST = 16
_GAPS = re.compile(rb"[ \t-\r]+")
PIECE = 1 << 20


#: Different runs with one anchor that one automaton takes; a run has fewer than 2 * width words.
SHARD_RUNS = 256


class SuffixAutomaton:
    """All substrings of several sequences, each with the number of places where it ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, next_: dict[int, int], length: int, link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _follow(self, p: int, symbol: int) -> int:
        """The state of p's longest string with the symbol behind it, made its own where it shares one."""
        next_, length, link = self.next, self.length, self.link
        q = next_[p][symbol]
        if length[q] == length[p] + 1:
            return q
        own = self._state(dict(next_[q]), length[p] + 1, link[q])
        link[q] = own
        while p >= 0 and next_[p].get(symbol) == q:
            next_[p][symbol] = own
            p = link[p]
        return own

    def add(self, symbols: list[int], weight: int = 1) -> None:
        """One more sequence, which counts weight times."""
        next_, link = self.next, self.link
        last = 0
        for symbol in symbols:
            if symbol in next_[last]:
                last = self._follow(last, symbol)
            else:
                new, p = self._state({}, self.length[last] + 1, 0), last
                while p >= 0 and symbol not in next_[p]:
                    next_[p][symbol] = new
                    p = link[p]
                link[new] = self._follow(p, symbol) if p >= 0 else 0
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Places of a string are places of its suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, symbols: list[int], width: int) -> list[int]:
        """Begins of the windows of width symbols that end at two places or more: matching statistics, kept at width."""
        next_, link, length, count = self.next, self.link, self.length, self.count
        out, state, matched = [], 0, 0
        for i, symbol in enumerate(symbols):
            while state and symbol not in next_[state]:
                state = link[state]
                matched = length[state]
            if symbol in next_[state]:
                state = next_[state][symbol]
                matched += 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if matched >= width and count[state] > 1:
                out.append(i - width + 1)
        return out


class Windows:
    """All windows of `width` words in texts, and digests of their words."""

    def __init__(self, texts: pa.Array, width: int):
        data, offsets = binary(texts)
        words = Words(data, offsets)
        self.width, self.first, self.words = width, words.first, words
        self.bytes, self.at = words.joined()

    def spans(self, begin: np.ndarray, end: np.ndarray) -> list[memoryview]:
        """The words [begin, end), each with a space behind it."""
        view = memoryview(self.bytes)
        return [view[a:b] for a, b in zip(self.at[begin].tolist(), self.at[end].tolist(), strict=True)]

    def digests(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BLAKE2b of the words [begin, end), in two halves."""
        blake = hashlib.blake2b
        both = b"".join([blake(span, digest_size=DIGEST).digest() for span in self.spans(begin, end)])
        both = np.frombuffer(both, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def runs(self) -> tuple[np.ndarray, ...]:
        """Runs of successive windows with one anchor: document, first window, windows, anchor hash, digest of all words (two halves).

        A window's anchor is the least hash among its runs of ANCHOR words, the first of equals; so it depends
        on the window's words alone, and equal windows have equal anchors at equal places.
        """
        none = np.zeros(0, np.int64)
        if len(self.at) - 1 < self.width:
            return (none,) * 6
        g = grams(self.words.hashes(), ANCHOR)
        mask = np.uint64((1 << _PLACE) - 1)
        low = sliding((g & ~mask) | np.arange(len(g), dtype=np.uint64), self.width - ANCHOR + 1, np.minimum)
        anchor = (low & mask).astype(np.int64)
        doc_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(doc_of[self.width - 1 :] == doc_of[: len(anchor)])
        if not len(at):
            return (none,) * 6
        anchor = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(at)))
        first = at[begin]
        return doc_of[first], first - self.first[doc_of[first]], n, g[anchor[begin]].view(np.int64), *self.digests(first, first + n + self.width - 1)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n numbers each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeated_spans(keyed: DataFrame, width: int) -> DataFrame:
    """keyed (rk, text) to (rk, spans): the document's windows, as (first, n), whose words occur elsewhere too.

    Windows with one anchor that follow each other form a run of about (width - ANCHOR) / 2 windows; equal
    windows have one anchor, so runs meet at it.  A run whose words all occur again (equal anchor and BLAKE2b of
    all its words, 128 bits) is repeated as a whole.  Where an anchor has different runs, these are a shard of
    reference text: a suffix automaton is built of their words, each run streams through it, and windows with
    matching statistics of width or more at two places are repeated.  An anchor with more than SHARD_RUNS
    different runs (a common phrase in all sorts of company) is split: its windows are counted by the same
    digest of their words, with map-side sums.  So no task holds more than a bounded group.
    """
    run_schema = pa.schema([("h", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("rk", RK), ("first", pa.int32()), ("n", pa.int32())])
    run_sql = f"h long, r1 long, r2 long, rk {RK_SQL}, first int, n int"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                doc, first, n, h, r1, r2 = Windows(some.column("text"), width).runs()
                yield _batch([h, r1, r2, some.column("rk").take(pa.array(doc)), first, n], run_schema)

    every = cut(map_arrow(keyed, runs, run_sql), "runs")
    # Written, so that both sides of the join are plain tables: the planner can then split the runs of a hot anchor.
    twice = cut(every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "anchors")
    every = cut(every.join(twice, "h", "left_semi"), "runs", every)
    place = F.struct("rk", "first", "n")
    kinds = cut(every.groupBy("h", "r1", "r2").agg(F.count("*").alias("c"), F.any_value(place).alias("one")), "kinds")
    # Written, so that both sides of the join are plain tables: the planner can then split the places of a hot run.
    whole = cut(kinds.where("c > 1").select("h", "r1", "r2"), "whole")
    spans = every.join(whole, ["h", "r1", "r2"], "left_semi").select("rk", "first", "n")
    mixed = kinds.groupBy("h").agg((F.count("*") > SHARD_RUNS).alias("hot"), F.count("*").alias("d")).where("d > 1").drop("d")
    some = kinds.join(mixed, "h").select("one.rk", F.struct("one.first", "one.n", "h", (F.col("c") > 1).alias("twice"), "hot").alias("run"))
    some = some.groupBy("rk").agg(F.collect_list("run").alias("runs"))  # a document's own runs
    asked = keyed.join(some, "rk").select("rk", "text", "runs")
    window_schema = pa.schema([("h", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("rk", RK), ("first", pa.int32()), ("twice", pa.bool_()), ("words", pa.binary())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a run its words, of a hot anchor's run its windows' digests."""
        for batch in batches:
            for some in slices(batch, "text"):
                found = Windows(some.column("text"), width)
                lists = some.column("runs")
                flat = lists.flatten()
                doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                first, n, h = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1, 2))
                twice, hot = (np.asarray(flat.field(k).cast(pa.int8())).astype(bool) for k in (3, 4))
                begin, rk = first + found.first[doc], some.column("rk")
                each = n[hot]
                at = _ranges(begin[hot], each)
                nulls = pa.nulls(len(at), pa.binary())
                yield _batch([np.repeat(h[hot], each), *found.digests(at, at + width), rk.take(pa.array(np.repeat(doc[hot], each))), _ranges(first[hot], each), np.repeat(twice[hot], each), nulls], window_schema)
                nulls = pa.nulls(int((~hot).sum()), pa.int64())
                words = pa.array(found.spans(begin[~hot], (begin + n)[~hot] + width - 1), pa.binary())
                yield _batch([h[~hot], nulls, nulls, rk.take(pa.array(doc[~hot])), first[~hot], twice[~hot], words], window_schema)

    single = cut(map_arrow(asked, windows, f"h long, w1 long, w2 long, rk {RK_SQL}, first int, twice boolean, words binary"), "windows")
    hashed = single.where("words is null").drop("words")
    again = cut(hashed.groupBy("h", "w1", "w2").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("c")).where("c > 1").select("h", "w1", "w2"), "again")
    partly = hashed.where("not twice").join(again, ["h", "w1", "w2"], "left_semi").select("rk", "first", F.lit(1).alias("n"))
    shards = single.where("words is not null").select("h", "rk", "first", "twice", "words").repartition("h").sortWithinPartitions("h")
    match_schema = pa.schema([("rk", RK), ("first", pa.int32()), ("n", pa.int32())])

    def matched(shard: list[tuple]) -> list[tuple[dict, int, int]]:
        automaton = SuffixAutomaton()
        shard = [(rk, first, twice, words.split()) for rk, first, twice, words in shard]
        for _, _, twice, words in shard:
            automaton.add(words, 2 if twice else 1)
        automaton.finish()
        return [(rk, first + k, 1) for rk, first, twice, words in shard if not twice for k in automaton.repeated(words, width)]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, shard, out = None, [], []
        for batch in batches:
            for k in range(0, len(batch), 512):
                for h, *run in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                    if h != anchor:
                        out += matched(shard)
                        anchor, shard = h, []
                    shard.append(run)
                if out:
                    yield _batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), match_schema, strict=True)], match_schema)
                    out = []
        out += matched(shard)
        if out:
            yield _batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), match_schema, strict=True)], match_schema)

    streamed = map_arrow(shards, match, f"rk {RK_SQL}, first int, n int")
    every = spans.unionByName(partly).unionByName(streamed)  # a window comes from one of them alone
    return cut(every.groupBy("rk").agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans")


def covered(n_words: int, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    """Which words are in the windows of the spans."""
    edge = np.zeros(n_words + 1, np.int64)
    for first, n in spans:
        edge[first] += 1
        edge[first + n + width - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """The text cut between words, about `most` bytes at a time."""
    at = 0
    while at < len(text):
        m = _GAPS.search(text, at + most) if len(text) - at > most else None
        to = m.end() if m else len(text)
        yield text[at:to]
        at = to


def remove_repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept, the words that are left, joined by spaces.

    A word goes if it is in a window of width words whose sequence also starts somewhere else, in the same
    document or another; windows are judged on the input.  Words are the longest runs of characters other than
    U+0020 and U+0009 to U+000D, unchanged.  Null and empty texts have no words.  Rows equal in id and text
    are repeats of each other.  Other columns are ignored; an empty table gives no rows.  doc_id is a long.
    """
    base = numbered(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text))
    joined = base.join(repeated_spans(base.select("rk", "text"), width), "rk", "left").select("doc_id", "text", "spans")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] * with_text)]
    schema = pa.schema(fields)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for doc, text, spans in zip(*some.columns, strict=True):
                    text = (text.as_py() or "").encode()
                    gone = None
                    if spans.is_valid:
                        n = sum(len(p.split()) for p in pieces(text))
                        gone = covered(n, [(s["first"], s["n"]) for s in spans.as_py()], width)
                    digest, at, removed, kept = hashlib.sha256(), 0, 0, []
                    glue = b""
                    for piece in pieces(text):
                        words = piece.split()
                        left = words if gone is None else [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
                        at += len(words)
                        removed += len(words) - len(left)
                        if left:
                            piece = glue + b" ".join(left)
                            digest.update(piece)
                            glue = b" "
                            if with_text:
                                kept.append(piece)
                    out.append((doc.as_py(), at, removed, digest.hexdigest(), *([b"".join(kept).decode()] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(joined, clean, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
