"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from ._shared import cut, map_arrow, numbered, stored
from ._text import Words, binary, grams, mix64, slices

#: Items and characters of one broadcast block, so it has about half as many words at most; a longer item is a
#: block of its own.  With its search tables a block is some 30 MB at most.  A larger benchmark takes several passes.
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 2000, 2 << 20
#: Bits of the tables of the items' runs of words.
TABLE_BITS = 22


@dataclass
class Sample:
    """Which steps of a walk are sampled for windows of each kind, in order of the steps: the steps, the kinds, the bits' values."""

    steps: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    reach: np.ndarray  # for each kind the steps to take, up to its last sampled one

    @classmethod
    def draw(cls, lengths: np.ndarray, bits: int, walk: int) -> Sample:
        drawn = [np.random.default_rng([int(n), walk]).choice(3 * int(n), min(bits, 3 * int(n)), replace=False) for n in lengths]
        counts = np.array([len(d) for d in drawn], np.int64)
        steps = np.concatenate([*drawn, np.zeros(0, np.int64)]).astype(np.int32)
        kinds = np.repeat(np.arange(len(lengths), dtype=np.int32), counts)
        values = np.concatenate([*(1 << np.arange(n, dtype=np.int32) for n in counts.tolist()), np.zeros(0, np.int32)])
        order = np.argsort(steps, kind="stable")
        return cls(steps[order], kinds[order], values[order], np.array([d.max() + 1 for d in drawn], np.int32))


@dataclass
class Items:
    """A block of benchmark items as word hashes, with what the search needs."""

    ids: list
    words: list[np.ndarray]
    share: float
    recall: float = 0.99
    bits: int = 6

    def __post_init__(self):
        self.lengths = np.array([len(w) for w in self.words])
        self.most = np.floor(self.share * self.lengths).astype(int)  # edits allowed
        self.kinds = np.unique(self.lengths[self.lengths > 0])  # items of one length are of one kind
        self.most_of_kind = np.floor(self.share * self.kinds).astype(int)
        self.kind_of = np.searchsorted(self.kinds, self.lengths)
        self.gram = np.where(self.lengths >= 12, 3, np.where(self.lengths >= 5, 2, 1))
        self.least = np.ones(len(self.words), np.int64)
        self.runs = {}  # by q: a table of the runs' top bits, the runs in order, and their items
        for q in sorted({int(self.gram[i]) for i in np.flatnonzero(self.lengths)}):
            table, listed = np.zeros(1 << TABLE_BITS, bool), []
            for i in np.flatnonzero((self.gram == q) & (self.lengths > 0)):
                runs = grams(self.words[i], q)
                fresh = 1 + int((runs[1:] != runs[:-1]).sum())
                self.least[i] = max(1, fresh - (q + 1) * int(self.most[i]))
                table[(runs >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
                listed.append(np.stack([np.unique(runs), np.full(len(np.unique(runs)), i, np.uint64)]))
            listed = np.concatenate(listed, 1)
            listed = listed[:, np.argsort(listed[0], kind="stable")]
            self.runs[q] = table, listed[0], listed[1].astype(np.int32)
        self.walks = max([repetitions(int(n), int(k), self.bits, self.recall) for n, k in zip(self.kinds, self.most_of_kind, strict=True)], default=0)
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        begins = np.cumsum(self.lengths) - self.lengths
        full = np.flatnonzero(self.lengths > 0)
        kinds = np.searchsorted(self.kinds, self.lengths[full])
        self.samples, self.codes = [], []
        for walk in range(self.walks):
            sample = Sample.draw(self.kinds, self.bits, walk)
            codes = embed(flat, begins[full], self.lengths[full], sample, kinds, walk) | kinds << 32
            order = np.argsort(codes, kind="stable")
            self.samples.append(sample)
            self.codes.append((codes[order], full[order].astype(np.int32)))

    def windows(self, symbols: np.ndarray, first: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that hold enough runs of one item: their begins, and the kind of that item."""
        keys = [np.zeros(0, np.int64)]
        for q, (table, runs, of) in self.runs.items():
            ours = grams(symbols, q)
            at = np.flatnonzero(table[(ours >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            at = at[doc_of[at + q - 1] == doc_of[at]]
            at = at[(at == 0) | (ours[at] != ours[at - 1])]
            low, high = np.searchsorted(runs, ours[at], "left"), np.searchsorted(runs, ours[at], "right")
            n = high - low
            item = of[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            place = np.repeat(at, n)
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            last = np.arange(len(item)) + self.least[item] - 1
            ok = last < len(item)
            to = np.minimum(last, max(len(item) - 1, 0))
            reach = self.lengths[item] - q
            ok &= (item[to] == item) & (doc_of[place[to]] == doc_of[place]) & (place[to] - place <= reach)
            item, place, end, reach = item[ok], place[ok], place[to][ok], reach[ok]
            begin = np.maximum(end - reach, first[doc_of[place]])
            n = place - begin + 1
            begins = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append(np.unique(np.repeat(self.kind_of[item], n) << 40 | begins))
        keys = np.unique(np.concatenate(keys))
        return keys & (1 << 40) - 1, keys >> 40


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's range: lower case, without ASCII punctuation."""
    data, offsets = binary(pc.utf8_lower(texts))
    words = Words(data, offsets, punctuation=True)
    return words.hashes(), words.first


def _step_functions(walk: int, steps: int) -> np.ndarray:
    """For each step of a walk an odd factor; the top bits of a word's hash times it are the step's random functions."""
    seed = np.arange(steps, dtype=np.uint64) + np.uint64(walk * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix64(seed + np.uint64(1)) | np.uint64(1)


def embed(symbols: np.ndarray, begins: np.ndarray, limits: np.ndarray, sample: Sample, kinds: np.ndarray, walk: int) -> np.ndarray:
    """Samples of the CGK embeddings of the windows [begin, begin + limit) of symbols, as numbers.

    A pointer walks over the window.  At each step a random function of walk, step and symbol says whether it
    moves on; another gives the embedding's bit.  Strings at edit distance k meet again after each edit with
    good chance, so their embeddings differ in O(k^2) places.  Behind the window the symbol is 0.
    kinds tells each window's kind, by which its steps are sampled; it walks no further than the last of them.
    """
    if not len(begins):
        return np.zeros(0, np.int64)
    reach = sample.reach[kinds]
    order = np.argsort(-reach, kind="stable")  # windows that are through stand behind those that walk on
    at, stop, kind = begins[order].astype(np.int64), (begins + limits)[order], kinds[order]
    steps = int(reach.max())
    walking = np.searchsorted(-reach[order], -np.arange(steps), "left")
    cuts = np.searchsorted(sample.steps, np.arange(steps + 1))
    padded = np.append(symbols, np.uint64(0))
    code = np.zeros(len(begins), np.int64)
    value = np.zeros(len(sample.reach), np.int64)
    for j, factor in enumerate(_step_functions(walk, steps)):
        m, a, b = walking[j], cuts[j], cuts[j + 1]
        r = padded[np.where(at[:m] < stop[:m], at[:m], len(symbols))] * factor
        if b > a:
            value[sample.kinds[a:b]] = sample.values[a:b]
            code[:m] += value[kind[:m]] * (r >> np.uint64(63)).astype(np.int64)
            value[sample.kinds[a:b]] = 0
        at[:m] += ((r >> np.uint64(62)) & np.uint64(1)).astype(np.int64)
    out = np.empty_like(code)
    out[order] = code
    return out


def repetitions(length: int, edits: int, bits: int, recall: float) -> int:
    """Hash tables that a pair at the edit limit needs to be found with the given chance.

    A word edit throws the walks apart for about six of 3 * length steps; half the bits there differ.
    """
    p = max(0.35, 1 - min(0.5, 3.0 * edits / (3 * length) + 0.02)) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and where that part ends (Sellers)."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def candidates(symbols: np.ndarray, begins: np.ndarray, limits: np.ndarray, kinds: np.ndarray, items: Items) -> np.ndarray:
    """Pairs (item, begin) of windows and items of one length with an equal sample in some walk, as item << 40 | begin."""
    found = []
    for walk in range(items.walks):
        ours = embed(symbols, begins, limits, items.samples[walk], kinds, walk)
        codes, of = items.codes[walk]
        keys = ours | kinds << 32
        low, high = np.searchsorted(codes, keys, "left"), np.searchsorted(codes, keys, "right")
        n = high - low
        if n.any():
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(np.unique(of[pick].astype(np.int64) << 40 | np.repeat(begins, n)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def find(symbols: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Hits (document, item, place of the first word, edit distance), the best of each document and item.

    An edit breaks at most q of an item's runs of q words, and makes at most one more of them equal to the one
    before it.  So a window within k edits keeps all but k * (q + 1) of the item's runs that differ from the
    run before them; windows with fewer runs of any item are passed over without loss.
    """
    n = len(symbols)
    if n == 0 or not len(items.kinds):
        return []
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends_of = first[1:][doc_of]
    windows, kinds = items.windows(symbols, first, doc_of)
    if not len(windows):
        return []
    limits = np.minimum(items.kinds[kinds], ends_of[windows] - windows)
    pairs = candidates(symbols, windows, limits, kinds, items)
    # Candidates of an item that overlap in a document are verified together, up to eight lengths at once.
    best: dict[tuple[int, int], tuple[int, int]] = {}
    runs: list[list[int]] = []
    for key in pairs.tolist():
        item, begin = key >> 40, key & (1 << 40) - 1
        length = items.lengths[item]
        if runs and runs[-1][0] == item and begin - runs[-1][2] <= length and doc_of[begin] == doc_of[runs[-1][1]] and begin - runs[-1][1] < 8 * length:
            runs[-1][2] = begin
        else:
            runs.append([item, begin, begin])
    for item, low, high in runs:
        d, length, most = int(doc_of[low]), int(items.lengths[item]), int(items.most[item])
        a, b = max(low - most, first[d]), min(high + length + most, first[d + 1])
        if np.isin(items.words[item], symbols[a:b]).sum() < length - most:  # each word that is missing costs an edit
            continue
        distance, end = best_match(items.words[item], symbols[a:b])
        if distance <= most:
            place = (distance, int(max(a + end - length, first[d]) - first[d]))
            best[d, item] = min(best.get((d, item), place), place)
    return [(d, item, place, distance) for (d, item), (distance, place) in sorted(best.items())]


def item_blocks(listed: Iterable) -> Iterator[list]:
    """Rows with a text, in lists of ITEMS_PER_BLOCK rows and CHARS_PER_BLOCK characters at most, or of one longer text."""
    block, chars = [], 0
    for row in listed:
        if block and (len(block) == ITEMS_PER_BLOCK or chars + len(row.text) > CHARS_PER_BLOCK):
            yield block
            block, chars = [], 0
        block.append(row)
        chars += len(row.text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99, bits: int = 6, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Rows (doc_id, item_id, place, distance): a passage of the document within share of the item's words in edits.

    Words are compared in lower case without ASCII punctuation; place is the number of the passage's first word,
    about; of several passages the nearest counts.  Every window of an item's length in every whole text, however
    long, is looked at.  Items go to the executors in blocks of bounded size, and documents are passed over once
    for each block; the driver holds one block at a time.  Where there are several, each block's rows are
    written before the next is read.  Null and empty texts and items match nothing.  Copies of a document, also
    rows equal in all, give copies of its rows; equal items are each reported; null ids are kept as they are.
    Ids may be of any atomic type.  Other columns are ignored, whatever their names.  Empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col("text").alias("text"))
    listed = benchmark.select(F.col(item_id).alias("item_id"), F.col("text").alias("text")).where("text is not null").orderBy("item_id", "text")
    kind = listed.schema["item_id"].dataType
    blocks = item_blocks(listed.toLocalIterator())
    block, out = next(blocks, []), None
    while True:
        following = next(blocks, None)
        found, sent = search_block(rows, block, kind, share, recall, bits)
        if out is None and following is None:
            return found
        found = cut(found, "hits")
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
        if following is None:
            return out
        block = following


def search_block(rows: DataFrame, block: list, kind: DataType, share: float, recall: float, bits: int) -> tuple[DataFrame, Broadcast]:
    symbols, first = word_hashes(pa.array([r.text for r in block], pa.string()))
    items = Items([r.item_id for r in block], [symbols[a:b] for a, b in zip(first, first[1:], strict=False)], share, recall, bits)
    sent = rows.sparkSession.sparkContext.broadcast(items)
    names = ["doc_id", "item_id", "place", "distance"]
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("item_id", kind), StructField("place", LongType()), StructField("distance", LongType())])
    item_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            for some in slices(batch, "text"):
                hashes, first = word_hashes(some.column("text"))
                hits = find(hashes, first, items)
                if hits:
                    docs, found, places, distances = zip(*hits, strict=True)
                    columns = [some.column("doc_id").take(pa.array(docs)), pa.array([items.ids[k] for k in found], item_kind), pa.array(places, pa.int64()), pa.array(distances, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(rows, run, schema), sent


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a passage of an item.  Each row is judged by its own text, whatever its doc_id."""
    docs = stored(docs)
    hits = contamination(numbered(docs, text=F.col("text")), benchmark, doc_id="rk", **options)
    hits = cut(hits.select(F.col("doc_id").alias("rk")).distinct(), "contaminated")
    return numbered(docs, row=F.struct(*docs.columns)).join(hits, "rk", "left_anti").select("row.*")
