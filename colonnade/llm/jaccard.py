"""Near duplicates by an n-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import RK, RK_SQL, components, cut, map_arrow, numbered, stored
from ._text import Words, binary, gram_ids, grams, mix64, slices

#: MinHash values are compared in BANDS groups of ROWS; a pair at 0.8 shares a band with a chance above 0.99999.
BANDS, ROWS = 32, 5
#: Classes of a block: a hub's classes are compared block against block, never all in one task.
BLOCK = 256
#: Bytes of text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20


def word_digests(words: Words) -> np.ndarray:
    """BLAKE2b, 128 bits as two numbers, of each text's words, each with a space behind it."""
    data, at = words.joined()
    view, ends = memoryview(data), at[words.first].tolist()
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and each text's range of them.

    A text of fewer than n words has one shingle, all its words; one without words has none.
    """
    hashes, first = words.hashes(), words.first
    sizes = np.diff(first)
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    runs = grams(hashes, n)
    inside = doc_of[n - 1 :] == doc_of[: len(runs)] if len(runs) else np.zeros(0, bool)
    owner, values = doc_of[: len(runs)][inside], runs[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    few = np.array([int(grams(hashes[first[d] : first[d + 1]], int(sizes[d]))[0]) for d in short], np.uint64)
    owner, values = np.concatenate([owner, short]), np.concatenate([values, few])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[keep], values[keep]
    return values, np.searchsorted(owner, np.arange(len(sizes) + 1))


def min_hashes(values: np.ndarray, first: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """texts x count MinHash values of 32 bits; a text without shingles gets the largest values."""
    n = len(first) - 1
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    factors = mix64(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    starts = first[:-1][full]
    low, high = 0, 0
    while low < len(full):  # pieces that stay in the processor's cache
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + 16384)))
        end = first[-1] if high == len(full) else starts[high]
        piece, at = values[starts[low] : end], starts[low:high] - starts[low]
        for k, factor in enumerate(factors):
            out[full[low:high], k] = np.minimum.reduceat(((piece * factor) >> np.uint64(32)).astype(np.uint32), at)
        low = high
    return out


def fewest_matches(threshold: float, tolerance: float, count: int = BANDS * ROWS, step: int = 16) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m matches is dropped.

    With a uniform prior, similarity after m matches among n values has the law Beta(m + 1, n - m + 1); a pair
    is dropped when its chance of reaching the threshold is below the tolerance.  That chance is the binomial
    sum of P(X <= m), X of n + 1 trials at the threshold.
    """
    out = []
    for n in range(step, count + 1, step):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def word_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text its distinct word n-grams as numbers in order; two n-grams of these texts have one number just if their words are equal.

    A text of fewer than n words has one n-gram, all its words, which equals that of a text of the same words alone.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(data, offsets)
    ids, first = words.ids(), words.first
    runs = gram_ids(ids, n)
    out: list[np.ndarray] = []
    short: dict[tuple, int] = {}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            few = tuple(ids[a:b].tolist())
            out.append(np.array([-1 - short.setdefault(few, len(short))] if few else [], np.int64))
    return out


def common_counts(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many numbers the sets left[i] and right[j] have in common, for each pair of places.

    Few pairs are intersected one by one.  Many are counted by products of 0/1 matrices (sets x numbers), some
    columns at a time, with at most `most` cells in each matrix.
    """
    numbers = np.unique(np.concatenate(left + right)) if len(i) >= 64 else np.zeros(0, np.int64)
    one_by_one = len(i) * (20 + 0.2 * sum(map(len, left + right)) / (len(left) + len(right)))  # microseconds, about
    if len(i) < 64 or one_by_one <= len(left) * len(right) * len(numbers) / 5000:
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    out = np.zeros(len(i), np.int64)
    places = [[np.searchsorted(numbers, s) for s in side] for side in (left, right)]
    width = max(1, most // max(len(left), len(right)))
    for low in range(0, len(numbers), width):
        sides = []
        for side in places:
            cells = np.zeros((len(side), min(width, len(numbers) - low)), np.float32)
            for k, at in enumerate(side):
                a, b = np.searchsorted(at, [low, low + width])
                cells[k, at[a:b] - low] = 1
            sides.append(cells)
        out += np.rint(sides[0] @ sides[1].T)[i, j].astype(np.int64)
    return out


def open_pairs(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], same: bool, threshold: float, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the MinHash rows a and b (i < j where both sides are one) that Bayesian pruning leaves.

    Rows are compared step by step, all pairs that are left at once, and dropped by the steps of
    fewest_matches(), or at first by the sides' sizes of sets.
    """
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    open_ = small >= threshold * large - 1e-9
    if same:
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    matches, done = np.zeros(len(i), np.int32), 0
    for n, least in steps:
        matches += (a[i, done:n] == b[j, done:n]).sum(1, dtype=np.int32)
        done = n
        left_in = matches >= least
        i, j, matches = i[left_in], j[left_in], matches[left_in]
    return i, j


def hubs_of(classes: DataFrame) -> DataFrame:
    """Rows (cid, rk, copies, bytes, bands) to the stars to compare: (rk, cid, copies, hub, below, blocks).

    A bucket's hub is its least member, and a hub's star holds all members of its buckets.  Two classes are
    compared in the star of the least hub that both have; below lists a class's lesser hubs, by which other
    stars tell.  A star all of whose classes have one lesser hub in common as their least one compares
    nothing, so it is left out: most classes with few partners thus stand in one star alone.  blocks is the
    number of blocks of about BLOCK classes and BLOCK_BYTES of text into which the star is split.
    """
    banded = classes.select("cid", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "buckets")
    # buckets grow with the corpus and are never broadcast, so the plan is one at every size
    stars = banded.join(buckets.hint("merge"), "band").groupBy("cid").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))  # at most one hub for each band
    stars = stars.join(classes.select("cid", "rk", "copies", "bytes"), "cid")
    stars = cut(stars.select("rk", "cid", "copies", "bytes", "hubs", F.explode("hubs").alias("hub")), "stars", buckets)
    least = F.col("hubs")[0]
    useful = stars.groupBy("hub").agg(F.min(least).alias("low"), F.max(least).alias("high"), F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    useful = cut(useful.where("low < high or low = hub").select("hub", blocks.alias("blocks")), "hubs")
    return stars.join(useful, "hub").select("rk", "cid", "copies", "hub", F.filter("hubs", lambda h: h < F.col("hub")).alias("below"), "blocks")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (rk, doc_id, s1, s2), classes (s1, s2, cid, copies, one, first) and, for classes with links, (cid, n_links, root, same).

    Texts of the same words in the same order (128 bits of BLAKE2b over the words, s1 and s2) form a class,
    named cid, a number; one is its row of the least doc_id (null last), then of the least rk, first that doc_id.  n_links counts the documents of other classes at similarity threshold or above, root names the
    component of classes that links join, same the least of the classes with the very same n-grams.

    Candidates come from MinHash bands: the classes of a bucket meet in the star of its hub, see hubs_of().  So
    what is shuffled grows with the classes, also along chains of near texts.  A star is split into blocks of
    about BLOCK classes, compared block against block; only in a star of many classes do texts go to several
    tasks (as many as it has blocks).  No bucket's pairs are emitted.  What the pruning leaves is decided on
    the n-grams' words themselves; hashes only choose candidates.
    """
    base = numbered(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text))
    steps = fewest_matches(threshold, tolerance)
    signed = pa.schema([("rk", RK), ("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bytes", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                data, offsets = binary(some.column("text"))
                words = Words(data, offsets)
                digests = word_digests(words)
                values, first = shingles(words, n)
                size = np.diff(first)
                hashes = min_hashes(values, first).reshape(len(size), BANDS, ROWS)
                keys = np.zeros((len(size), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix64(keys ^ hashes[:, :, r].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
                keys = mix64(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[size > 0].ravel()))
                columns = [some.column("rk").cast(RK), some.column("doc_id").cast(pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(np.diff(offsets)), bands]
                yield pa.RecordBatch.from_arrays(columns, schema=signed)

    signatures = cut(map_arrow(base, sign, f"rk {RK_SQL}, doc_id long, s1 long, s2 long, bytes long, bands array<long>"), "signatures")
    classes = signatures.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk", "bands")).alias("one"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"))
    # Numbered once and for all: the table is written.
    classes = cut(classes.select("s1", "s2", F.col("one.rk").alias("one"), F.col("one.doc_id").alias("first"), "one.bands", "copies", "bytes", F.monotonically_increasing_id().alias("cid")), "classes")
    stars = hubs_of(classes.select("cid", F.col("one").alias("rk"), "copies", "bytes", "bands"))
    stars = cut(stars.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "members")
    # Each class's text goes to the tasks of its stars' pairs of blocks.
    # members grow with the corpus and are never broadcast, so the plan is one at every size
    texts = base.select("rk", "text").join(stars.hint("merge"), "rk").drop("rk")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    texts = texts.select("hub", "low", "high", "block", "cid", "copies", "below", "text")
    texts = texts.repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high", "block", "cid")
    link_schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("up", pa.int64()), ("same", pa.int64())])

    def compare(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        """One pair of blocks: rows (block, cid, copies, below, low, high, text, MinHash values, hashes) to (cid, links, a node that it is joined to, a class with its n-grams)."""
        low, high = rows[0][4], rows[0][5]
        sides = [[r for r in rows if r[0] == block] for block in (low, high)]
        if not (sides[0] and sides[1]):
            return []
        a, b = (np.stack([r[7] for r in side]) for side in sides)
        counts = tuple(np.array([r[8] for r in side]) for side in sides)
        i, j = open_pairs(a, b, counts, low == high, threshold, steps)
        here = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if sides[0][x][3].isdisjoint(sides[1][y][3])]
        i, j = i[here], j[here]
        if not len(i):
            return []
        wanted = [np.unique(x) for x in (i, j)]
        sets = word_sets([sides[0][x][6] for x in wanted[0].tolist()] + [sides[1][y][6] for y in wanted[1].tolist()], n)
        left, right = sets[: len(wanted[0])], sets[len(wanted[0]) :]
        x, y = np.searchsorted(wanted[0], i), np.searchsorted(wanted[1], j)
        common = common_counts(left, right, x, y)
        union = np.array([len(s) for s in left])[x] + np.array([len(s) for s in right])[y] - common
        near = common >= threshold * union - 1e-9
        links: dict[int, int] = {}
        least: dict[int, int] = {}
        same: dict[int, int] = {}
        for x, y, equal in zip(i[near].tolist(), j[near].tolist(), (common == union)[near].tolist(), strict=True):
            x, y = sides[0][x], sides[1][y]
            links[x[1]] = links.get(x[1], 0) + y[2]
            links[y[1]] = links.get(y[1], 0) + x[2]
            x, y = x[1], y[1]
            if equal:
                for c in (x, y):
                    same[c] = min(same.get(c, c), x, y)
            # A forest over the block pair's links (union by least name), so a component's edges stay few.
            while least.get(x, x) != x:
                x = least[x]
            while least.get(y, y) != y:
                y = least[y]
            least[max(x, y)] = min(x, y)
        return [(c, k, least.get(c, c), same.get(c, c)) for c, k in links.items()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups follow each other in a partition; MinHash values are computed for many groups at once."""
        key, held, out = None, [], []
        for batch in batches:
            for some in slices(batch, "text"):
                data, offsets = binary(some.column("text"))
                values, first = shingles(Words(data, offsets), n)
                hashes, sizes = min_hashes(values, first), np.diff(first).tolist()
                columns = [some.column(c).to_pylist() for c in ("hub", "low", "high", "block", "cid", "copies", "below")]
                for k, (hub, low, high, block, cid, copies, below) in enumerate(zip(*columns, strict=True)):
                    if (hub, low, high) != key:
                        out += compare(held) if len(held) > 1 else []
                        key, held = (hub, low, high), []
                    held.append((block, cid, copies, frozenset(below), low, high, data[offsets[k] : offsets[k + 1]].tobytes(), hashes[k].copy(), sizes[k]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=link_schema)
                    out = []
        out += compare(held) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=link_schema)

    verified = cut(map_arrow(texts, verify, "cid long, links long, up long, same long"), "links")
    linked = verified.groupBy("cid").agg(F.sum("links").alias("n_links"), F.min("same").alias("same"))
    roots = components(verified.select("cid", "up"), "cid", "up")
    links = linked.join(roots, F.col("cid") == F.col("node")).select("cid", "n_links", "root", "same")
    return signatures.select("rk", "doc_id", "s1", "s2"), classes.select("s1", "s2", "cid", "copies", "one", "first"), links


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links.

    Two documents are linked when the sets of their word n-grams (white-space words, unchanged) have a Jaccard
    similarity of at least threshold, decided on the words themselves.  class_id is the least doc_id among the documents that chains of links
    join, copy_id the least among those with the same set, n_links the number of documents linked to this one.
    A text of fewer than n words has all its words for its one n-gram; texts without words (null, empty) are
    copies of each other and have no other links.  A null doc_id comes last and is counted like others.  Equal
    rows are documents like others.  Other columns are ignored; an empty table gives no rows.
    """
    rows, classes, links = near_duplicates(docs, n, threshold, doc_id=doc_id, text=text, **options)
    whole = classes.join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid")).withColumn("same", F.coalesce("same", "cid"))
    firsts = whole.groupBy("root").agg(F.min("first").alias("class_id"))
    sames = whole.groupBy("same").agg(F.min("first").alias("copy_id"))
    links_of = (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    # Written, so that both sides of the join are plain tables: the planner can then split a hot class's rows.
    whole = cut(whole.join(firsts, "root").join(sames, "same").select("s1", "s2", "class_id", "copy_id", links_of), "labels")
    return rows.join(whole, ["s1", "s2"]).select("doc_id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class of near duplicates: that of the least doc_id (null last), then of the first such row of the files.

    Documents without words are kept only once, as copies of each other.
    """
    docs = stored(docs)
    _, classes, links = near_duplicates(docs, **options)
    rooted = classes.join(links.select("cid", "root"), "cid", "left").select("one", "first", F.coalesce("root", "cid").alias("root"))
    best = cut(rooted.groupBy("root").agg(F.min_by("one", F.struct(F.col("first").isNull(), "first", "one")).alias("rk")).select("rk"), "kept")
    return numbered(docs, row=F.struct(*docs.columns)).join(best, "rk", "left_semi").select("row.*")
