"""Toxicity by a convolutional text classifier, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ._shared import map_arrow
from ._text import Words, binary, slices

#: A word is looked up whole and by its first bytes; each way has its own buckets.
PREFIXES = (None, 4, 5)
BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word of the texts (words x ways) and each text's range of words.

    Words are lower case, without ASCII punctuation.  Every text begins with a word of its own in bucket 0, so
    that an empty text has one, too.
    """
    data, offsets = binary(pc.utf8_lower(texts))
    words = Words(data, offsets, punctuation=True)
    ways = [(words.hashes(p) >> np.uint64(49)).astype(np.int32) + np.int32(k * BUCKETS) for k, p in enumerate(PREFIXES)]
    ids = np.stack(ways, 1)
    first = words.first + np.arange(len(words.first))
    out = np.empty((len(ids) + len(first) - 1, len(PREFIXES)), np.int32)
    heads = np.zeros(len(out), bool)
    heads[first[:-1]] = True
    out[heads] = np.arange(len(PREFIXES)) * BUCKETS
    out[~heads] = ids
    return out, first


@dataclass
class Network:
    """Embeddings of buckets, filters of several widths with max pooling, and a logistic layer."""

    embedding: np.ndarray  # buckets x channels
    filters: list[np.ndarray]  # for each width: width x channels x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def activations(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Pooled activations (texts x filters), where each maximum stands, and the words' embeddings."""
        words = self.embedding[ids].sum(1)
        pooled, where = [], []
        n = len(words)
        starts, sizes = first[:-1], np.diff(first)
        doc_of = np.repeat(np.arange(len(starts)), sizes)
        for f, b in zip(self.filters, self.biases, strict=True):
            width = len(f)
            conv = np.zeros((n, f.shape[2]), np.float32)
            for j in range(width):
                part = words[j:] @ f[j]
                if j:  # beyond the end of its text a word counts nothing
                    part = part * (doc_of[j:] == doc_of[: n - j])[:, None]
                conv[: n - j] += part
            top = np.maximum.reduceat(conv, starts, axis=0)
            pooled.append(np.maximum(top + b, 0))
            where.append((conv, top))
        return np.concatenate(pooled, 1), where, words

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.activations(ids, first)[0] @ self.weights + self.bias

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * self.logits(ids, first) + self.shift, -40, 40).astype(np.float64)
        return 1 / (1 + np.exp(-z))


def log_odds(batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], strength: float = 3.0) -> np.ndarray:
    """For each bucket the log odds of label 1 among the texts that have it, drawn to the share of label 1 in all.

    batches: (buckets, ranges of words, labels), counted one by one.
    """
    n = len(PREFIXES) * BUCKETS
    ones, all_ = np.zeros(n), np.zeros(n)
    for ids, first, labels in batches:
        doc_of = np.repeat(np.arange(len(labels), dtype=np.int64), np.diff(first))
        seen = np.unique(ids + doc_of[:, None] * n)
        ones += np.bincount(seen % n, labels[seen // n], n)
        all_ += np.bincount(seen % n, minlength=n)
    share = np.clip(np.concatenate([labels for _, _, labels in batches]).mean(), 1e-3, 1 - 1e-3)
    return np.log((ones + strength * share) / (all_ - ones + strength * (1 - share))) - np.log(share / (1 - share))


def logistic(z: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic law of labels given z that fits best (Newton, slightly drawn to zero)."""
    spread = max(float(z.std()), 1e-6)
    x, slope, shift = (z - z.mean()) / spread, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((p - labels) * x).sum() + 1e-2 * slope, (p - labels).sum() + 1e-2 * shift])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(move[0], -2, 2), shift - np.clip(move[1], -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(slope / spread), float(shift - slope * z.mean() / spread)


def auc(z: np.ndarray, labels: np.ndarray) -> float:
    """The chance that a row of label 1 has a greater z than one of label 0; equal ones count half."""
    values, back, counts = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[back]
    ones = labels.sum()
    return float((rank[labels > 0].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones)))


def parts_of(labels: np.ndarray, rng: np.random.Generator, count: int) -> np.ndarray:
    """A number below count for each row, so that each label's rows are spread evenly."""
    out = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        rows = rng.permutation(np.flatnonzero(labels == y))
        out[rows] = np.arange(len(rows)) % count
    return out


def first_tops(conv: np.ndarray, first: np.ndarray, doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The first place of the maximum of conv over each text doc, in the column which."""
    return np.array([first[d] + int(np.argmax(conv[first[d] : first[d + 1], c])) for d, c in zip(doc.tolist(), which.tolist(), strict=True)], np.int64)


#: (buckets, ranges of words, labels) of some texts
Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


def learn(learned: list[Batch], judged: list[Batch], channels: int, filters: int, epochs: int, rate: float, rng: np.random.Generator) -> tuple[Network, int, np.ndarray]:
    """The network, the epochs that it took, and its logits of the judged texts: Adagrad on the logistic loss, each class weighing half.

    The first embedding channel starts at the buckets' log odds, and the first filter of each width reads it;
    everything is then trained together.  After each epoch the judged texts, which take no part in the training,
    tell the area under the curve, and the epoch with the largest (the start is one, too) is the result; three
    worse ones end the training.  Without judged texts all epochs are taken.
    """
    n_buckets = len(PREFIXES) * BUCKETS
    net = Network(
        rng.normal(0, 0.05, (n_buckets, channels)).astype(np.float32),
        [rng.normal(0, 0.2, (w, channels, filters)).astype(np.float32) for w in WIDTHS],
        [np.zeros(filters, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, len(WIDTHS) * filters).astype(np.float32),
    )
    net.embedding[:, 0] = 0.5 * log_odds(learned)
    for f in net.filters:
        f[:, :, 0] = 0
        f[0, 0, 0] = 1
    net.weights[[k * filters for k in range(len(WIDTHS))]] = 1.0 / len(WIDTHS)
    net.bias = -2.0
    share = np.concatenate([told for *_, told in learned]).mean()
    told_apart = np.concatenate([told for *_, told in judged]) if judged else np.zeros(0)
    shapes = [net.embedding, *net.filters, *net.biases, net.weights]
    sums = [np.full_like(x, 1e-2) for x in shapes]
    bias_sum = 1e-2

    def judge(epoch: int) -> tuple:
        z = np.concatenate([net.logits(i, f) for i, f, _ in judged]).astype(np.float64) if judged else told_apart
        return auc(z, told_apart) if judged else float(epoch), epoch, z, [x.copy() for x in shapes], net.bias

    def step(k: int, gradient: np.ndarray, rows=slice(None)) -> None:
        sums[k][rows] += gradient**2
        shapes[k][rows] -= rate * gradient / np.sqrt(sums[k][rows])

    best = judge(0)
    for epoch in range(1, epochs + 1):
        if judged and (best[0] >= 1 or epoch > best[1] + 3):
            break
        for b in rng.permutation(len(learned)):
            ids, first, told = learned[b]
            pooled, where, words = net.activations(ids, first)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.bias, -30, 30)))
            out = ((p - told) * np.where(told > 0, 0.5 / share, 0.5 / (1 - share))).astype(np.float32) / len(told)
            back = out[:, None] * net.weights * (pooled > 0)
            step(len(shapes) - 1, pooled.T @ out)
            bias_sum += out.sum() ** 2
            net.bias -= rate * out.sum() / np.sqrt(bias_sum)
            touched, pushed = [], []
            for w, (conv, top) in enumerate(where):
                f = net.filters[w]
                part = back[:, w * filters : (w + 1) * filters]
                doc, which = np.nonzero(part)
                place = first_tops(conv, first, doc, which)
                g = part[doc, which]
                df = np.zeros_like(f)
                for j in range(len(f)):
                    at = place + j
                    ok = at < first[doc + 1] if len(doc) else np.zeros(0, bool)
                    np.add.at(df[j].T, which[ok], g[ok, None] * words[at[ok]])
                    touched.append(at[ok])
                    pushed.append(g[ok, None] * f[j][:, which[ok]].T)
                step(1 + w, df)
                step(1 + len(net.filters) + w, part.sum(0))
            at, g = np.concatenate(touched), np.concatenate(pushed)
            if len(at):
                rows, back_to = np.unique(ids[at].ravel(), return_inverse=True)
                total = np.zeros((len(rows), channels), np.float32)
                np.add.at(total, back_to.ravel(), np.repeat(g, len(PREFIXES), 0))
                step(0, total, rows)
        now = judge(epoch)
        best = now if now[0] > best[0] else best
    _, epoch, z, shapes, net.bias = best
    net.embedding, net.filters, net.biases, net.weights = shapes[0], shapes[1 : 1 + len(WIDTHS)], shapes[1 + len(WIDTHS) : -1], shapes[-1]
    return net, epoch, z


def train(texts: list[str], labels: np.ndarray, langs: list[str], channels: int = 8, filters: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.02, few: int = 200, seed: int = 0) -> Network:
    """Fit the network, and calibrate it on rows that it hasn't learned from.

    A quarter of each label's rows is kept apart, and learn() judges epochs by it.  Where a label has fewer than
    `few` rows, each quarter is kept apart in turn, and the network is then learned from all rows in as many
    epochs as the four took on average.  The logits of the rows kept apart give the slope and the shift that
    make scores chances, and each language's threshold, that of the fewest errors (0.5 where a language has
    fewer than 10 of either label among them).
    """
    rng = np.random.default_rng(seed)
    if not len(texts) or min(labels.sum(), len(labels) - labels.sum()) < 2:
        none = np.zeros((len(PREFIXES) * BUCKETS, channels), np.float32)
        bias = -1.0 if not len(texts) or labels.mean() < 0.5 else 1.0
        return Network(none, [np.zeros((w, channels, filters), np.float32) for w in WIDTHS], [np.zeros(filters, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * filters, np.float32), bias)
    order = rng.permutation(len(texts))
    texts, labels, langs = [texts[i] for i in order], labels[order].astype(np.float64), np.array([langs[i] or "" for i in order])
    quarter = parts_of(labels, rng, 4)

    def prepare(rows: np.ndarray) -> list[Batch]:
        return [(*features(pa.array([texts[i] for i in rows[k : k + batch]], pa.string())), labels[rows[k : k + batch]]) for k in range(0, len(rows), batch)]

    turns = 1 if min(labels.sum(), len(labels) - labels.sum()) >= few else min(4, int(min(labels.sum(), len(labels) - labels.sum())))
    z, apart, taken = np.zeros(len(labels)), quarter < turns, []
    for turn in range(turns):
        net, epoch, z[quarter == turn] = learn(prepare(np.flatnonzero(quarter != turn)), prepare(np.flatnonzero(quarter == turn)), channels, filters, epochs, rate, rng)
        taken.append(epoch)
    if turns > 1:
        net, _, _ = learn(prepare(np.arange(len(labels))), [], channels, filters, round(np.mean(taken)), rate, rng)
    z, labels, langs = z[apart], labels[apart], langs[apart]
    net.scale, net.shift = logistic(z, labels)
    scores = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -40, 40)))
    for lang in np.unique(langs):
        told = labels[langs == lang]
        if min(told.sum(), len(told) - told.sum()) >= 10:
            net.thresholds[str(lang)] = float(np.clip(break_even(scores[langs == lang], told), 0.2, 0.8))
    return net


def break_even(z: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of its gap."""
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(labels)]) + np.concatenate([np.cumsum((1 - labels)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    return float(z[0] - 1e-6 if k == 0 else z[-1] + 1e-6 if k == len(z) else (z[k - 1] + z[k]) / 2)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, seed: int = 0, **options) -> Network:
    """The network, learned from at most `most` labelled rows, half of each label as far as there are so many.

    The sample is drawn from the labels alone, those with the least hashes of doc_id; rows whose crc32(doc_id)
    mod 5 is 0 are never used.  Its ids, at most `most`, are broadcast to the documents.  Texts of any length
    take part whole.  A null text is an empty one; a null doc_id or label joins nothing; of a doc_id with
    several labels the greatest counts.  Of rows with one doc_id the least text alone is learned from, so no more
    than `most` rows come to the driver, whatever the ids.  Without rows of both labels the network gives one score to all.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rank = F.xxhash64(F.lit(seed), "doc_id")
    drawn = [(row.doc_id, row.toxic) for y in (0, 1) for row in known.where(F.col("toxic") == y).orderBy(rank, "doc_id").limit(most // 2).collect()]
    sample = docs.sparkSession.createDataFrame(drawn, StructType([known.schema["doc_id"], StructField("toxic", IntegerType())]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(F.broadcast(sample), "doc_id")
    taken = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("row")).select("doc_id", "row.*").collect()
    taken.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in taken], np.array([r.toxic for r in taken], np.int64), [r.lang for r in taken], seed=seed, **options)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with score (0 to 1) and threshold (that of the row's language, else 0.5); the score sees the text alone.

    Null and empty texts get the score of no words.  Whole texts are read.  Rows are independent of each other,
    so copies, ties and null keys need no care; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("score", "threshold")]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few MB: buckets x channels
    rows = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                ids, first = features(some.column("text"))
                scores = net.scores(ids, first) if some.num_rows else np.zeros(0)
                columns = [some.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    out = map_arrow(rows, run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    if "lang" not in names:
        return out
    if not net.thresholds:
        return out.withColumn("threshold", F.lit(0.5))
    known = F.create_map(*[F.lit(x) for pair in sorted(net.thresholds.items()) for x in pair])
    return out.withColumn("threshold", F.coalesce(F.try_element_at(known, F.coalesce("lang", F.lit(""))), F.lit(0.5)))
