"""Deduplication operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colonnade.llm import exact, jaccard, lines, substring
from colonnade.llm.exact import exact_duplicates, radix_groups
from colonnade.llm.jaccard import jaccard_classes, keep_one
from colonnade.llm.lines import dedup_lines, line_chunks
from colonnade.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact(docs, none, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    want = Counter()
    for d, t, *_ in corpus:
        keep = min(groups[norm(t)])[2]
        want[d, keep, len(groups[norm(t)]), keep == d, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_duplicates(docs).collect())) == want
    assert exact_duplicates(none).count() == 0


def test_exact_plan_is_one_at_every_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"{k % 3} {'x' * 100}") for k in range(7)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/rows")
    kinds, out = joins(exact, exact_duplicates, spark.read.parquet(f"file://{tmp_path}/rows"), monkeypatch)
    assert set(kinds) == {"SortMerge"}
    assert sorted((r.keep_id, r.group_size) for r in out.collect()) == [(0, 3)] * 3 + [(1, 2)] * 2 + [(2, 2)] * 2


def test_radix_digits(spark):
    """Short digits, so that keys end at, before and after digits' ends and share long prefixes."""
    keys = ["", "", "a", "ab", "ab", "abc", "abcd", "abcd", "abcdabcdabcdabcdx", "abcdabcdabcdabcdx", "abcdabcdabcdabcdy", "abcdabcdabcdabcd"]
    df = spark.createDataFrame([(k, k, 1, bytearray(x.encode())) for k, x in enumerate(keys)], "rk long, doc_id long, n int, key binary")
    groups = defaultdict(set)
    for r in radix_groups(df, 2, 2).collect():
        groups[r.gid].add(r.rk)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [3, 4], [6, 7], [8, 9]]


def test_lines(spark, docs, none, corpus):
    rows = [(1000 + k, "\n".join(f"line {i}" for i in range(k % 3, 20 + k % 5))) for k in range(12)] + [(1099, "line 1"), (1098, "\n\n\n"), (1097, None), (1096, "\n\n\n")]
    rows += [(d, t) for d, t, *_ in corpus if d is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for d, t in sorted(rows):
        lines = t.split("\n") if t else []
        for k, (a, b) in enumerate(line_chunks(lines)):
            if b - a > 1:
                first.setdefault("\n".join(lines[a:b]), (d, k))
    want = {}
    for d, t in rows:
        lines = t.split("\n") if t else []
        parts = ["\n".join(lines[a:b]) for k, (a, b) in enumerate(line_chunks(lines)) if b - a < 2 or first["\n".join(lines[a:b])] == (d, k)]
        want[d] = (len(lines), "\n".join(parts))
    got = {r.doc_id: (r.n_lines, r.kept) for r in dedup_lines(df).collect()}
    assert got == want and sum(r.n_removed for r in dedup_lines(df).collect()) > 20
    assert dedup_lines(docs).count() == len(corpus)
    assert dedup_lines(none).count() == 0


def joins(module, operator, docs, monkeypatch):
    """How many joins of each kind the operator plans, in the tables that it writes and in its result."""
    plans, cut = [], module.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(module, "cut", lambda df, *more: plan(df) or cut(df, *more))
    out = operator(docs)
    plan(out)
    return Counter(re.findall(r"(Broadcast|SortMerge|Shuffled|Nested)\w*Join", "\n".join(plans))), out


def test_lines_plan_is_one_at_every_size(spark, tmp_path, monkeypatch):
    """Nothing that grows with the corpus is broadcast, even when it is small."""
    spark.createDataFrame([(k, "\n".join(f"line {i}" for i in range(30))) for k in range(4)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/rows")
    kinds, out = joins(lines, dedup_lines, spark.read.parquet(f"file://{tmp_path}/rows"), monkeypatch)
    assert kinds == {"SortMerge": 3}
    assert sorted(r.n_removed > 0 for r in out.collect()) == [False, True, True, True]


def test_chunk_boundaries_shift():
    lines = [f"text {k}" for k in range(200)]
    whole = {tuple(lines[a:b]) for a, b in line_chunks(lines)}
    more = lines[:50] + ["new"] + lines[50:]
    assert len(whole - {tuple(more[a:b]) for a, b in line_chunks(more)}) <= 4
    assert line_chunks([]) == [] and line_chunks(["a"]) == [(0, 1)]


SPARSE = {"divisor": 4, "window": 3, "least": 1}


def test_chunks_reach_most_of_passages(spark):
    """The share of the lines that brute force finds in runs seen before, with the chunks of the query and sparser ones."""
    rng = np.random.default_rng(4)
    texts = []
    for n in (5, 10, 20):
        for p in range(40):
            passage = [f"passage {n} {p} {k}" for k in range(n)]
            texts += ["\n".join([f"line {x}" for x in rng.integers(0, 1 << 60, 8)] + passage + [f"line {x}" for x in rng.integers(0, 1 << 60, 8)]) for _ in range(2)]
    seen, repeated = set(), 0
    for t in texts:
        pairs = list(zip(t.split("\n"), t.split("\n")[1:]))
        again = [p in seen for p in pairs]
        repeated += sum(a or b for a, b in zip([False, *again], [*again, False]))
        seen.update(pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = [dedup_lines(df, **how).agg(F.sum("n_removed")).first()[0] for how in (SPARSE, {})]
    assert repeated == 40 * (5 + 10 + 20)
    assert removed[1] >= 0.58 * repeated > 0.5 * repeated > removed[0]
    assert all(b - a > 1 for t in texts for a, b in line_chunks(t.split("\n"))[:-1])


def plain_removal(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=25), st.integers(1, 2)), max_size=5), st.integers(1, 6))
def test_automaton(parts, width):
    automaton, seen = substring.SuffixAutomaton(), Counter()
    for symbols, weight in parts:
        automaton.add(symbols, weight)
        seen.update(Counter(tuple(symbols[k : k + width]) for k in range(len(symbols) - width + 1) for _ in range(weight)))
    automaton.finish()
    for symbols, _ in [*parts, ([0, 1, 2, 0, 1, 9, 1, 0, 0], 1)]:
        assert automaton.repeated(symbols, width) == [k for k in range(len(symbols) - width + 1) if seen[tuple(symbols[k : k + width])] > 1]


@pytest.mark.parametrize("width, runs", [(10, 256), (35, 256), (10, 2), (35, 1)])
def test_substring(docs, none, corpus, width, runs, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_RUNS", runs)
    want = Counter((d, *x) for (d, *_), x in zip(corpus, plain_removal([t for _, t, *_ in corpus], width)))
    assert Counter(map(tuple, remove_repeats(docs, width).collect())) == want
    assert sum(x[2] * n for x, n in want.items()) > 1000
    assert remove_repeats(none, width).count() == 0


@pytest.mark.parametrize("runs", [256, 2])
def test_substring_overlaps(spark, runs, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_RUNS", runs)
    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 3, rng.integers(0, 60)))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: x for k, x in enumerate(plain_removal(texts, 12))}
    assert {r[0]: tuple(r)[1:] for r in remove_repeats(df, 12).collect()} == want


def plain_links(corpus, n=5, threshold=0.8):
    sets = []
    for _, t, *_ in corpus:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sets, links, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(docs, none, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    _, links, roots = plain_links(corpus)
    least = defaultdict(list)
    for (d, *_), r in zip(corpus, roots):
        least[r].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    want = Counter((d, least[r], n) for (d, *_), r, n in zip(corpus, roots, links))
    got = jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert max(n for *_, n in want) >= 7
    kept = keep_one(docs).collect()
    assert len(kept) == len(set(roots)) and set(kept[0].asDict()) == set(docs.columns)
    assert {r.doc_id for r in kept} >= {d for d in least.values() if d is not None}
    assert jaccard_classes(none).count() == 0 and keep_one(none).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """Few pairs at exactly the threshold are pruned; far pairs go early."""
    rng = np.random.default_rng(3)
    steps = jaccard.fewest_matches(0.8, 1e-6)
    signs = lambda sets: jaccard.min_hashes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]).astype(np.int64))
    sizes = lambda *sides: tuple(np.array([len(s) for s in side]) for side in sides)
    kept = 0
    for _ in range(150):
        x = np.unique(rng.integers(0, 1 << 62, 180, dtype=np.uint64))
        a, b = np.sort(x[:162]), np.sort(x[18:])[:162]
        left, right = [a], [np.sort(np.concatenate([a[:144], b[-18:]]))]
        kept += len(jaccard.open_pairs(signs(left), signs(right), sizes(left, right), False, 0.8, steps)[0])
    assert kept == 150
    far = np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = [far, far + np.uint64(1)]
    assert len(jaccard.open_pairs(signs(sets), signs(sets), sizes(sets, sets), True, 0.8, steps)[0]) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=6), st.integers(1, 5))
def test_word_sets(texts, n):
    """Numbers of n-grams tell n-grams apart as the words themselves do, and counts of common ones agree both ways."""
    plain = []
    for t in texts:
        w = t.split()
        plain.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    sets = jaccard.word_sets([t.encode() for t in texts], n)
    pairs = np.array([(a, b) for a in range(len(texts)) for b in range(len(texts))])
    want = [len(plain[a] & plain[b]) for a, b in pairs.tolist()]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    assert jaccard.common_counts(sets, sets, *pairs.T).tolist() == want
    many = np.repeat(pairs, 9, 0)
    assert jaccard.common_counts(sets, sets, *many.T, most=8).tolist() == np.repeat(want, 9).tolist()


def test_common_counts_by_matrix():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, 200)) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i.tolist(), j.tolist())]
    assert jaccard.common_counts(sets, sets, i, j, most=1000).tolist() == want


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_words_that_collide_modulo_powers_of_two(spark, length):
    """Two texts differ in one word alone, of which a polynomial hash modulo 2**64 can't tell the two apart."""
    one, other = thue_morse(length)
    said = [f"word{k}" for k in range(17)]
    df = spark.createDataFrame([(1, " ".join([*said, one, *said])), (2, " ".join([*said, other, *said]))], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, f"a b c {one}"), (2, f"a b c {other}"), (3, f"a b c {one}")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard_classes(df).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 2, 0), 3: (1, 1, 1)}
    assert keep_one(df).count() == 2


@pytest.mark.parametrize("stored", [False, True])
def test_rows_of_one_hash(spark, tmp_path, stored):
    """The xxhash64 of (doc_id, text) is one for the first two rows."""
    df = spark.createDataFrame([(1, "abcdefgh"), (3262, "^~&AWl+$"), (3, "abcdefgh")], "doc_id long, text string")
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    assert keys[1] == keys[3262]
    if stored:
        df.write.parquet(f"file://{tmp_path}/rows")
        df = spark.read.parquet(f"file://{tmp_path}/rows")
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()} == {1: (1, 2, True), 3: (1, 2, False), 3262: (3262, 1, True)}
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [1, 3262]
    assert {r.doc_id: r.copy_id for r in jaccard_classes(df).collect()} == {1: 1, 3: 1, 3262: 3262}
    assert dedup_lines(df).count() == remove_repeats(df).count() == 3


def test_copies_are_sets(spark):
    """Texts with the same five-word runs in another order are copies, too."""
    cycle = [f"w{k}" for k in range(6)]
    once, moved = " ".join(cycle * 3), " ".join((cycle * 4)[2:20])
    df = spark.createDataFrame([(5, once), (4, moved), (9, once), (7, "w0 w1 w2")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard_classes(df).collect()}
    assert got == {5: (4, 4, 2), 4: (4, 4, 2), 9: (4, 4, 2), 7: (7, 7, 0)}


def test_chain_of_near_texts(spark):
    """A chain of texts, each near to the next: what goes to the comparisons grows with the chain."""
    def stars(links, step=12, size=120):
        rows = [(k, " ".join(f"w{w}" for w in range(k * step, k * step + size))) for k in range(links)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sent = []
        plain = jaccard.hubs_of

        def counted(*args):
            out = plain(*args)
            sent.append(out.agg(F.sum("blocks")).first()[0])
            return out

        jaccard.hubs_of = counted
        try:
            got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(df).collect()}
        finally:
            jaccard.hubs_of = plain
        assert got == {k: (0, (k > 0) + (k < links - 1)) for k in range(links)}
        return sent[0] / links

    short, long = stars(300), stars(3000)
    assert long <= 1.3 * short and long < 12


def test_repeated_rows_are_documents(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.n_links, r.class_id) for r in jaccard_classes(df).collect()} == {(1, 2, 1), (2, 2, 1)}
    assert keep_one(df.withColumn("copies", F.lit(1))).count() == 1
