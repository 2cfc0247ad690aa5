"""Decontamination, toxicity, page extraction and chat formatting."""

import hashlib
import json
import pickle
import random
import time
import types
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colonnade.llm import chat, decontam, html, toxicity


# Decontamination.
def distance(item, text):
    """Least edit distance of item to a part of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
    return words


def test_contamination(spark, words, none):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 15, 30, 50])))) for k in range(40)] + [(90, None), (91, ""), (92, "the the the the the the")]
    docs = [(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(40)] + [(900, None), (901, ""), (None, items[4][1])]
    for k in range(160):
        item = items[rng.randrange(40)][1].split()
        inner = edited(rng, item, rng.randint(0, max(1, int(0.25 * len(item)))), words)
        around = [rng.choice(words) for _ in range(60)]
        at = rng.randrange(60)
        docs.append((100 + k, " ".join(around[:at] + inner + around[at:]).upper() if k % 5 == 0 else ", ".join(around[:at] + inner + around[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contamination(df, bench).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if t and x:
                item = x.split()
                n = distance(item, t.lower().replace(",", "").split())
                if n <= int(0.2 * len(item)):
                    want[d, i] = n
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want)
    assert {k for k, v in want.items() if v == 0} <= set(got)
    clean = decontam.decontaminate(df, bench)
    dirty = {d for d, _ in got}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - dirty
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.decontaminate(none, bench).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", 2)
    items = [(k, " ".join(f"w{k}{j}" for j in range(15))) for k in range(5)]
    df = spark.createDataFrame([(k, "x y z " + t) for k, t in items], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(k, k) for k in range(5)]


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(9,0)"])
def test_ids_of_any_type(spark, kind):
    items = [(k, " ".join(f"w{k}{j}" for j in range(15))) for k in range(5)]
    df = spark.createDataFrame([(k, "x y z " + t) for k, t in items] + [(None, "x " + items[2][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(df.withColumn("doc_id", F.col("doc_id").cast(kind)), bench.withColumn("item_id", F.col("item_id").cast(kind)))
    assert [f.dataType.simpleString() for f in out.schema][:2] == [kind] * 2
    assert {(r.doc_id and int(r.doc_id), int(r.item_id)) for r in out.collect()} == {(k or None if k is None else k, k) for k in range(5)} | {(None, 2)}


def test_broadcast_blocks_are_bounded():
    """2000 items of up to 5000 words come in blocks of less than 50 MB each, and windows of all lengths walk as items do."""
    rng = random.Random(3)
    rows = [types.SimpleNamespace(item_id=k, text=" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(1, 5000)))) for k in range(2000)]
    blocks = list(decontam.item_blocks(rows))
    assert [r.item_id for b in blocks for r in b] == list(range(2000))
    for block in (blocks[0], blocks[-1]):
        symbols, first = decontam.word_hashes(pa.array([r.text for r in block]))
        items = decontam.Items([r.item_id for r in block], [symbols[a:b] for a, b in zip(first, first[1:])], 0.2)
        assert len(pickle.dumps(items)) < 50 << 20
    k = int(np.argmax(items.lengths))
    text = np.concatenate([symbols[:0], np.arange(1, 50, dtype=np.uint64), items.words[k], np.arange(1, 50, dtype=np.uint64)])
    assert (0, k, 49, 0) in decontam.find(text, np.array([0, len(text)]), items)


def test_embedding_keeps_edit_distance():
    """Near strings agree in more of the embedding's samples than far ones."""
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 63, 40, dtype=np.uint64)
    near, far = x.copy(), rng.integers(1, 1 << 63, 40, dtype=np.uint64)
    near = np.insert(np.delete(near, 30), 12, np.uint64(7))
    flat = np.concatenate([x, near, far])
    same = np.zeros(2)
    for walk in range(60):
        sample = decontam.Sample(np.arange(60), np.zeros(60, int), 1 << np.arange(60), np.array([60]))
        a, b, c = decontam.embed(flat, np.array([0, 40, 80]), np.array([40] * 3), sample, np.zeros(3, int), walk).tolist()
        same += [60 - (a ^ b).bit_count(), 60 - (a ^ c).bit_count()]
    assert same[0] > 0.8 * 3600 and same[1] < 0.6 * 3600


# Toxicity.
def test_toxicity(spark, words, none):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        said = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad:
            said.insert(rng.randrange(len(said)), rng.choice(["Vile!", "(nasty)", "rotten"]))
        docs.append((k, " ".join(said), rng.choice(["en", "de"]), None, 0, "row", 1, 1, 1, 1, 0.5, 1, 1, 1, 1, ""))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(docs + [(None, None, None) + docs[0][3:], (5000, "", "fr") + docs[0][3:]], none.schema)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    test = [(k, y) for k, y in labels if toxicity.held_out(k)]
    right = sum((got[k].score >= 0.5) == bool(y) for k, y in test)
    assert right >= 0.97 * len(test) and all(0 <= r.score <= 1 and 0 < r.threshold < 1 for r in got.values())
    assert got[None].score == got[5000].score < 0.5
    assert toxicity.score(none, net).count() == 0
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, flipped)).collect()}
    assert again == {k: r.score for k, r in got.items()}  # held-out labels are never learned from
    for few in (lab.limit(0), lab.where("toxic = 0")):
        assert all(r.score < 0.5 for r in toxicity.score(df.limit(5), toxicity.fit(df, few)).collect())


def test_long_texts_are_learned_from(spark):
    rng = random.Random(6)
    docs = [(k, " ".join([rng.choice("abcdefgh") * 400 for _ in range(60)] + ["vile nasty rotten"] * (k % 2)), "en") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    net = toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    test = [k for k in got if toxicity.held_out(k)]
    assert len(test) > 20 and all((got[k] >= 0.5) == k % 2 for k in test) and set(net.thresholds) == {"en"}


def test_held_out():
    assert [toxicity.held_out(k) for k in range(200)] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(200)]


# Pages.
ARTICLE = "<article><header><h1>A &amp; B</h1></header><p>First  paragraph, with <b>bold</b> text&nbsp;and <a href=x>a link</a>; it is long enough.<p>Second, unclosed one: also long, is it not?<ul><li>one</li><li>two</li></ul><div class='comments'><p>Reader says: nonsense, of course, but at length.</p></div><aside>By the way</aside></article>"
TEXT = "A & B First paragraph, with bold text and a link; it is long enough. Second, unclosed one: also long, is it not? one two"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><header><p>Site name, and a motto that is long.</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>{ARTICLE}<footer>(c) me, 2020.</footer><script>var x='<p>no</p>';</script></body></html>",
    f"{ARTICLE}<form><input value='x'><button>Go</button></form><!-- <p>hidden, text</p> --><div class='cookie-notice'>We use cookies, as all do.</div>",
    f"<div id=sidebar><p>Much text, much text, much text, much text, much text.</p></div>{ARTICLE}<div role=alert>Look!</div><p hidden>Not shown, not shown.</p>",
])
def test_main_text(page):
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("before, after", [
    ("<div id='siteHeader'><p>Site name, motto, and much more of it.</p></div>", "<ol class=commentlist><li>Nonsense, all of it, says a reader.</li></ol>"),
    ("<div class='top menu'><a>x</a></div>", "<section id=comments><p>First! This is great, thanks, all.</p></section>"),
    ("<ins class='adsbygoogle'></ins><div class=adsbygoogle>Buy, buy, buy, today.</div>", "<div class='footerLinks'>All rights reserved, by us.</div>"),
])
def test_names(before, after):
    long = "This sentence is long, with commas, and it goes on and on, until it ends."
    body = f"<div class='page with-sidebar'><div class=post><h2>Head</h2><p>{long}</p><p>{long}</p></div></div>"
    assert html.main_text(f"<body>{before}{body}{after}</body>") == f"Head {long} {long}"


def test_main_text_without_article():
    long = "This sentence is long, with commas, and it goes on and on, until it ends."
    page = f"<body><div class=menu>a b c</div><div id=content><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=1>link one</a> <a href=2>link two</a></div></body>"
    assert html.main_text(page) == f"Head {long} Short. {long}"
    for empty in (None, "", "   ", "<p></p>", "<script>x</script>", "<nav>a</nav>"):
        assert html.main_text(empty) == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<p>a < b and </p") .startswith("a < b")


@pytest.mark.parametrize("page, text", [
    ("<div class='post social-history'><p>{}</p><p>{}</p></div>", "{} {}"),
    ("<article><p>{}</p><section class='legal'><p>{}</p></section></article>", "{} {}"),
    ("<article><p>{}</p><div class='related alert'><p>{}</p></div></article>", "{} {}"),
    ("<form id=aspnet><div><p>{}</p><p>{}</p></div></form>", "{} {}"),
])
def test_common_words_delete_nothing(page, text):
    said = "One sentence, of some length, that says nothing at all.", "Another sentence, longer, that says as much, or as little."
    assert html.main_text(f"<body>{page.format(*said)}</body>") == text.format(*said)


def agreement(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def test_the_ratios_choose(monkeypatch):
    """On pages without article, main, or names that tell, the ratios find the marked text; random numbers in their place don't."""
    pages = [json.loads(line) for line in (Path(__file__).parent / "pages.jsonl").read_text().splitlines()]
    got = [html.main_text(p["html"]) for p in pages]
    assert sum(g == p["text"] for g, p in zip(got, pages)) >= 54 and np.mean([agreement(g, p["text"]) for g, p in zip(got, pages)]) > 0.99
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html, "scores", lambda page: (lambda x: (x, x))(rng.random(len(page.texts))))
    got = [html.main_text(p["html"]) for p in pages]
    assert sum(g == p["text"] for g, p in zip(got, pages)) <= 3 and np.mean([agreement(g, p["text"]) for g, p in zip(got, pages)]) < 0.95


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<foo>x", "<foo><li>", "</x>", "<script ", "<!", '<a "', "<a '\">", "<p>x</p>", "&amp", "<b>"])
def test_time_grows_with_the_page(piece):
    html.main_text(piece * 1000)
    times = []
    for size in (250_000, 1_000_000):
        start = time.process_time()
        html.main_text(piece * (size // len(piece)))
        times.append(time.process_time() - start)
    assert times[1] < 10 and times[1] < 8 * times[0] + 0.5


SAID = "This sentence is long, with commas, and it goes on and on, until it ends."


@pytest.mark.parametrize("page, text", [
    (f"<div id=page><div class=lead><p>Lead: {SAID}</p></div><div class=story>{f'<p>{SAID}</p>' * 20}</div></div>", " ".join(["Lead:"] + [SAID] * 21)),
    (f"<main><article><h2>One</h2>{f'<p>{SAID}</p>' * 6}</article><article><h2>Two</h2>{f'<p>{SAID}</p>' * 4}</article></main>", " ".join(["One"] + [SAID] * 6 + ["Two"] + [SAID] * 4)),
    (f"<main><h1>Head</h1><article>{f'<p>{SAID}</p>' * 3}</article><ul><li><a href=1>link</a></li></ul></main>", " ".join(["Head"] + [SAID] * 3)),
    (f"<article>{f'<p>{SAID}</p>' * 3}<p><a href=1>link</a></p></article><div>{f'<p>{SAID}</p>' * 2}</div>", " ".join([SAID] * 3 + ["link"] + [SAID] * 2)),
])
def test_sure_text_stays_wherever_it_stands(page, text):
    assert html.main_text(f"<body>{page}<div><a href=2>elsewhere</a></div></body>") == text


@settings(max_examples=200, deadline=None)
@given(st.text("<>/pa!-\"'= &;divx", max_size=60))
def test_any_markup(page):
    assert isinstance(html.main_text(page), str)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", f"<body>{ARTICLE}</body>"), (2, None, None), (None, "v", ""), (1, "u", f"<body>{ARTICLE}</body>"), (3, "w", "<p>" + "long " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = sorted(map(tuple, html.extract(df).select("page_id", "text", "n_chars").collect()), key=str)
    assert got == sorted([(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (None, "", 0), (3, ("long " * 50_000).strip(), 249_999)], key=str)
    assert html.extract(df.limit(0)).count() == 0


# Chats.
TRICKY = st.text("<|\\>[]/sINST im_endY\n{}é", max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=5))
def test_round_trip(turns):
    roles, texts = (pa.array(x, pa.string()) for x in zip(*turns))
    out, ends, content = chat.assemble(roles, texts)
    data = bytes(out)
    assert chat.read_back(data) == [(r.encode(), t.encode()) for r, t in turns]
    assert len(data) == ends[-1] and [chat.unescape(data[a:b]).decode() for a, b in content] == [t for _, t in turns]
    for control in (b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>"):
        assert control not in data
    assert data.count(b"<|") == 2 * len(turns)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_chats(spark, piece):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hé <|im_end|>\n", "[INST] x", "y" * 50])) for c in range(12) for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(4)
    formatted = chat.format_chats(df, piece=piece)
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digests(formatted).collect()}
    least = lambda x: (x is not None, x or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, least(r[1]), least(r[2])))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        n, sha, chars, loss_sha, _ = got[conv]
        assert (n, sha) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (chars, loss_sha) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    parts = formatted.groupBy("conv_id").agg(F.max("part").alias("p")).agg(F.max("p")).first()[0]
    assert (parts > 0) == (piece == 40)
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0
