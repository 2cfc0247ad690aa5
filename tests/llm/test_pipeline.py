"""The pipeline stage by stage, its queries against SQL, and the entry's guard."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import queries
from colonnade.llm._shared import cut

def distance(item, text):
    """Least edit distance of item to a part of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


ROOT, DATA = Path(__file__).parents[2], "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    exact = duckdb.sql(f"select distinct d.doc_id from '{DATA}/documents.parquet' d, '{DATA}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DATA), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "sharding" or docs.columns == names
    assert len(ids - set(kept["toxicity"])) <= 3 * len(toxic) and len(set(kept["toxicity"]) & toxic) <= 0.5 * len(toxic)
    assert len(set(kept["ngram_jaccard"])) == len(kept["ngram_jaccard"])
    assert not {d for d, in exact} & set(kept["decontamination"])
    assert max(Counter(kept["mixing"]).values()) <= 2
    assert Counter(kept["sharding"]) == Counter(kept["mixing"])
    per = Counter(r.shard for r in docs.select("shard").collect())
    assert max(per.values()) - min(per.values()) <= 1


@needs_data
def test_classes_of_the_pipeline_stage(spark):
    """One document of each class stays, and every class keeps one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    classes = {r.doc_id: r.class_id for r in queries.op4_ngram_jaccard(spark, DATA).collect()}
    kept = [r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, DATA).collect()]
    assert sorted(kept) == sorted(set(classes.values()))


@pytest.fixture(scope="module")
def small(spark, corpus, tmp_path_factory):
    """A folder with labels and a benchmark for the rows of conftest.py."""
    top = tmp_path_factory.mktemp("tables")
    labels = [(d, 1, int(k % 7 == 0)) for k, (d, *_) in enumerate(corpus)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    items = [(0, " ".join(corpus[10][1].split()[:30])), (1, None), (2, ""), (3, "never said anywhere at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, docs, none, small, corpus, name, stage):
    """Nulls, empty and long texts, repeated rows, clashing names, an empty table."""
    out = stage(spark, docs, small)
    rows = out.collect()
    wanted = docs.columns if name != "sharding" else [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert out.columns == wanted
    known = Counter((d, t) for d, t, *_ in corpus)
    got = Counter((r.doc_id, r.text) for r in rows)
    assert set(got) <= set(known) and all(r.row == "row" and r.score == 0.5 for r in rows)
    assert all(got[k] <= known[k] * (2 if name == "mixing" else 1) for k in got)
    if name == "sharding":
        assert got == known
    if name == "decontamination":
        assert set(known) - set(got) == {k for k in known if k[1] == corpus[10][1]}
    assert stage(spark, none, small).count() == 0


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_query(spark, small, corpus):
    rows = queries.op1_mixing(spark, small).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, _, s in corpus:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = plain_targets({s: sizes[s] for s in {r[3] for r in corpus}})
    by_row = Counter((d, size(t), sizes[s], want[s]) for d, t, _, s in corpus)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in rows) == Counter(k[:3] for k in by_row.elements())
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert any(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and sizes[s] == r.source_size for s in sizes)
    of = {(d, size(t)): s for d, t, _, s in corpus}
    for r in rows:
        taken[of[r.doc_id, r["size"]]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + largest[s] for s in want)


def test_mixing_reruns_agree(spark, tmp_path):
    """Over other files, in other orders, on other partitions: the same words are taken, to the last document."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id") % 100))).alias("source"), F.lit("en").alias("lang"),
        F.repeat(F.lit("w "), (1 + F.pmod(F.xxhash64("id"), F.lit(400))).cast("int")).alias("text"),
    )
    runs = []
    for k, parts in enumerate((3, 7)):
        docs.repartition(parts, F.xxhash64(F.lit(k), "doc_id")).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = queries.op1_mixing(spark, f"{tmp_path}/{k}")
        runs.append(out.agg(F.count("*"), F.sum("taken"), F.bit_xor(F.xxhash64("doc_id", "taken", "target"))).first())
    assert runs[0] == runs[1] and runs[0][0] == 30_000


def test_sharding_query(spark, small, corpus):
    rows = queries.op2_sharding(spark, small).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    per = Counter(r.shard for r in rows)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(per[k])) for k in per)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_decontamination_query(spark, small, corpus):
    item = corpus[10][1].split()[:30]
    rows = {(r.doc_id, r.item_id, r.distance) for r in queries.op7_decontamination(spark, small).collect()}
    want = {(d, 0, n) for d, t, *_ in corpus if (n := distance(item, (t or "").lower().split())) <= 6}
    assert rows == want and (corpus[10][0], 0, 0) in rows


def test_toxicity_query(spark, corpus, tmp_path):
    rng = random.Random(1)
    said = [w for c in corpus for w in (c[1] or "").split()[:9]]
    docs, labels = [(None, "vile", "en"), (10_001, None, None), (10_002, "", "en")], [(10_002, 1, 0), (None, 1, 1)]
    for k in range(600):
        toxic = int(k % 3 == 0)
        docs.append((k, " ".join(rng.choice(said) for _ in range(rng.randint(3, 40))) + " vile, nasty" * toxic, rng.choice(["en", "de", None])))
        labels.append((k, 1, toxic))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = []
    for flip in (False, True):  # held-out labels change nothing
        told = [(d, q, 1 - t if flip and d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
        spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        runs.append({r.doc_id: r for r in queries.op8_toxicity(spark, str(tmp_path)).collect()})
    assert runs[0] == runs[1] and set(runs[0]) == {d for d, *_ in docs}
    rows = runs[0].values()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    test = [(runs[0][d], t) for d, _, t in labels if d is not None and runs[0][d].held_out]
    assert len(test) > 90 and sum(r.predicted == t for r, t in test) >= 0.97 * len(test)


def test_entry_raises_slips(tmp_path):
    """An error inside the subpackage isn't taken for its absence."""
    for name in ("colonnade", "__spark_entry__.py", "corpus_pipeline.py"):
        os.system(f"cp -r {ROOT / name} {tmp_path}")
    with open(f"{tmp_path}/colonnade/llm/queries.py", "a") as f:
        f.write("\nfrom colonnade.llm.toxicity import nothing_of_this_name\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "nothing_of_this_name" in said.stderr


def test_entry_without_the_subpackage(tmp_path):
    """What is left still imports and has its queries."""
    for name in ("colonnade", "__spark_entry__.py"):
        os.system(f"cp -r {ROOT / name} {tmp_path}")
    os.system(f"rm -r {tmp_path}/colonnade/llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, any_op, _ = said.stdout.split()
    assert int(count) > 80 and any_op == "False"
