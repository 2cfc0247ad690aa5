"""Components against union-find; tables in the shared folder."""

import random

from colonnade.llm import _shared
from colonnade.llm._shared import components, cut


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return sorted((x, find(x)) for x in up)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(500, k) for k in range(501, 560)]
    edges += [(7, 7), (None, 3), (5, 4), (5, 4), (-9, 1000)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == plain(edges)
    assert components(df.limit(0)).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that are stars take no round, a chain of three nodes one: no round is made only to see that nothing changes."""
    written = []
    monkeypatch.setattr(_shared, "cut", lambda df, name, done=None: written.append(name) or cut(df, name, done))
    for edges, rounds in (([(5, 1), (1, 7), (9, 2)], 0), ([(1, 2), (2, 3)], 1)):
        written.clear()
        assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == plain(edges)
        assert written == ["edges"] * (1 + rounds) + ["roots"]


def test_cut(spark):
    df = cut(spark.range(5), "test")
    assert sorted(r.id for r in df.collect()) == list(range(5))
    assert df.inputFiles()
