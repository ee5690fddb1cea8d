"""Components, hot-key joins and block verification against brute force."""

import random

import numpy as np
import pytest

from gaugeworks.llm import components as graph
from gaugeworks.llm import jaccard_join, shared


def brute(links):
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_components_of_random_links(spark, small):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long"), small).collect()}
    want = brute([e for e in links if e[0] != e[1]])
    assert got.keys() == want.keys() and len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len(set(want.values()))
    assert all(want[got[x]] == want[x] for x in got)
    assert graph.components(spark.createDataFrame([], "a long, b long"), small).count() == 0


def test_a_sorted_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    saved = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: (rounds.append(name), saved(df, name))[1])
    chain = spark.range(999).selectExpr("id AS a", "id + 1 AS b")
    got = graph.components(chain, small=8).collect()
    assert len(got) == 1000 and len({x["root"] for x in got}) == 1 and rounds.count("moves") <= 15


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, monkeypatch, how):
    monkeypatch.setattr(shared, "HOT", 10)
    monkeypatch.setattr(shared, "PARTS", 4)
    rows = [(None if i % 11 == 0 else 5 if i % 2 else i % 7, i) for i in range(100)]
    values = [(k, f"v{k}") for k in (0, 1, 2, 5, 9)]
    df = shared.join_hot(spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(values, "k long, v string"), "k", how)
    found = dict(values)
    want = {(k, i, found.get(k)) for k, i in rows if how == "left" or k in found}
    got = [tuple(r) for r in df.select("k", "i", "v").collect()]
    assert len(got) == len(want) and set(got) == want


def test_block_links():
    r = random.Random(2)
    base = [r.sample(range(10**6), 40) for _ in range(3)]
    sets = [np.unique(np.array(b[: 40 - r.randrange(12)] + r.sample(range(10**6), r.randrange(6)), np.uint64)) for b in base for _ in range(8)]
    names = [bytes([i]) for i in range(len(sets))]
    for some in (sets[:1], sets):
        m = np.array([len(s) for s in some])
        got = dict(jaccard_join.block_links(some, m, names[: len(some)], [(i, len(s), names[i], s) for i, s in enumerate(sets)], 80))
        for i, s in enumerate(sets):
            fits = {j for j, o in enumerate(some) if j != i and 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
            assert got[i] in fits if fits else i not in got
