import os
import random

import pyarrow as pa
import pytest

from cairn.llm import common, graph
from cairn.llm.graph import components


def plain(edges):
    label = {}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        label.setdefault(a, a)
        label.setdefault(b, b)
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in label}


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("kind", ["random", "star", "chain", "mixed"])
def test_components_against_union_find(spark, monkeypatch, kind, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "star": [(7, i) for i in range(1000, 3000)] + [(5, 2999)],
        "chain": [(i, i + 1) for i in range(200)],
        "mixed": [(None, 3), (4, None), (5, 5), (-3, 9), (9, 11), (9, 11), (2**60, 11), (40, 41)],
    }[kind]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)


def test_no_edges_no_rows(spark):
    assert components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []


def test_hot_join_against_a_plain_one(spark):
    rows = [(i, 1 if i % 3 else i % 50) for i in range(5000)] + [(9000, None), (9001, 77)]
    left = spark.createDataFrame(rows, "id long, key long")
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    right = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items() if k is not None and k != 77], "key long, n long, v string")
    got = common.hot_join(left, right, "key", "n", len(rows))
    assert {r.id: r.v for r in got.collect()} == {i: None if k in (None, 77) else f"v{k}" for i, k in rows}
    assert got.count() == len(rows)


def test_slices_bound_the_text_and_lose_nothing():
    texts = ["a" * n for n in (0, 5, 900, 3, 2000, 1)] + [None, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    parts = list(common.slices(batch, limit=1000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in parts)


def test_written_tables_are_cleared(spark):
    df = common.materialize(spark.range(10))
    assert df.count() == 10
    path = common._WRITTEN[-1]
    assert os.path.isdir(path)
    assert common.clear(spark) >= 1 and not os.path.exists(path) and common.clear(spark) == 0
