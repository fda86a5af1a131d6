import numpy as np
import pytest

from cairn.llm import ann
from cairn.llm.common import read

SCHEMA = "vec_id long, embedding array<double>, score string, code int, ids int"


def exact(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    want = {}
    for i, v in queries:
        s = (x * np.array(v, float)).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        want[i] = [(int(ids[j]), float(s[j])) for j in order]
    return want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in read(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    got = {}
    for r in sorted(ann.op1_mih(spark, f"/root/testdata/{sf}").collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    vectors, hits = dict(rows), 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(s == pytest.approx(float(np.dot(np.float64(vectors[q]), np.float64(vectors[v]))), rel=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_pigeonhole_covers_the_radius():
    for m in (1, *ann.CUTS):
        for radius in range(ann.BITS + 1):
            share = ann.shares(radius, m)
            assert sum(s + 1 for s in share) == radius + 1  # one bit more than all shares hold is one over the radius


def test_probing_is_chosen_where_it_meets_few_buckets():
    assert ann.plan(10**9, 110)[0] == 1  # two fifths of the bits: one look at every code
    for n, radius in ((10**6, 20), (10**8, 30), (10**9, 40)):
        m, high, cost = ann.plan(n, radius)
        assert m > 1 and high > 0 and cost < ann.PAYS
    assert ann.plan(10**9, 30)[2] < 0.05


def share_within_radius(vectors, queries):
    """The radius, and the part of all pairs that is compared by floats."""
    x = np.unique(np.array(vectors, float), axis=0)
    codes = ann.Codes(x)
    radius = ann.calibrate(codes, x[np.random.default_rng(0).permutation(len(x))], 20)
    return radius, float((ann.apart(codes.of(np.array(queries, float))[:, None], codes.of(x)[None]) <= radius).mean())


def test_clustered_vectors_are_probed_and_few_are_compared(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 48))
    x = np.repeat(centres, 40, axis=0) + 0.12 * rng.normal(size=(4000, 48))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    radius, share = share_within_radius(x, x[::20])
    assert ann.plan(4000, radius)[0] > 1 and share < 0.05
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = exact(rows, rows[::20]), {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_isotropic_vectors_compare_a_small_share_by_floats(spark):
    x = [r.embedding for r in read(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    radius, share = share_within_radius(x, x[::20])
    assert share < 0.15, (radius, share)


def test_equal_scores_go_to_the_smaller_ids_whatever_their_number(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, *rng.choice([-1.0, 1.0], 11).tolist(), float(i % 7 == 0)]) for i in range(500)]  # few distinct scores
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows, rows[::20])
    got = {}
    for r in sorted(ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    for found in got.values():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_hot_vectors_ties_nulls_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + hot[1:]), (1060, [None, *hot[1:]]), (1080, [1.0]), (None, hot), (1100, [float("inf")] + hot[1:])]
    df = spark.createDataFrame([(i, v, "x", 1, 1) for i, v in rows + odd], SCHEMA)
    got = {}
    for r in sorted(ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == want.keys()
    for q in want:
        if q % 3 == 0:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert len(got[q]) == 20
    few = df.filter("vec_id < 5")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, few.filter("vec_id = 0")).collect())
    assert [v for _, _, v in got] == [v for v, _ in exact(rows[:5], rows[:1])[0]]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
