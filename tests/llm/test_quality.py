import random
from collections import Counter

import numpy as np

from cairn.llm import boosting, quality
from cairn.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, quality int, good string, n_words int"


def plain(text):
    text = text or ""
    words = text.translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ")
    words = [w for w in words if w]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    got = {r.doc_id: r for r in quality.op2_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want, r = plain(text), got[i]
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [i for i in labels if not got[i].base_failed]
    assert np.mean([got[i].kept == bool(labels[i]) for i in judged]) > 0.98


def test_statistics_of_odd_texts():
    texts = [None, "", " \n\t", "é é é é", "a b a b a b", "x\n\nx\n x\ny\ry\n", "a b 　", "#*$%&|<>" * 3, "<b> " * 5000]
    s = quality.statistics(texts)
    for k, t in enumerate(texts):
        assert tuple(int(s[n][k]) for n in quality.STATS[:5]) == plain(t)
    assert all(len(v) == 0 for v in quality.statistics([]).values())


def test_monotone_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    trees = boosting.fit(x, y, np.array([1, 0, -1]))
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(rng.normal(size=(50, 1, 3)), 40, 1)
        grid[:, :, f] = np.linspace(-3, 3, 40)
        steps = np.diff(trees.margin(grid.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.7
    assert boosting.fit(x[:0], y[:0], np.zeros(3)).margin(x).shape == (3000,)


def test_nulls_no_labels_and_clashing_columns(spark):
    rng = random.Random(1)
    fine = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    rows = [(1, None, 1, "x", 1), (None, fine, None, None, None), (2, fine, 1, "x", 1), (2, fine, 1, "x", 1), (3, "a b c " * 60, 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    trees = quality.fit(docs, spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int"))
    got = sorted(((r.doc_id or 0, r.base_failed, r.kept) for r in quality.judge(docs, trees).collect()))
    assert got == [(0, False, True), (1, True, False), (2, False, True), (2, False, True), (3, True, False)]
    assert quality.judge(docs.limit(0), trees).collect() == []
