import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import lm
from cairn.llm.common import read
from cairn.llm.gru import Gru, Lanes, Shape

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, token string, n int, score string"


def check(got, rows):
    learn = Counter(t for i, text in rows for t in lm.tokens(text) if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2)
    n, v = sum(learn.values()), len(learn)
    texts = {}
    for i, text in rows:
        texts.setdefault(i, []).append(text)
    assert len(got) == len(rows)
    for r in got:
        own = lm.tokens(texts[r.doc_id][0])
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(learn[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(log10((learn[t] + 1) / (n + v + 1)) for t in own), rel=1e-9, abs=1e-9)
        assert np.isfinite(r.score) and r.score < 0


def test_whole_table_and_held_out_likelihood(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3000)
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = lm.op8_lm(spark, SF).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (None, "One two\tone", None, None, None), (3, "one Two é", "x", 1, "y"), (3, "one Two é", "x", 1, "y"), (8, "word " * 3000, "x", 1, "y")]
    check(lm.fit_and_score(spark.createDataFrame(rows, SCHEMA)).collect(), [r[:2] for r in rows])
    assert lm.fit_and_score(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_class(token):
    band = (len(token) > 4) + (len(token) > 7) + (len(token) > 11)
    wide = [c for c in token if c > 127][:2]
    return 4 * (1 + sum(wide) % 3) + band if wide else band


def test_split_and_classes_against_plain_ones():
    texts = [None, "", " \t\n", "One  two\x0bthree\n", "é Été ÀB日本語\u3000x \x1cy", "a" * 5000, "word"] * 3
    column = pa.array(["out of sight", *texts]).slice(1)
    found, sizes = lm.split(column)
    want = [lm.tokens(t) for t in texts]
    assert sizes.tolist() == list(map(len, want)) and found.to_pylist() == [t for own in want for t in own]
    assert lm.rare_classes(found).tolist() == [plain_class(t) for t in found.to_pylist()]
    assert lm.rare_classes(found.slice(3, 9)).tolist() == [plain_class(t) for t in found.slice(3, 9).to_pylist()]
    assert lm.rare_classes(found.slice(0, 0)).tolist() == []


def network(seed=0):
    rng = np.random.default_rng(seed)
    shape = Shape(3, 4, 2, 5)
    g = Gru.new(shape, rng.integers(1, 50, 14).astype(float))
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64) + 0.3 * rng.normal(size=g.p[k].shape)
    sizes = np.array([7, 3, 11, 1, 45])
    want = rng.integers(0, 14, sizes.sum())
    return g, *lm._lanes(want, sizes, shape), sizes


def test_gradients_against_differences():
    g, given, want, fresh, _, _ = network()
    sizes = np.array([7, 3, 11, 1, 5])
    n = sizes.sum()
    given, want, fresh, lanes = lm._lanes(want[:n], sizes, g.shape)
    found, rng = {}, np.random.default_rng(1)
    g._step = lambda grads, n, rate: found.update(grads)
    g.train(given, want, fresh.astype(float), lanes)
    total = lambda: g.score(given, want, fresh, lanes).sum()
    for k, p in g.p.items():
        for _ in range(5):
            i = tuple(int(rng.integers(0, d)) for d in p.shape)
            was, e = p[i], 1e-5
            p[i] = was + e
            up = total()
            p[i] = was - e
            down, p[i] = total(), was
            rows = found["x"]
            ours = found[k][i] if k != "x" else rows[1][list(rows[0]).index(i[0])][i[1]] if i[0] in rows[0] else 0.0
            assert (up - down) / 2 / e == pytest.approx(ours, rel=1e-3, abs=1e-4)


def test_what_steps_work_on_lies_together(monkeypatch):
    # Short rows cut out of wider ones cost several times as much as an array in one piece.
    apart, seen = [], []
    for name in ("tanh", "subtract"):

        def spied(*args, f=getattr(np, name), name=name, **more):
            seen.append(name)
            apart.extend(x.shape for x in (*args, more.get("out")) if isinstance(x, np.ndarray) and not x.flags.c_contiguous)
            return f(*args, **more)

        monkeypatch.setattr(np, name, spied)
    g, given, want, fresh, lanes, _ = network()
    g.train(given, want, fresh, lanes)
    g.score(given, want, fresh, lanes)
    assert set(seen) == {"tanh", "subtract"}
    assert not apart


def test_state_is_carried_across_windows_and_documents_do_not_mix():
    g, given, want, fresh, lanes, sizes = network()
    together = g.score(given, want, fresh, lanes)
    at = 0
    for n in sizes:
        alone = g.score(given[at : at + n], want[at : at + n], fresh[at : at + n], Lanes.pack(np.array([n])))
        assert np.allclose(together[at : at + n], alone)
        h, x, u = np.zeros(5), g.p["x"], g.p["u"]
        for k in range(at, at + n):  # one step at a time, from the definition
            a, b = x[given[k]], h @ u
            r, z = 1 / (1 + np.exp(-(a[:5] + b[:5]))), 1 / (1 + np.exp(-(a[5:10] + b[5:10])))
            h = (1 - z) * np.tanh(a[10:] + r * b[10:]) + z * h
            e = np.exp(h @ g.p["wc"] + g.p["bc"])
            c = want[k] // 4 if want[k] < 12 else want[k] - 12 + 3
            p = e[c] / e.sum()
            if want[k] < 12:
                e = np.exp(h @ g.p["ww"][c] + g.p["bw"][c])
                p *= e[want[k] % 4] / e.sum()
            assert together[k] == pytest.approx(np.log(p), abs=1e-5)
        at += n
