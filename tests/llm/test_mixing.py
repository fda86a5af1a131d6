import hashlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from cairn.llm import mixing
from cairn.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, size long, source string, positions string, _at int"


def plain(rows):
    """(id, size, source) -> by row (source_size, target, taken), from the definition, in exact numbers."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n or 0 for _, n, t in rows if t == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    left = Fraction(3, 2) * sum(own.values())
    while free:
        part = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if part[s] >= 2 * own[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = Fraction(2 * own[s])
        left -= sum(target[s] for s in over)
        free -= over
    taken, out = Counter(), [None] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.md5((f"|{rows[i][1] or 0}" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or 0))
    for i in order:
        _, n, s = rows[i]
        n = n or 0
        passes = int(target[s] // own[s]) if own[s] else 0
        rest = round(target[s]) - passes * own[s] - taken[s]
        more = max(0, min(n, rest))
        taken[s] += n
        out[i] = (own[s], float(target[s]), passes * n + more)
    return out


def test_whole_table_against_plain_and_sql(spark):
    rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in read(spark, SF, "documents").collect()]
    want = {r[0]: (r[1], *w) for r, w in zip(rows, plain(rows), strict=True)}
    got = mixing.op10_mixing(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        size, whole, target, taken = want[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (size, whole, taken) and r.target == pytest.approx(target, rel=1e-12)
    assert [r.doc_id for r in got] == [r.doc_id for r in mixing.op10_mixing(spark, SF).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = con.sql(mixing.ORACLE)
    key = lambda t: t[0]
    for a, b in zip(sorted((tuple(r[c] for c in twin.columns) for r in got), key=key), sorted(twin.fetchall(), key=key), strict=True):
        assert a == pytest.approx(b, rel=1e-12) if None not in a else a == b


def test_positions_follow_the_schedules(spark):
    df = spark.createDataFrame([(i, 10, "abc"[i % 3]) for i in range(900)], "doc_id long, size long, source string")
    got = mixing.curriculum_mix(df).collect()
    for s, early in (("a", True), ("c", False)):
        at = sorted(p for r in got if r.source == s for p in r.positions)
        assert all(0 <= p <= 1 for p in at)
        # weight 1.5 to 0.5: by the middle 1.25 / 2 of the source's words are out; the other way round for c
        assert sum(p < 0.5 for p in at) / len(at) == pytest.approx(0.625 if early else 0.375, abs=0.02)


def test_nulls_ties_repeats_empty_and_clashing_columns(spark):
    rows = [(1, 5, "a"), (1, 5, "a"), (2, 0, "a"), (3, None, "b"), (None, 4, "b"), (None, 4, "b"), (4, 7, None), (5, 7, None), (6, 1, "c"), (7, 2, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = mixing.curriculum_mix(df).collect()
    pairs = lambda xs: sorted(xs, key=str)
    assert pairs((r.doc_id, r.source, r.source_size, round(r.target, 9), r.taken) for r in got) == pairs((i, s, w[0], round(w[1], 9), w[2]) for (i, _, s), w in zip(rows, plain(rows), strict=True))
    assert all((len(r.positions) > 0) == (r.taken > 0) for r in got)
    assert mixing.curriculum_mix(df.limit(0)).collect() == []


def test_mixed_copies_keep_rows_without_id_and_columns_of_any_name(spark):
    rows = [(None, "one two three", "a", "p", 1), (None, "four five", "a", "p", 2), (1, "six seven eight", "b", "p", 3), (1, "another text of that id", "b", "p", 4), (2, "same", "c", None, 5), (2, "same", "c", None, 5), (3, None, "c", None, 6), (4, "", None, None, 7), (5, "alone here", None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, positions string, size int")
    got = mixing.mixed_copies(df)
    assert got.columns == df.columns
    copies = Counter(tuple(r) for r in got.collect())
    assert copies.keys() == {r for r in rows if r[1]}  # share of 150 %: every source is taken once at least
    words = Counter()
    for r, n in copies.items():
        words[r[2]] += n * len(r[1].split())
    assert words["a"] == 10 and sum(words.values()) >= 1.5 * 16
    assert copies[rows[4]] % 2 == 0
    assert mixing.mixed_copies(df.limit(0)).collect() == []


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    df = spark.createDataFrame([(i, 1, str(i)) for i in range(4)], "doc_id long, size long, source string")
    with pytest.raises(ValueError, match="more than 3"):
        mixing.curriculum_mix(df)
