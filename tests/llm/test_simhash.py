import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.llm.common import read

SCHEMA = "doc_id long, text string, fp string, mask int, n int"


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], radius=4):
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= radius):
            a, b = sorted((root(i), root(ids[k + 1 + int(j)])))
            label[b] = a
    return {i: root(i) for i in ids}


def test_whole_table_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


@pytest.mark.parametrize("part", [2048, 40])
def test_links_of_planted_fingerprints(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(5)
    x = [rng.getrandbits(64) for _ in range(60)]
    x += [v ^ sum(1 << b for b in rng.sample(range(64), rng.choice((3, 4, 5)))) for v in x]
    base = rng.getrandbits(64)
    x += [base ^ rng.getrandbits(9) for _ in range(200)]
    prints = {i: v for i, v in enumerate(dict.fromkeys(x))}
    df = spark.createDataFrame([(simhash.signed(v), i) for i, v in prints.items()], "fp long, node long")
    from cairn.llm.graph import components

    found = {r.node: r.component for r in components(simhash.links(df, 4)).collect()}
    assert {i: found.get(i, i) for i in prints} == plain_components(prints)


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    rows = [(5, None, "x", 1, 1), (3, "", "x", 1, 1), (9, " \t\n", None, None, None), (1, "One two", "x", 1, 1), (2, "one\ttwo", "x", 1, 1), (2, "one\ttwo", "x", 1, 1), (None, "ONE TWO", "x", 1, 1), (None, "alone here and now yes", "x", 1, 1)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (2, 1), (None, 1), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_at_similarity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], [], []
    for k in range(40):
        base = [word() for _ in range(400)]
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, " ".join(base)))
        light, heavy = base[:], base[:]
        for i in rng.sample(range(400), 3):
            light[i] = word()
        for i in rng.sample(range(400), 60):
            heavy[i] = word()
        rows += [(10 * k + 2, " ".join(light)), (10 * k + 3, " ".join(heavy))]
        near.append(10 * k + 2)
        far.append(10 * k + 3)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * k for k in range(40)} <= kept and not {10 * k + 1 for k in range(40)} & kept
    assert len(kept & set(near)) <= 1 and len(kept & set(far)) == 40


def test_keep_one_nulls_and_repeats(spark):
    text = "one two three four five six seven"
    rows = [(4, text, "x", 1, 1), (4, text, "x", 1, 1), (2, None, None, None, None), (3, "", "x", 1, 1), (None, "other words here now and then", "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0 for r in simhash.keep_one(df).collect())) == [0, 2, 4]
    more = spark.createDataFrame([(7, text, "x", 1, 1), (7, "quite another text than the other one", "x", 1, 1), (None, text.upper(), "x", 1, 1), (None, "words without id that stand twice", "x", 1, 1), (None, "words without id that stand twice", "x", 1, 1)], SCHEMA)
    assert sorted(((r.doc_id or 0, r.text[:5]) for r in simhash.keep_one(more).collect())) == [(0, "words"), (7, "one t"), (7, "quite")]
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).collect() == []


def plain_kept(texts: dict[int, str | None]):
    """Ids that stay by exact Jaccard similarity of five-word shingles, over all pairs that share one."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {b""}
    owners, group = {}, {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sorted(sets):
        both = {}
        for s in sets[i]:
            for j in owners.setdefault(s, []):
                both[j] = both.get(j, 0) + 1
            owners[s].append(i)
        for j, n in both.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i for i in sets if root(i) == i}


@pytest.mark.parametrize(("group", "paired"), [(128, 64), (7, 64), (7, 2)])
def test_keep_one_decides_by_exact_similarity(spark, monkeypatch, group, paired):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = {}
    for k in range(30):  # 400 shingles; 44 new words leave 356 of 444 (0.802), 46 leave 354 of 446 (0.794)
        base = [word() for _ in range(404)]
        texts |= {10 * k: " ".join(base), 10 * k + 1: " ".join(base[:-44] + [word() for _ in range(44)]), 10 * k + 2: " ".join([word() for _ in range(46)] + base[46:])}
    chain = [word() for _ in range(404)]
    for k in range(40):  # a row of sets, each like the next only
        texts[1000 + k] = " ".join(chain)
        chain = chain[30:] + [word() for _ in range(30)]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_kept(texts) == {i for k in range(30) for i in (10 * k, 10 * k + 2)} | {1000}


def test_keep_one_of_a_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == plain_kept(texts)
