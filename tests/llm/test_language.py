from collections import Counter
from math import exp, log

import numpy as np
import pytest

from cairn.llm import language
from cairn.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, declared string, host string, prior int, n int"


def plain(rows, learn, langs):
    """(predicted, posterior) of each (text, declared, host), from the definition."""
    def grams(text):
        raw = (text or "").encode().lower()
        return [(int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 2)]

    def cls(lang):
        return None if lang in (None, "und") else langs.index(lang) if lang in langs else langs.index("und") if "und" in langs else None

    counts = np.full((len(langs), 1 << 15), 0.5)
    for text, lang in learn:
        if cls(lang) is not None:
            np.add.at(counts[cls(lang)], grams(text), 1)
    model = np.log(counts / counts.sum(1, keepdims=True))
    domain = lambda h: ".".join(h.split(".")[-2:])
    keys = lambda h: (("all",), ("suffix", h.split(".")[-1]), ("domain", domain(h)), ("host", h))
    told = {}
    for _, declared, host in rows:
        if cls(declared) is not None:
            for key in keys(host or ""):
                told.setdefault(key, Counter())[cls(declared)] += 1
    out = []
    for text, declared, host in rows:
        g, k, said = grams(text), cls(declared), cls(language.SUFFIXES.get((host or "").split(".")[-1]))
        said = None if said is not None and langs[said] == "und" else said
        logs = []
        for i in range(len(langs)):
            score = model[i][g].sum() * min(1, 200 / max(len(g), 1))
            for right, value in ((0.9, k), (0.7, said)):
                score += 0 if value is None else log(right if value == i else (1 - right) / max(1, len(langs) - 1))
            for level, key in enumerate(keys(host or "")):
                c = told.get(key, Counter())
                x, n = c[i] - (k == i), sum(c.values()) - (k is not None)
                p = (x + 1) / (n + len(langs)) if level == 0 else (x + 20 * p) / (n + 20)
            logs.append(score + log(p))
        best = int(np.argmax(logs))
        out.append((langs[best], 1 / sum(exp(x - logs[best]) for x in logs)))
    return out


def test_against_the_definition(spark):
    docs = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "documents").select("text", "lang").collect()]
    pages = [tuple(r) for r in language.page_rows(read(spark, SF, "pages")).limit(100).select("text", "declared", "host").collect()]
    rows = [(i, t, d, h) for i, (t, d, h) in enumerate([*((t, d, f"src{i % 7}") for i, (t, d) in enumerate(docs)), *pages, ("kurz", "nn", "x.de"), (None, None, None)])]
    learn = spark.createDataFrame(docs, "text string, lang string")
    langs = language.languages(learn)
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string"), language.fit(learn, langs), langs, ["doc_id"]).collect()
    want = plain([r[1:] for r in rows], docs, langs)
    assert len(got) == len(rows)
    for r in got:
        assert r.predicted == want[r.doc_id][0] and r.posterior == pytest.approx(want[r.doc_id][1], abs=1e-6) and r.kept == (r.posterior >= 0.5)


def test_rare_languages_are_classes_and_the_rest_is_no_other_language(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = {lang: "".join(chr(97 + int(c)) for c in rng.permutation(26)[:7]) for lang in ("aa", "bb", "cc", "dd", "ee")}
    say = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(40))
    often = {"aa": 300, "bb": 280, "cc": 3, "dd": 2, "ee": 2}
    docs = [(say(lang), lang) for lang, n in often.items() for _ in range(n)]
    learn = spark.createDataFrame([*docs, ("x y z", None), ("x y z", "und")], "text string, lang string")
    asked = [(i, say(lang), None, None) for i, lang in enumerate(often)]
    df = spark.createDataFrame(asked, "doc_id long, text string, declared string, host string")
    for most, want in ((255, list(often)), (3, ["aa", "bb", "cc", "und", "und"])):
        monkeypatch.setattr(language, "LANGUAGES", most)
        langs = language.languages(learn)
        assert langs == sorted(set(want) - {"und"}) + ["und"] * ("und" in want)
        model = language.fit(learn, langs)
        assert [r.predicted for r in language.identify(df, model, langs, ["doc_id"]).orderBy("doc_id").collect()] == want
        told = spark.createDataFrame([(1, None, "dd", "h", 1, 1), (2, None, None, "h", 1, 1)], SCHEMA)
        assert {r.predicted for r in language.identify(told, model, langs, ["doc_id"]).filter("doc_id = 1").collect()} == {"dd" if most == 255 else "und"}


def test_whole_tables(spark):
    got = language.op4_language(spark, SF).collect()
    docs, pages = [r for r in got if r.page_id is None], [r for r in got if r.doc_id is None]
    assert len(docs) == read(spark, SF, "documents").count() and len(pages) == read(spark, SF, "pages").count()
    assert all(r.kept for r in docs)
    assert np.mean([r.predicted == r.declared for r in pages]) > 0.9


def test_text_alone_is_right_on_held_out_documents(spark):
    docs = read(spark, SF, "documents")
    learn, held = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    langs = language.languages(learn)
    assert langs == ["de", "en", "es", "fr"]
    rows = held.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS declared", "CAST(NULL AS STRING) AS host")
    truth = {r.doc_id: r.lang for r in held.collect()}
    got = language.identify(rows, language.fit(learn, langs), langs, ["doc_id"]).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95


def test_evidence_without_text(spark):
    langs, model = ["de", "fr"], np.zeros((2, language.BUCKETS))
    rows = [(1, None, "de", "a.com", 1, 1), (2, "", None, "b.fr", 1, 1), (3, "x", None, None, None, None), (None, "xyz", "nn", "a.com", 1, 1)]
    rows += [(10 + k, None, "fr", "h.org", 1, 1) for k in range(60)] + [(200 + k, None, "de", "z.xyz", 1, 1) for k in range(60)]
    rows += [(99, None, None, "h.org", 1, 1), (98, None, None, "i.org", 1, 1), (97, None, "fr", "lone.info", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.identify(df, model, langs, ["doc_id"]).collect()}
    assert [got[k].predicted for k in (1, 2, 97, 98, 99)] == ["de", "fr", "fr", "fr", "fr"]
    assert got[99].posterior > got[98].posterior > 0.5
    assert got[97].posterior == pytest.approx(0.9, abs=0.01)  # its own declaration is evidence, but no prior
    assert language.identify(df.limit(0), model, langs, ["doc_id"]).collect() == []
    assert {r.kept for r in language.identify(df, model[:0], [], ["doc_id"]).collect()} == {False}
