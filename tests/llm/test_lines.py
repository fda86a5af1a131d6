import hashlib
import random

import duckdb

from cairn.llm import lines
from cairn.llm.common import read

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, removed string, n int, key int"


def plain_units(text):
    """(start, end, words, form) by a walk over the characters."""
    out, forms, at = [], [], 0
    text = text or ""
    while at < len(text):
        c = text[at]
        if c in " \t\r\x0b\x0c":
            at += 1
            continue
        end = at + 1
        if c != "\n" and c not in alone:
            while end < len(text) and text[end] not in " \t\r\n\x0b\x0c" and text[end] not in alone:
                end += 1
        form = "" if c == "\n" else "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[at:end]).strip(".,;:!?\"'()[]{}*_#-")
        if form:
            forms.append((at, end, form))
        last = c == "\n" or (form and hashlib.md5(form.encode()).hexdigest()[0] in "01")
        if forms and (last or len(forms) == 32):
            out.append(forms)
            forms = []
        at = end
    return [(f[0][0], f[-1][1], sum(1 + len(x[2]) // 24 for x in f), " ".join(x[2] for x in f)) for f in out + [forms] * bool(forms)]


class _Alone:
    def __contains__(self, c):
        return any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))


alone = _Alone()


def plain(rows, least=30):
    """By id: the spans of runs of units that an earlier row, or the row before them, has."""
    seen, gone = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        run = []
        for u in [*plain_units(text), None]:
            if u and u[3] in seen:
                run.append(u)
                continue
            if sum(x[2] for x in run) >= least:
                gone.setdefault(i, []).append((run[0][0], run[-1][1]))
            run = []
            if u:
                seen.add(u[3])
    return gone


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    gone = plain(rows)
    got = lines.op6_lines(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = gone.get(r.doc_id, [])
        assert (r.n_removed, r.removed) == (len(want), ",".join(f"{a}:{b}" for a, b in want))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = con.sql(lines.ORACLE)
    assert sorted(twin.fetchall()) == sorted(tuple(r[c] for c in twin.columns) for r in got)


def test_passages_of_over_50_words_are_met_and_clean_texts_left_alone(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) + (rng.choice((".", ".\n", ",", "")) if rng.random() < 0.1 else "") for _ in range(n))
    passages = [text(rng.randint(55, 120)) for _ in range(40)]
    rows = [(i, text(rng.randint(60, 400))) for i in range(400)]
    planted = {}
    for i in range(0, 400, 2):
        p = i // 2 % 40
        own = rows[i][1].split(" ")
        at = rng.randrange(len(own))
        rows[i] = (i, " ".join([*own[:at], passages[p], *own[at:]]))
        planted.setdefault(p, []).append(i)
    got = {r.doc_id: r for r in lines.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = [i for ids in planted.values() for i in ids[1:]]
    assert sum(got[i].shared_words > 0 for i in again) >= 0.9 * len(again)
    clean = [i for i in range(400) if i not in again]
    assert sum(got[i].removed_words == 0 for i in clean) >= 0.99 * len(clean)


def test_nulls_repeats_offsets_and_cut(spark):
    long = " ".join(f"word{i}" for i in range(40)) + "."
    loud = long.upper().replace(" ", "  ")
    rows = [(2, f"é🙂\n{long}\nx", "x", 1, 1), (1, f"{long}\n\n {loud}", "x", 1, 1), (3, None, None, None, None), (4, "", "x", 1, 1), (None, long, "x", 1, 1), (5, long, "x", 1, 1), (5, long, "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lines.repeated_units(df).collect()
    spans = sorted((r.doc_id or 0, [tuple(s) for s in r.removed]) for r in got)
    n = len(long)
    assert spans == [(0, [(0, n)]), (1, [(n + 3, n + 3 + len(loud))]), (2, [(3, 3 + n)]), (3, []), (4, []), (5, [(0, n)]), (5, [(0, n)])]
    assert sorted((r.doc_id or 0, r.removed_words, r.shared_words) for r in got) == [(0, 40, 40), (1, 40, 0), (2, 40, 40), (3, 0, 0), (4, 0, 0), (5, 40, 40), (5, 40, 40)]
    one = df.filter("doc_id IN (1, 2, 3)").withColumnRenamed("key", "_removed")
    cut = lines.cut(one, lines.repeated_units(one))
    assert cut.columns == one.columns
    assert [r.text for r in cut.orderBy("doc_id").collect()] == [f"{long}\n\n ", "é🙂\n\nx", None]
    assert lines.repeated_units(df.limit(0)).collect() == []


def test_units():
    assert [n for _, _, n, _ in plain_units("天地玄")] == [2, 1]
    for kind, text in (("line", "a b\nc d\n\n\ne f 天地玄黄 -- x" + " y" * 100), ("line", "A" * 60 + "\r\n .\n z")):
        assert [(a, b, n) for a, b, n, _ in lines.units(text, kind)] == [(a, b, n) for a, b, n, _ in plain_units(text)]
    text = "q w\nr s\n \ne u"
    assert [text[a:b] for a, b, _, _ in lines.units(text, "paragraph")] == ["q w\nr s", "e u"]
    assert list(lines.units(None)) == list(lines.units(" \n--\n")) == []
