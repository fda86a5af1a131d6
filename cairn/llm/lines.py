"""Substring dedup by line or paragraph hashing.

Units are normalised and hashed; digests are grouped over the whole corpus; the occurrence in the
earliest-ranked document, and there the first, stays. Repeated units that follow one another make a run;
runs of enough words go, with their offsets in the original text, shorter ones repeat by chance and stay.

Passages also stand inside longer lines, with other words before and after. So a line (or paragraph) is cut
into units after words that their own digest picks, one in CUT on average: wherever a passage stands, it is
cut at the same words, and all of its units but those at its ends are met again. A line repeats if all of
its units do.
"""

from __future__ import annotations

import re
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import hot_join, materialize, read, slices

#: Words of a run that goes, at least. (Of a passage of over 50, the units at both ends may be lost.)
MIN_WORDS = 30
#: A unit ends after a word whose MD5 begins with a byte below 256 / CUT, and after LONGEST words.
CUT, LONGEST = 8, 32
#: So many characters more make a word count once more: long runs without spaces weigh as text does.
WIDE = 24
#: Marks at a word's ends that do not make a unit another one.
EDGES = ".,;:!?\"'()[]{}*_#-"
#: Characters of scripts written without spaces: each is a word.
ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯豈-﫿\U00020000-\U0003ffff"
_WORD = rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+"
#: Words, and what ends a unit.
TOKENS = {"line": re.compile(rf"\n|{_WORD}"), "paragraph": re.compile(rf"\n(?:[ \t]*\n)+|{_WORD}")}
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: Words whose normal form a worker remembers.
KNOWN = 300_000


class Words(dict):
    """By word: its normal form (A-Z lower-cased, no marks at its ends), how often it counts, whether it ends a unit."""

    def __missing__(self, word: str) -> tuple[str, int, bool]:
        form = word.translate(_LOWER).strip(EDGES)
        cut = bool(form) and md5(form.encode("utf-8", "replace")).digest()[0] < 256 // CUT
        found = form, 1 + len(form) // WIDE if form else 0, cut
        if len(self) < KNOWN:
            self[word] = found
        return found


def units(text: str | None, kind: str = "line", known: Words | None = None):
    """(start, end, words, digest) of each unit of the whole text; code points, end exclusive.

    The digest has 64 bits of the normal forms joined by spaces. Words that are marks only count nothing.
    """
    known = Words() if known is None else known
    forms, start, end, words = [], 0, 0, 0
    for m in TOKENS[kind].finditer(text or ""):
        if m[0][0] == "\n":
            form, n, cut = "", 0, True
        else:
            form, n, cut = known[m[0]]
        if form:
            if not forms:
                start = m.start()
            forms.append(form)
            end, words = m.end(), words + n
        if forms and (cut or len(forms) == LONGEST):
            yield start, end, words, blake2b(" ".join(forms).encode("utf-8", "replace"), digest_size=8).digest()
            forms, words = [], 0
    if forms:
        yield start, end, words, blake2b(" ".join(forms).encode("utf-8", "replace"), digest_size=8).digest()


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_units, removed array<struct<start, end>>, removed_words, shared_words) of every row.

    ``removed`` has a span for each run; ``shared_words`` counts those of its words whose first occurrence
    is in another row. Rank is the id; rows without id rank last; of rows that repeat an id, any one is the
    first. Null and empty texts have no units. Copies of a document lose all units but keep their row. Other
    columns are not read; an empty table gives no rows. A digest that holds most units is met by broadcast
    (see hot_join), so no group of occurrences is gathered in one task.
    """
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    names = ["key", "id", "n_units", "digest", "k", "start", "end", "words"]

    def run(batches):
        key, known = TaskContext.get().partitionId() << 33, Words()
        for batch in batches:
            for part in slices(batch):
                found = [list(units(t, kind, known)) for t in part.column(1).to_pylist()]
                d, sizes = len(found), np.array([len(f) for f in found], np.int64)
                keys = key + np.arange(d)
                key += d
                ids, n = part.column(0), int(sizes.sum())
                none = [pa.nulls(d, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids, pa.array(sizes), *none], names=names)
                start, end, words, digest = list(zip(*(u for f in found for u in f), strict=True)) or [(), (), (), ()]
                at = np.repeat(np.arange(d), sizes)
                k = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at]), ids.take(pa.array(at)), pa.nulls(n, pa.int64()), pa.array(np.frombuffer(b"".join(digest), "<i8")), pa.array(k, pa.int32()), *(pa.array(x, pa.int32()) for x in (start, end, words))],
                    names=names,
                )

    schema = f"key long, id {kind_of_id}, n_units long, digest long, k int, start int, end int, words int"
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    every = rows.filter("digest IS NOT NULL")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "k")
    twice = every.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = materialize(twice.select("digest", "n", F.col("first.key").alias("in_key"), F.col("first.k").alias("at_k")))
    found = hot_join(every.select("digest", "key", "k", "start", "end", "words"), twice, "digest", "n", every.count())
    again = found.filter(F.col("in_key").isNotNull() & ((F.col("in_key") != F.col("key")) | (F.col("at_k") != F.col("k"))))
    run_of = F.col("k") - F.row_number().over(Window.partitionBy("key").orderBy("k"))
    shared = F.sum(F.when(F.col("in_key") != F.col("key"), F.col("words")).otherwise(0))
    runs = again.withColumn("run", run_of).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), shared.alias("shared"))
    gone = runs.filter(F.col("words") >= min_words).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"), F.sum("words").alias("removed_words"), F.sum("shared").alias("shared_words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.filter("n_units IS NOT NULL").join(gone, "key", "left").select(
        F.col("id").alias(id_col), "n_units", F.coalesce("removed", none).alias("removed"), count("removed_words"), count("shared_words")
    )


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (one row per id) without the removed spans of ``found``. Columns of any name pass through."""
    text, gone = F.col(text_col), F.col("_cairn_removed")
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["end"]))
    ends = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.length(text)))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), "")
    some = found.filter(F.size("removed") > 0).select(F.col(id_col).alias("_cairn_id"), F.col("removed").alias("_cairn_removed"))
    return docs.join(some, docs[id_col] == some["_cairn_id"], "left").withColumn(text_col, F.when(gone.isNotNull(), left).otherwise(text)).select(*docs.columns)


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Spans of repeated runs as ``start:end``, comma-joined."""
    found = repeated_units(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "removed_words", "shared_words", spans.alias("removed"))


_RE2 = "".join(f"\\x{{{ord(c):x}}}" if ord(c) > 127 else c for c in ALONE)
ORACLE = rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '\n|[{_RE2}]|[^\x20\x09-\x0D{_RE2}]+|[\x20\x09\x0B-\x0D]+') AS parts FROM documents),
t AS (SELECT doc_id, unnest(parts) AS w, generate_subscripts(parts, 1) AS i FROM s),
o AS (SELECT *, COALESCE(SUM(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             CASE WHEN regexp_full_match(w, '[\x20\x09-\x0D]+') THEN '' ELSE trim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()[]{{}}*_#-') END AS form FROM t),
c AS (SELECT *, CASE WHEN w = chr(10) OR (form <> '' AND (md5(form)[1] IN ('0', '1'))) THEN 1 ELSE 0 END AS ends FROM o),
b AS (SELECT *, COALESCE(SUM(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM c),
n AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY doc_id, block ORDER BY i) - 1) // 32 AS piece FROM b WHERE form <> ''),
u AS (SELECT doc_id, block, piece, MIN(off) AS start, MAX(off + length(w)) AS stop, SUM(1 + length(form) // 24) AS words, string_agg(form, ' ' ORDER BY i) AS form
      FROM n GROUP BY doc_id, block, piece),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM u),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY form ORDER BY doc_id, k) AS seen, FIRST_VALUE(doc_id) OVER (PARTITION BY form ORDER BY doc_id, k) AS home FROM k),
r AS (SELECT *, k - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f WHERE seen > 1),
g AS (SELECT doc_id, MIN(start) AS start, MAX(stop) AS stop, SUM(words) AS words, SUM(CASE WHEN home <> doc_id THEN words ELSE 0 END) AS shared FROM r GROUP BY doc_id, run HAVING SUM(words) >= 30),
d AS (SELECT doc_id, COUNT(*) AS n, SUM(words) AS words, SUM(shared) AS shared, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans FROM g GROUP BY doc_id),
m AS (SELECT doc_id, COUNT(*) AS n FROM u GROUP BY doc_id)
SELECT documents.doc_id, COALESCE(m.n, 0)::BIGINT AS n_units, COALESCE(d.n, 0)::BIGINT AS n_removed, COALESCE(d.words, 0)::BIGINT AS removed_words,
       COALESCE(d.shared, 0)::BIGINT AS shared_words, COALESCE(d.spans, '') AS removed
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN m USING (doc_id)
"""
