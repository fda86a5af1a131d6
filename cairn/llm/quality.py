"""Quality rules: document statistics, fixed base rules, and boosted trees over the statistics.

The statistics are computed batch by batch from whole texts. The trees learn from a bounded sample of the
labelled documents (by hash of the id) and are flattened into node arrays that score batches at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import boosting
from cairn.llm.common import hash_sample, materialize, read, slices, with_fields

#: Fixed by the contract.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled documents that the trees learn from, at most.
SAMPLE_ROWS = 20_000
#: A document is kept if the trees give it at least this chance of being good.
KEEP = 0.5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: Features and how the chance of being good may move along each: more symbols, repeats and shouting never help.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0, "marks": -1, "distinct": 0}


def repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By document, the words that lie in some 3-word window which the document has twice or more."""
    if len(ids) < 3:
        return np.zeros(n_docs, np.int64)
    size = int(ids.max()) + 1
    pair = pd.factorize(ids[:-1] * size + ids[1:])[0].astype(np.int64)
    window = pd.factorize(pair[:-1] * size + ids[2:])[0].astype(np.int64)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    key = pd.factorize(window[inside] * n_docs + doc[inside])[0]
    many = inside[np.bincount(key)[key] > 1] if len(key) else inside
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[many + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The STATS of every text. Null is taken as empty."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    hist = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raw]) if n else np.zeros((0, 256), np.int64)
    split = [r.split() for r in raw]
    n_words = np.fromiter(map(len, split), np.int64, n)
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), n_words)
    lines = [[x for x in r.split(b"\n") if x.strip(SPACES)] for r in raw]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    chars = hist.sum(1) - hist[:, 0x80:0xC0].sum(1)
    distinct = np.bincount(np.unique(doc * (len(coded.dictionary) + 1) + ids) // (len(coded.dictionary) + 1), minlength=n)
    return {
        "n_words": n_words,
        "word_chars": chars - hist[:, list(SPACES)].sum(1),
        "n_symbols": hist[:, list(SYMBOLS)].sum(1),
        "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, n),
        "n_repeat_words": repeated(ids, doc, n),
        "n_chars": chars,
        "n_lines": n_lines,
        "n_upper": hist[:, 65:91].sum(1),
        "n_digits": hist[:, 48:58].sum(1),
        "n_marks": hist[:, list(b"!?")].sum(1),
        "n_distinct": distinct,
    }


def features(s) -> np.ndarray:
    words, chars, lines = (np.maximum(1, np.asarray(s[k], float)) for k in ("n_words", "word_chars", "n_lines"))
    by = lambda k, d: np.asarray(s[k], float) / d
    return np.stack([np.log(words), by("word_chars", words), by("n_symbols", words), by("n_dup_lines", lines), by("n_repeat_words", words), by("n_upper", chars), by("n_digits", chars), by("n_marks", words), by("n_distinct", words)], 1)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the STATS) of every row, over whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = statistics(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[k], pa.int64()) for k in STATS)], names=["id", *STATS])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{k} long" for k in STATS))
    return made.withColumnRenamed("id", id_col)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> boosting.Trees:
    """Trees from at most ``sample`` labelled documents that pass the base rules, picked by hash of the id.

    Rows without id or label are left out; an id with several labels counts as its worst. Without labelled
    documents the trees are constant and keep everything.
    """
    labelled = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    picked = materialize(hash_sample(materialize(labelled), id_col, sample))
    rows = document_stats(docs.select(id_col, "text").join(F.broadcast(picked.select(id_col)), id_col, "left_semi"))
    rows = rows.join(F.broadcast(picked), id_col).filter(~base_failed()).orderBy(F.xxhash64(id_col), id_col).limit(sample).toPandas()
    return boosting.fit(features(rows), rows["_y"].to_numpy(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: boosting.Trees, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, STATS, good double, base_failed, kept) of every row.

    Null or empty texts have no words and fail the base rules; equal rows get equal verdicts; rows without
    id are judged as any other; other columns are not read; an empty table gives no rows.
    """
    stats = document_stats(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            s = {k: batch.column(batch.schema.get_field_index(k)).to_numpy() for k in STATS}
            good = 1 / (1 + np.exp(-trees.margin(features(s))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[*batch.schema.names, "good"])

    scored = stats.mapInArrow(run, with_fields(stats, good="double"))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= keep))


def keep_good(docs: DataFrame, trees: boosting.Trees, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that judge() would keep, in one pass and with all their columns."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                s = statistics(part.column(part.schema.get_field_index(text_col)).to_pylist())
                good = 1 / (1 + np.exp(-trees.margin(features(s)))) >= keep
                good &= (s["n_words"] >= MIN_WORDS) & (100 * s["n_repeat_words"] <= MAX_REPEAT_PERCENT * s["n_words"])
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    verdicts = judge(docs, fit(docs, read(spark, sf_dir, "labels")))
    return verdicts.select("doc_id", *STATS[:5], "base_failed", "kept", "good")
