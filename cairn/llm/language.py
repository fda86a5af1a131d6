"""Language identification by Bayesian evidence fusion.

The posterior of a text's language multiplies four kinds of evidence: the likelihood of its byte trigrams
(counted over all declared texts), the language that its markup declares, the country suffix of its
address, and a prior of its host. Priors are grouped counts of declared languages, smoothed down the
hierarchy: all rows, suffix, registered domain, host. A row's own declaration is left out of its prior.

Every declared language is a class of its own, up to LANGUAGES of them; beyond that the rarest ones together
are the class OTHER, with its own trigrams and prior, so that their texts get no other language's name.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import hot_join, materialize, read, slices, with_fields
from cairn.llm.hosts import domain_of, host_of, suffix_of

#: Classes of their own, at most, and the name of what is left.
LANGUAGES, OTHER = 255, "und"
#: Hashed trigrams; trigrams whose evidence a text can bring at most (neighbours are not independent).
BUCKETS, EVIDENCE = 1 << 15, 200
#: How often markup tells the language right, and how often a country's suffix does.
DECLARED, SUFFIX = 0.9, 0.7
#: Rows that a prior from the level above weighs.
STRENGTH = 20.0
#: A row is kept if its language is this certain.
KEEP = 0.5
#: Suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "co.uk": "en", "com.au": "en", "com.mx": "es", "com.ar": "es"}


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts (A-Z lower-cased), and the text each belongs to."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    inside = doc[:-2] == doc[2:]
    return code[inside].astype(np.int64), doc[:-2][inside]


def languages(declared: DataFrame, lang_col: str = "lang") -> list[str]:
    """The classes: declared languages by name (a declared OTHER says nothing), and OTHER if there are more."""
    counts = materialize(declared.filter(F.col(lang_col) != OTHER).groupBy(lang_col).count())
    own = sorted(r[0] for r in counts.orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect())
    return own + [OTHER] * (counts.count() > LANGUAGES)


def class_of(lang: Column, langs: list[str]) -> Column:
    """Index into ``langs``; of OTHER, if there is one, for a language that is none of them; null if none is told."""
    own = F.create_map(*(F.lit(x) for k, c in enumerate(langs) if c != OTHER for x in (c, k)))[lang] if langs and langs[0] != OTHER else F.lit(None).cast("int")
    return F.when(lang != OTHER, F.coalesce(own, F.lit(len(langs) - 1)) if OTHER in langs else own)


def fit(declared: DataFrame, langs: list[str], text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Log-probability of each trigram by class, from all declared rows: counts are grouped by (class, trigram)."""

    def count(batches):
        held = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                code, doc = trigrams(part.column(0).to_pylist())
                held += np.bincount(part.column(1).to_numpy()[doc].astype(np.int64) * BUCKETS + code, minlength=held.size).reshape(held.shape)
        cls, bucket = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(bucket, pa.int32()), pa.array(held[cls, bucket])], names=["cls", "bucket", "n"])

    if not langs:
        return np.zeros((0, BUCKETS))
    told = declared.select(F.col(text_col).alias("text"), class_of(F.col(lang_col), langs).alias("cls")).filter("cls IS NOT NULL")
    sums = told.mapInArrow(count, "cls int, bucket int, n long").groupBy("cls", "bucket").agg(F.sum("n").alias("n")).toArrow()  # len(langs) * BUCKETS rows at most
    counts = np.full((len(langs), BUCKETS), 0.5)
    counts[sums.column("cls").to_numpy(), sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    return np.log(counts / counts.sum(1, keepdims=True))


def host_counts(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (host, cls) -> a table (host, n rows; and of host, domain and suffix the counts by class as a map
    and their sum), and the counts of all rows."""
    each = materialize(rows.groupBy("host", "cls").agg(F.count(F.lit(1)).alias("n")))
    each = each.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    told = each.filter("cls IS NOT NULL")

    def level(key: str) -> DataFrame:
        own = told.groupBy(key, "cls").agg(F.sum("n").alias("n"))
        return own.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias(f"{key}_by"), F.sum("n").alias(f"{key}_n"))

    table = each.groupBy("host", "domain", "suffix").agg(F.sum("n").alias("n"))
    for key in ("host", "domain", "suffix"):
        table = table.join(level(key), key, "left")
    return materialize(table.drop("domain", "suffix")), {r.cls: r.n for r in told.groupBy("cls").agg(F.sum("n").alias("n")).collect()}


def identify(rows: DataFrame, model: np.ndarray, langs: list[str], id_cols: list[str], keep: float = KEEP) -> DataFrame:
    """``rows`` (ids, text, declared, host) -> (ids, declared, predicted, posterior, kept).

    Each missing kind of evidence says nothing: a null or empty text, a null declared language (or one that is
    no class), a null host or neutral suffix. Without any language to tell apart, predicted is null and
    nothing is kept. Rows without id and repeated rows are judged as any other; an empty table gives no rows.
    """
    rows = rows.select(*id_cols, "text", "declared", F.coalesce("host", F.lit("")).alias("host"))
    if not langs:
        return rows.select(*id_cols, "declared", F.lit(None).cast("string").alias("predicted"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    rows = rows.withColumn("cls", class_of(F.col("declared"), langs))
    table, total = host_counts(rows)
    n = table.agg(F.sum("n")).first()[0] or 0
    sent = rows.sparkSession.sparkContext.broadcast(model)
    plain = rows.drop("text")
    names = plain.columns

    def run(batches):
        of = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                code, doc = trigrams(part.column(part.schema.get_field_index("text")).to_pylist())
                many = np.bincount(doc, minlength=part.num_rows)
                ll = np.stack([np.bincount(doc, t[code], part.num_rows) for t in of], 1) * np.minimum(1, EVIDENCE / np.maximum(many, 1))[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * len(of), pa.int32()), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), flat], names=[*names, "text_log"])

    scored = hot_join(rows.mapInArrow(run, with_fields(plain, text_log="array<double>")), table, "host", "n", n)
    size, every = len(langs), sum(total.values())
    all_counts = F.array(*(F.lit(float(total.get(k, 0))) for k in range(size)))
    has = F.when(F.col("cls").isNotNull(), 1.0).otherwise(0.0)
    speaks = class_of(F.create_map(*(F.lit(x) for p in SUFFIXES.items() for x in p))[suffix_of(F.col("host"))], langs)
    speaks = F.when(speaks != size - 1, speaks) if OTHER in langs else speaks
    scored = scored.withColumns({"speaks": speaks, "has": has})
    told = lambda k, said, right: F.when(said.isNull(), 0.0).when(said == k, log(right)).otherwise(log((1 - right) / max(1, size - 1)))

    def prior(k):
        own = F.when(F.col("cls") == k, 1.0).otherwise(0.0)
        p = (F.get(all_counts, k) - own + 1) / (every - F.col("has") + size)
        for key in ("suffix", "domain", "host"):
            x = F.coalesce(F.try_element_at(F.col(f"{key}_by"), k), F.lit(0)) - own
            p = (x + STRENGTH * p) / (F.coalesce(F.col(f"{key}_n"), F.lit(0)) - F.col("has") + STRENGTH)
        return p

    logs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get("text_log", k) + told(k, F.col("cls"), DECLARED) + told(k, F.col("speaks"), SUFFIX) + F.log(prior(k)))
    scored = scored.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    scored = scored.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top"))))
    best = F.get(F.array(*map(F.lit, langs)), (F.array_position("logs", F.col("top")) - 1).cast("int"))
    return scored.select(*id_cols, "declared", best.alias("predicted"), "posterior", (F.col("posterior") >= keep).alias("kept"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host): visible text, the markup's lang, the url's host."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    return pages.select("page_id", F.regexp_replace(html, "<[^>]*>", " ").alias("text"), F.when(declared != "", declared).alias("declared"), host_of(F.coalesce("url", F.lit(""))).alias("host"))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """All documents (their text, declared language, source as host; neither markup nor address) and all pages
    (visible text, the markup's lang, the url's suffix and host), judged together; trigrams are counted in documents."""
    docs = read(spark, sf_dir, "documents")
    langs = languages(docs)
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    pages = page_rows(read(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    return identify(own.unionByName(pages), fit(docs, langs), langs, ["doc_id", "page_id"]).withColumn("posterior", F.round("posterior", 6))
