"""Mixing sources to target weights: a time-varying curriculum.

Every source has a share of the words to train on (its target) and a schedule of weights over training
time. A source's documents stand in a fixed pseudo-random order (md5 of the id); whole passes over the
source come first, then a part of one more pass, until the target is met. The running number of words
before a document is the demand that its source must have met by then; the inverse of the integrated
schedule turns it into a training position in [0, 1], by which the result is range-sorted.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import WORD, materialize, read

#: Fixed by the contract: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Factor of a source's weight at the start and the end of training, by its place in WEIGHTS.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, CAP = 1.5, 2
#: Documents of one source in a bucket of the running sum, on average.
BUCKET_ROWS = 2048
#: Sources, at most: the driver shares out the words among them.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: int = CAP) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``cap`` times its own.

    Sources by rising cap per weight: one is capped if its share of what the capped ones before it leave
    reaches its cap; what is left goes to the others by weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    rest, weight, found = share * sum(sizes), sum(weights), [0.0] * len(sizes)
    for at, i in enumerate(order):
        if rest * weights[i] < cap * sizes[i] * weight:
            for j in order[at:]:
                found[j] = rest * weights[j] / weight
            break
        found[i] = float(cap * sizes[i])
        rest, weight = rest - cap * sizes[i], weight - weights[i]
    return found


def _position(f):
    """Where a linear schedule from _w0 to _w1 has given out the part f of its integral."""
    w0, a = F.col("_w0"), (F.col("_w1") - F.col("_w0")) / 2
    flat = F.when(a == 0, f)
    return flat.otherwise((F.sqrt(w0 * w0 + 4 * a * f * (w0 + a)) - w0) / F.when(a == 0, F.lit(1.0)).otherwise(2 * a))


def curriculum_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "size",
    source_col: str = "source",
    weights=WEIGHTS,
    ramps=RAMPS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken, positions array<double>.

    ``positions`` has the training position of each (whole or last, partial) copy; empty if none is taken.
    Sources are a configured, short list: their sizes are collected, and more than MAX_SOURCES are an error.
    All else stays distributed: running sums go over buckets of md5 digits in three levels, so no task sorts
    a whole source.

    Rows without id are ordered by the digest of their size; null sizes count 0; a null source is a source of its own, the
    last. Empty documents and empty tables get taken 0 and no positions. Repeated rows are separate rows.
    Columns of ``docs`` beside the three are not read. Ties of md5 and id are broken by size; equal rows
    are interchangeable.
    """
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"),
        F.col(source_col).alias("_source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), F.coalesce(F.col(size_col), F.lit(0)).cast("string"))).cast("binary")).alias("_h"),
    )
    base = materialize(base)
    sums = base.groupBy("_source").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"{source_col} has more than {MAX_SOURCES} values; group them into sources first")
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode() if isinstance(r[0] or "", str) else r[0]))
    w = [weights[i % len(weights)] for i in range(len(sums))]
    goal = targets([r.s for r in sums], w, share, cap)
    rows = []
    for i, r in enumerate(sums):
        passes = int(goal[i] // r.s) if r.s else 0
        w0, w1 = (float(x) for x in ramps[i % len(ramps)])
        rows.append((r[0], r.s, goal[i], passes, round(goal[i]) - passes * r.s, w0, w1))
    source_type = base.schema["_source"].dataType.simpleString()
    plan = docs.sparkSession.createDataFrame(rows, f"_source {source_type}, _all long, _target double, _passes int, _rest long, _w0 double, _w1 double")

    digits = max(0, ceil(log(max(1, sum(r.n for r in sums) / BUCKET_ROWS), 16)))
    coarse = max(0, digits - 3)
    base = base.withColumns({"_b": F.substring("_h", 1, digits), "_c": F.substring("_h", 1, coarse)})
    fine = base.groupBy("_source", "_c", "_b").agg(F.sum("_size").alias("_sum"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upper = fine.groupBy("_source", "_c").agg(F.sum("_sum").alias("_csum"))
    upper = upper.select("_source", "_c", F.coalesce(F.sum("_csum").over(before("_source", by="_c")), F.lit(0)).alias("_coff"))
    fine = fine.select("_source", "_c", "_b", F.coalesce(F.sum("_sum").over(before("_source", "_c", by="_b")), F.lit(0)).alias("_boff"))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    off = fine.join(upper, same(fine, upper, "_source", "_c")).select(fine["_source"], fine["_b"], (F.col("_boff") + F.col("_coff")).alias("_off"))
    off = off.join(F.broadcast(plan), off["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    here = Window.partitionBy("_source", "_b").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_cum", F.sum("_size").over(here) - F.col("_size"))
    off = off.withColumnsRenamed({"_source": "_s2", "_b": "_b2"})
    found = base.join(off, base["_source"].eqNullSafe(off["_s2"]) & (base["_b"] == off["_b2"])).withColumn("_cum", F.col("_cum") + F.col("_off"))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_cum")))
    copies = F.col("_passes") + F.when(part > 0, 1).otherwise(0)
    goal_words = F.when(F.col("_target") > 0, F.col("_target")).otherwise(1.0)
    at = lambda c: _position(F.least(F.lit(1.0), (c * F.col("_all") + F.col("_cum")) / goal_words))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source").alias(source_col),
        F.col("_all").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_passes") * F.col("_size") + part).cast("long").alias("taken"),
        F.when((F.col("_size") > 0) & (copies > 0), F.transform(F.sequence(F.lit(0), copies - 1), at)).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, the words of the whole text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix trains on them: each row once for every copy taken, range-sorted by position.

    A last copy of which only a part is taken is a row as well. Rows are told apart by their id, source and
    text, so those without id and those that repeat an id are mixed as any other; rows equal in all three
    are taken together. Columns of any name but ``_cairn_key`` and ``_cairn_at`` pass through.
    """
    told = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, source_col, text_col))
    keyed = docs.withColumn("_cairn_key", F.md5(F.concat_ws("|", *told).cast("binary")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    units = keyed.select("_cairn_key", size.alias("size"), F.col(source_col).alias("source")).groupBy("_cairn_key", "source").agg(F.sum("size").alias("size"))
    plan = curriculum_mix(units, "_cairn_key")
    plan = materialize(plan.select("_cairn_key", F.explode("positions").alias("_cairn_at")))
    return keyed.join(plan, "_cairn_key").orderBy("_cairn_at", "_cairn_key").select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents in training order; ``position`` is the first copy's place (null: not taken)."""
    mixed = curriculum_mix(sized(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position")
    ).orderBy("position", "doc_id")


ORACLE = r"""
WITH e AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
d AS (SELECT *, md5(COALESCE(CAST(doc_id AS VARCHAR), '|' || size)) AS h FROM e),
s AS (SELECT source, SUM(size)::BIGINT AS source_size,
             [5, 2, 1][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS r FROM s),
c AS (SELECT *, 1.5 * SUM(source_size) OVER ()
             - COALESCE(2 * SUM(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             SUM(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
f AS (SELECT MIN(CASE WHEN rest::DOUBLE * w < 2.0 * source_size * ws THEN r END) AS first FROM c),
g AS (SELECT c.source, c.source_size, c.w,
             CASE WHEN f.first IS NULL OR c.r < f.first THEN 2.0::DOUBLE * c.source_size
                  ELSE (SELECT rest FROM c AS z WHERE z.r = f.first)::DOUBLE * c.w / (SELECT ws FROM c AS z WHERE z.r = f.first)::DOUBLE END AS target
      FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
q AS (SELECT *, ROUND_EVEN(target, 0)::BIGINT - passes * source_size AS part FROM p),
t AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.part, q.w,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS cum
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT *, GREATEST(0, LEAST(size, part - cum)) AS more,
             LEAST(1.0::DOUBLE, cum::DOUBLE / CASE WHEN target > 0 THEN target ELSE 1.0 END) AS fr FROM t)
SELECT doc_id, size, source_size, target, (passes * size + more)::BIGINT AS taken,
       CASE WHEN size > 0 AND (passes > 0 OR more > 0) THEN ROUND(CASE w
         WHEN 5 THEN (SQRT(2.25::DOUBLE - 2.0::DOUBLE * fr) - 1.5::DOUBLE) / -1.0::DOUBLE
         WHEN 2 THEN fr ELSE (SQRT(0.25::DOUBLE + 2.0::DOUBLE * fr) - 0.5::DOUBLE) / 1.0::DOUBLE END, 6) + 0.0 END AS position
FROM u
"""
