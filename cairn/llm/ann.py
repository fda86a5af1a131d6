"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations (principal directions, then iterative quantisation on a
bounded sample, from several starts until there are BITS bits). A code is cut into substrings, each an index
of its own. Two codes within a Hamming radius have, in some substring, no more differing bits than its share
of the radius (pigeonhole), so each substring's index is probed within its share and every code within the
radius is found. Only the vectors of those are compared, in double precision. The radius is set on the
sample, so that it holds nearly all true neighbours there; queries with too few neighbours within it are
searched again without a radius.

How many substrings there are is chosen by what probing them would cost. Where the radius is a large part of
the bits (neighbours hardly nearer than others), probing would meet most buckets of every substring; then
the code is one substring, and all codes are compared with the query's once, floats still only within the
radius. Buckets are dealt to tasks; tables of their sizes tell how many even parts a bucket's rows and
queries are cut into, so no task gets more than ROWS by QUERIES.
"""

from __future__ import annotations

from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import hash_sample, materialize, read, with_fields

#: Vectors that the rotations and the radius are learned from, and queries among them, at most.
SAMPLE, SAMPLE_QUERIES = 10_000, 300
#: Part of the sample's true neighbours that the radius must hold.
HELD = 0.985
BITS, WORD, K = 256, 64, 20
#: Substrings to choose from; rows in a bucket on average; part of all buckets beyond which probing does not pay.
CUTS, BUCKET, PAYS = (4, 8, 16, 32), 2048, 0.5
ROWS, QUERIES, BLOCK = 32_768, 2048, 64
#: Part of a block's pairs within the radius beyond which all of it is multiplied.
DENSE = 0.1


class Codes:
    """A learned map from vectors to codes of BITS bits: one rotation after the other, each of its own start."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = 30):
        self.mean = x.mean(0)
        c = x - self.mean
        _, vectors = np.linalg.eigh(c.T @ c)
        maps = []
        while (left := bits - sum(m.shape[1] for m in maps)) > 0:
            axes = vectors[:, ::-1][:, : min(left, x.shape[1])]
            v = c @ axes
            turn = np.linalg.qr(np.random.default_rng(1 + len(maps)).normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(rounds):
                a, _, b = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (a @ b).T
            maps.append(axes @ turn)
        self.map = np.concatenate(maps, 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """(vectors, BITS / WORD) numbers."""
        return np.packbits((x - self.mean) @ self.map >= 0, axis=1, bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes (their last axis)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def shares(radius: int, m: int) -> list[int]:
    """Differing bits to probe each substring for; -1: not at all. Their sum and m - 1 make the radius."""
    each, more = divmod(radius, m)
    return [each if i <= more else each - 1 for i in range(m)]


def plan(n: int, radius: int) -> tuple[int, int, float]:
    """For n codes: substrings, bits by which each is dealt into buckets, and the part of all buckets that a query meets."""
    best = (1, 0, 1.0)
    for m in CUTS:
        high = min(BITS // m, 14, max(0, ceil(log2(max(1, n / BUCKET)))))
        cost = sum(sum(comb(high, d) for d in range(min(s, high) + 1)) / (1 << high) for s in shares(radius, m) if s >= 0)
        if cost < min(PAYS, best[2]):
            best = (m, high, cost)
    return best


def calibrate(codes: Codes, x: np.ndarray, k: int) -> int:
    """The radius that holds HELD of the true neighbours within the sample."""
    q = x[:SAMPLE_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    n = min(k, len(x) - 1)
    if n < 1:
        return BITS
    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
    c = codes.of(x)
    return int(np.quantile(apart(c[: len(q), None], c[best]), HELD, method="higher"))


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec) of the rows that take part: an id, finite numbers, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    return df.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _coded(df: DataFrame, codes: Codes) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = codes.of(_matrix(batch.column(batch.schema.get_field_index("vec"))))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, with_fields(df, code="array<long>"))


def _codes_in(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // WORD)


def top_pairs(y, x, cy, cx, first, radius: int, k: int, mine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (rows of y): its k best rows of x within the radius, as (query, row, score); ties to the
    smaller ``first``. ``mine`` says of pairs within the radius which ones count."""
    far = np.zeros((len(y), len(x)), np.int16)
    for w in range(cx.shape[1]):
        far += np.bitwise_count(cy[:, w, None] ^ cx[:, w])
    near = far <= radius
    if near.mean() > DENSE:  # of many pairs only those that may be among the best, with room for rounding
        score = np.where(near, y @ x.T, -np.inf)
        n = min(k, len(x))
        least = np.partition(score, len(x) - n, axis=1)[:, len(x) - n] if mine is None else np.full(len(y), -np.inf)
        near &= score >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None]
    q, b = np.nonzero(near)
    if mine is not None:
        keep = mine(q, b)
        q, b = q[keep], b[keep]
    score = np.concatenate([(y[q[i : i + (1 << 16)]] * x[b[i : i + (1 << 16)]]).sum(1) for i in range(0, len(q), 1 << 16)]) if len(q) else np.zeros(0)
    order = np.lexsort((first[b], -score, q))
    q, b, score = q[order], b[order], score[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], b[best], score[best]


def search(index: DataFrame, queries: DataFrame, radius: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query, the k + 1 nearest distinct vectors within the radius, at least.

    ``index`` is (vec, ids, code) of distinct vectors, ``queries`` is (id, vec, code); both written tables.
    """
    m, high, _ = plan(index.count(), radius)
    s, share = BITS // m, shares(radius, m)
    used = [i for i in range(m) if share[i] >= 0]
    word, shift = [s * i // WORD for i in range(m)], [s * i % WORD for i in range(m)]

    def part(i):  # the last bits of substring i
        return F.shiftrightunsigned(F.get("code", F.lit(word[i])), shift[i]).bitwiseAND((1 << high) - 1).cast("int") if high else F.lit(0)

    bucket = lambda i, h: F.lit(i << high) + h
    near = [[h for h in range(1 << high) if h.bit_count() <= r] for r in share]
    rows = index.select("vec", "ids", "code", F.explode(F.array(*(bucket(i, part(i)) for i in used))).alias("bucket"))
    probe = lambda i: F.transform(F.array(*map(F.lit, near[i])), lambda h: bucket(i, part(i).bitwiseXOR(h)))
    asked = queries.select("id", "vec", "code", F.explode(F.concat(*map(probe, used))).alias("bucket"))
    # m times 2^high buckets at most, and 2^high is the number of rows by BUCKET
    parts = lambda df, n, name: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = materialize(parts(rows, ROWS, "rs").join(parts(asked, QUERIES, "qs"), "bucket"))
    sizes = F.broadcast(sizes) if sizes.count() <= 1 << 18 else sizes
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    rows = rows.join(sizes, "bucket").withColumns({"r": mine("code", "rs"), "q": spread("qs")}).drop("rs", "qs")
    asked = asked.join(sizes, "bucket").withColumns({"q": mine("id", "qs"), "r": spread("rs")}).drop("rs", "qs")
    mask = np.uint64((1 << min(s, WORD)) - 1 if s < WORD else (1 << WORD) - 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            i = left.column("bucket")[0].as_py() >> high
            x, cx = _matrix(left.column("vec")), _codes_in(left.column("code"))
            y, cy = _matrix(right.column("vec")), _codes_in(right.column("code"))
            ids, lists = right.column("id").to_numpy(), left.column("ids").combine_chunks()
            first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]]
            for a in range(0, len(y), BLOCK):
                qc = cy[a : a + BLOCK]

                def found_here(q, b, qc=qc):  # found in this index and in none before
                    ok = np.ones(len(q), bool)
                    for j in range(i + 1):
                        d = np.bitwise_count(((qc[q, word[j]] ^ cx[b, word[j]]) >> np.uint64(shift[j])) & mask).astype(np.int16)
                        ok &= (d <= share[j]) if j == i else (d > share[j])
                    return ok

                q, b, score = top_pairs(y[a : a + BLOCK], x, qc, cx, first, radius, k + 1, None if m == 1 else found_here)
                out.append((ids[a + q], b, score))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        q, b, sc = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q), "ids": lists.take(pa.array(b)), "score": pa.array(sc)})

    keys = ["bucket", "r", "q"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, ids array<long>, score double")
    return found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k largest inner products found, ties to the smaller id.

    ``queries`` are rows of the same kind; a row never finds its own id. Rows without id, null or zero
    vectors, vectors with null or non-finite parts, and vectors of another length than most of the sample
    take no part, neither as queries nor as candidates. Equal vectors are indexed once with their k + 1
    smallest ids, which is all that any result can hold of them; a hot vector is cut to those before the
    shuffle. A query gets all candidates if there are k or fewer. Repeated ids are one candidate each;
    other columns are not read; empty tables give no rows.
    """
    whole = materialize(valid(vectors, id_col, vec_col))
    sample = hash_sample(whole, "id", SAMPLE).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(r.vec) for r in sample]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = np.array([r.vec for r in sample if len(r.vec) == d], float)
    codes = Codes(x)
    distinct = np.unique(x, axis=0)
    radius = calibrate(codes, distinct[np.random.default_rng(0).permutation(len(distinct))], k)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = whole.filter(F.size("vec") == d).withColumn("place", place).filter(F.col("place") <= k + 1)
    index = materialize(_coded(few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")), codes))
    asked = materialize(_coded(valid(queries, id_col, vec_col).filter(F.size("vec") == d).dropDuplicates(["id"]), codes))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = materialize(top(search(index, asked, radius, k)))
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(enough, "id", "left_anti"))
    if short.isEmpty():
        return found
    again = top(search(index, short, BITS, k))
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*again.columns).unionByName(again)


def op1_mih(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose vec_id is divisible by 20, among all other rows."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
