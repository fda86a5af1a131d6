"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. The index over the distinct ones:

* uppermost nodes are shared masked bit patterns. The bits are cut into k blocks; two linked fingerprints
  agree on k - radius blocks at least, so under each choice of that many blocks (a mask) the fingerprints
  with the same masked pattern form a node, and every link lies within some node. k grows with the number
  of fingerprints, so that nodes stay small;
* a node that has very many fingerprints is divided by more shared bits: its free bits are cut into
  radius + 1 blocks, on one of which two linked fingerprints agree. What is still large is cut into even
  parts, and each pair of parts becomes a node;
* within a node, fingerprints stand by Gray rank; runs of 16, and runs of 16 of those, are inner nodes with
  the bits that all below them share. Two inner nodes whose shared bits differ in more than ``radius``
  places are skipped with all that is below them.

Each task gives a spanning forest of the links it found, as stars around the smallest id, never all pairs.

``keep_one`` decides by similarity, which fingerprints measure too coarsely: a Jaccard similarity s is a
cosine of about 2s/(1+s), which makes the part arccos(2s/(1+s))/pi of the bits differ. At s = 0.8 that is
0.15, or 10 of 64 bits give or take 3, and no index over 64 or 128 bits tells that from unrelated texts
without comparing a fixed part of all pairs. So the index gives it the close copies as candidates, minima of
hashed shingles in bands give it the others, and the exact shingle sets of all candidates are compared.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import hot_join, materialize, read, slices, small
from cairn.llm.graph import components

BITS, FAN = 64, 16
#: Fingerprints in a node beyond which it is cut into parts.
PART = 2048
#: Pairs compared at once.
STEP = 1 << 18
#: Fingerprints that share a masked pattern on average, at most, before more bits are masked.
CROWD = 8
#: keep_one: words of a shingle, least similarity, differing bits of fingerprints that are candidates.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 4
#: Bands of minima, minima in a band; sets that are compared in one task; parts of a group of which all pairs are compared.
BANDS, ROWS, GROUP, PAIRED = 48, 6, 128, 64


def _majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the numbers."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64 bits of each number, by two rounds of multiplication and shift."""
    for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(m)
    return x ^ (x >> np.uint64(29))


def hashes_of(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the A-Z lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest as digest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), min(words, len(found))
    at = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=at[1:])
    return np.array([digest(joined[a:b], 42) for a, b in zip(at[: len(found) - n + 1].tolist(), (at[n:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """Of the shingles' hashes; zero without words."""
    return _majority(hashes_of(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): the fingerprint of each whole text, as a signed number. Null text: no words, so 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def masks(n: int, radius: int, crowd: int) -> list[int]:
    """Masks for n fingerprints: so many blocks that ``crowd`` at most share a masked pattern on average."""
    blocks = radius + 2
    while blocks < radius + 4 and n >> (BITS * (blocks - radius) // blocks) > crowd:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Nodes:
    """One level: where each node's children begin, how many they are, and the bits they all share."""

    def __init__(self, starts, count, low, high):
        self.start, self.n = starts, np.diff(np.append(starts, count))
        self.all, self.any = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        self.shared = ~(self.all ^ self.any)


def levels(bucket: np.ndarray, fp: np.ndarray) -> list[Nodes]:
    """Levels from leaves to the whole buckets, over rows sorted by bucket and Gray rank."""
    found, owner, low, high = [], bucket, fp, fp
    for last in (False, False, True):
        new = np.append(True, owner[1:] != owner[:-1])
        if not last:
            at = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
            new |= at % FAN == 0
        starts = np.flatnonzero(new)
        found.append(Nodes(starts, len(owner), low, high))
        owner, low, high = owner[starts], found[-1].all, found[-1].any
    return found


def descend(tree: list[Nodes], fp, radius: int, level: int, i, j):
    """Linked rows below pairs of nodes of a level, in blocks."""
    if level < 0:
        near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        yield i[near], j[near]
        return
    t = tree[level]
    near = np.bitwise_count((t.all[i] ^ t.all[j]) & t.shared[i] & t.shared[j]) <= radius
    i, j = i[near], j[near]
    size = t.n[i] * t.n[j]
    block = np.cumsum(size) // STEP
    for cut in np.split(np.arange(len(i)), np.flatnonzero(np.diff(block)) + 1):
        if not len(cut):
            continue
        a, b, s = i[cut], j[cut], size[cut]
        at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        wide = np.repeat(t.n[b], s)
        x, y = np.repeat(t.start[a], s) + at // wide, np.repeat(t.start[b], s) + at % wide
        ordered = x <= y
        yield from descend(tree, fp, radius, level - 1, x[ordered], y[ordered])


def forest(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all rows linked within their bucket: each member with the smallest node of its tree."""
    tree, label = levels(bucket, fp), np.arange(len(fp))
    whole = np.flatnonzero(np.diff(np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))) > 1)
    for i, j in descend(tree, fp, radius, 2, whole, whole):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    centre = least[label]
    return centre[centre != node], node[centre != node]


def blocks_of(free: int, n: int) -> list[int]:
    """The set bits of a mask, dealt into n masks."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """``fps`` (fp, node: longs) -> edges (a, b) of nodes that connect all that differ in ``radius`` bits at most."""
    patterns = masks(fps.count(), radius, CROWD)
    masked = lambda k, m: F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
    rows = fps.select("fp", "node", F.explode(F.array(*(masked(k, m) for k, m in enumerate(patterns)))).alias("m")).select("m.mask", "m.key", "fp", "node")
    keys = ["mask", "key"]

    def crowded(rows):
        large = materialize(rows.groupBy(*keys).count().filter(F.col("count") > PART))
        n = large.count()
        return n, F.broadcast(large) if n <= 20_000 else large

    n, large = crowded(rows)
    if n:
        more = F.array(*(F.array(*(F.lit(signed(x)) for x in blocks_of(~m & (1 << BITS) - 1, radius + 1))) for m in patterns))
        inner = F.transform(F.get(more, F.col("mask").cast("int")), lambda x, i: F.struct(i.cast("short").alias("sub"), F.col("fp").bitwiseAND(x).alias("subkey")))
        outer = F.array(F.struct(F.lit(-1).cast("short").alias("sub"), F.lit(0).cast("long").alias("subkey")))
        rows = rows.join(large, keys, "left").withColumn("s", F.explode(F.when(F.col("count").isNull(), outer).otherwise(inner)))
        rows = rows.select(*keys, "s.sub", "s.subkey", "fp", "node")
        keys = [*keys, "sub", "subkey"]
        n, large = crowded(rows)
    if n:
        rows = rows.join(large.select(*keys, F.ceil(F.col("count") / PART).cast("int").alias("parts")), keys, "left")
        mine = F.coalesce(F.pmod(F.xxhash64("fp", "node"), F.col("parts")).cast("int"), F.lit(0))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
        rows = rows.withColumn("mine", mine).withColumn("other", other)
        rows = rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
        keys = [*keys, "lo", "hi"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            fp = table.column("fp").to_numpy().view(np.uint64)
            new = np.zeros(len(table), bool)
            for k in keys:
                c = table.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            bucket = np.cumsum(new)
            rank = fp.copy()
            for s in (1, 2, 4, 8, 16, 32):
                rank ^= rank >> np.uint64(s)
            order = np.lexsort((rank, bucket))
            a, b = forest(bucket[order], fp[order], table.column("node").to_numpy()[order], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(x.num_rows for x in held) >= 1 << 16:  # all but the last node is whole
                table = pa.Table.from_batches(held)
                same = np.ones(len(table), bool)
                for k in keys:
                    c = table.column(k).to_numpy()
                    same &= c == c[-1]
                if cut := len(table) - int(same.sum()):
                    yield work(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
            held.append(batch)
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return rows.select(*keys, "fp", "node").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint string, component_id) for every row: component_id is the smallest id reachable over links.

    Ids are whole numbers. Texts without words (null, empty, white space) have fingerprint zero and link as
    any other; shorter texts than ``words`` are one shingle. Copies share a fingerprint and are linked
    through it, so hot groups of copies shrink to one row before any pair is looked at. Rows without an id
    get their group's component, null if no row of their fingerprint has an id. Repeated ids are rows of
    their own. Other columns are not read; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").cast("long").alias("node"), F.count(F.lit(1)).alias("n")))
    groups = components(links(distinct.filter("node IS NOT NULL").select("fp", "node"), radius))
    named = materialize(distinct.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n"))
    return hot_join(prints.select("id", "fp"), named, "fp", "n", prints.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id")
    )


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of hashes_of(), sorted."""
    return np.unique(hashes_of(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys; two sets of Jaccard similarity s share a given one with chance s**ROWS."""
    rng = np.random.default_rng(42)
    odd, plus = rng.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    mixed = _mixed(hashes)
    for i in range(0, len(mixed), 256):
        least = np.minimum(least, (((mixed[i : i + 256, None] ^ plus) * (odd * np.uint64(2) + np.uint64(1))) >> np.uint64(16)).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def digest_of(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all of the sets whose exact Jaccard similarity is ``similarity`` or more."""
    size = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner, at = np.repeat(np.arange(len(sets)), size), np.append(0, np.cumsum(size))
    order = np.argsort(word, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(word)))
    label, a, b = np.arange(len(sets)), [], []
    for i in range(len(sets)):
        mine = word[at[i] : at[i + 1]]
        n = ends[mine + 1] - ends[mine]
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[mine], n)
        both = np.bincount(owner[order[post]], minlength=len(sets))
        near = np.flatnonzero((both >= similarity * (size[i] + size - both) * (1 - 1e-12)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """``sets`` (keys: longs, node, shingles array<long>) -> edges (a, b) as similar() finds them within each key."""

    def run(batches):
        held, last = [], None

        def work():
            if len(held) > 1:
                i, j = similar([s for _, s in held], similarity)
                node = np.array([n for n, _ in held], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(len(keys) + 1)]
            for *key, node, got in zip(*rows, batch.column(len(keys) + 1), strict=True):
                if key != last:
                    yield from work()
                    held, last = [], key
                held.append((node, got.values.to_numpy().view(np.uint64)))
        yield from work()

    return sets.select(*keys, "node", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def similar_groups(sets: DataFrame, ties: DataFrame, similarity: float) -> DataFrame:
    """(node, component) over all pairs of candidates that are similar.

    ``sets`` is (loose, n, node, shingles), n sets in each loose group; ``ties`` (key, node) names the
    candidates: those that share a key. Groups of more than GROUP are cut into even parts. Parts are
    connected inside first, then by one set of each connected piece. Where pieces remain apart, all pairs of
    parts are compared if there are PAIRED at most; in larger groups, under each key, the members outside
    the key's main piece are compared with all members.
    """
    parts = F.ceil(F.col("n") / GROUP)
    sets = sets.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    edges = materialize(verified(sets, ["loose", "part"], similarity))
    large = sets.filter("parts > 1")
    if large.isEmpty():
        return components(edges)

    def pieces(edges):
        found = large.drop("shingles").join(components(edges), "node", "left")
        return materialize(found.withColumn("piece", F.coalesce("component", "node")).select("loose", "node", "parts", "piece"))

    named = pieces(edges)
    firsts = named.filter("node = piece")
    few = firsts.groupBy("loose").count().filter(F.col("count").between(2, 4 * GROUP)).select("loose")
    heads = large.join(firsts.join(few, "loose", "left_semi").select("node"), "node", "left_semi")
    edges = materialize(edges.union(verified(heads, ["loose"], similarity)))
    named = pieces(edges)
    apart = materialize(named.groupBy("loose").agg(F.min("piece").alias("p"), F.max("piece").alias("q")).filter("p <> q").select("loose"))
    if apart.isEmpty():
        return components(edges)
    rest = large.filter(F.col("parts") <= PAIRED).join(apart, "loose", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("other <> part")
    rest = rest.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    edges = materialize(edges.union(verified(rest, ["loose", "lo", "hi"], similarity)))

    held = named.filter(F.col("parts") > PAIRED).join(apart, "loose", "left_semi")
    if held.isEmpty():
        return components(edges)
    tied = materialize(ties.join(held.select("node", "piece"), "node"))
    by_piece = tied.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_piece.groupBy("key").agg(F.max_by("piece", F.struct("m", "piece")).alias("main"), F.sum("m").alias("all"), (F.sum("m") - F.max("m")).alias("odd")).filter("odd > 0")
    mixed = materialize(mixed.select("key", "main", "all", F.ceil(F.col("odd") / GROUP).alias("rows"), F.ceil(F.col("all") / GROUP).alias("cols")))
    at = hot_join(tied, mixed, "key", "all", tied.count()).filter("main IS NOT NULL")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = at.select("key", "node", every("rows").alias("row"), mine("cols").alias("col"))
    strays = at.filter("piece <> main").select("key", "node", mine("rows").alias("row"), every("cols").alias("col"))
    cells = members.union(strays).distinct().join(large.select("node", "shingles"), "node")
    return components(materialize(edges.union(verified(cells, ["key", "row", "col"], similarity))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that have a near-duplicate of smaller id: of each group exactly one row stays.

    Groups are the components over pairs whose exact Jaccard similarity of distinct shingles is
    ``similarity`` or more. Candidates are texts whose fingerprints link in the Gray-order index (RADIUS), or
    that share a band key (see band_keys); those connected by candidates are compared by their shingles, so
    no pair below ``similarity`` links, and a pair at 0.8 is no candidate with chance
    (1 - 0.8**ROWS)**BANDS, under one in a million. Texts with the same shingles shrink to one before that;
    texts without words are alike. The row of the smallest id stays; rows without id come last, among
    themselves and among repeated ids that of the smallest digest. Of rows with equal id and text any one
    stays. Columns of any name pass through (but ``_cairn_key``); no text leaves Python again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.col(id_col).cast("string"), F.lit("|")), F.lit("")), text).cast("binary")))
    keyed = docs.withColumn("_cairn_key", key)

    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                hashes = [hashes_of(t, words) for t in part.column(2).to_pylist()]
                found = [np.unique(h) for h in hashes]
                keys = pa.array([band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in found], pa.list_(pa.int64()))
                fps = pa.array(np.array([_majority(h) for h in hashes], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([digest_of(s) for s in found], pa.binary()), keys, fps], names=["id", "row", "print", "bands", "fp"])

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t, words) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["loose", "n", "node", "shingles"])

    rows = keyed.select(F.col(id_col).alias("id"), F.col("_cairn_key").alias("row"), text.alias("text"))
    rows = materialize(rows.mapInArrow(sketch, f"id {kind}, row binary, print binary, bands array<long>, fp long"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    distinct = rows.groupBy("print").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    distinct = materialize(distinct.withColumn("node", F.xxhash64("print")))
    bands = distinct.select("node", F.explode("bands").alias("key"))
    shared = materialize(bands.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    tied = materialize(hot_join(bands, shared, "key", "m", distinct.count() * BANDS).filter("first IS NOT NULL").select("key", "node", "first"))
    close = materialize(links(distinct.select("fp", "node"), RADIUS).distinct())
    edges = tied.filter("first <> node").select(F.col("node").alias("a"), F.col("first").alias("b")).union(close.select("a", "b")).distinct()
    loose = components(edges).withColumnRenamed("component", "loose")
    loose = materialize(loose.join(loose.groupBy("loose").agg(F.count(F.lit(1)).alias("n")), "loose"))
    pair = close.select(F.xxhash64(F.lit("pair"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))
    again = materialize(rows.groupBy("row").count().filter("count > 1").select(F.col("row").alias("_cairn_key")))
    some_again = not again.isEmpty()
    wanted = materialize(distinct.select("node", F.col("best.row").alias("_cairn_key")).join(loose, "node"))
    texts = keyed.select("_cairn_key", text.alias("text")).join(small(wanted), "_cairn_key")
    texts = texts.dropDuplicates(["_cairn_key"]) if some_again else texts
    sets = materialize(texts.select("text", "loose", "n", "node").mapInArrow(sets_of, "loose long, n long, node long, shingles array<long>"))
    groups = materialize(similar_groups(sets, tied.select("key", "node").union(pair), similarity))
    named = distinct.join(groups, "node", "left").select("print", "n", "best", F.coalesce("component", "node").alias("group"))
    named = materialize(named)
    first = materialize(named.groupBy("group").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("m")))
    named = materialize(hot_join(named, first, "group", "m", named.count()).select("print", F.col("first.row").alias("first"), "n"))
    gone = hot_join(rows.select("row", "print"), named, "print", "n", rows.count()).filter(F.col("first") != F.col("row")).select(F.col("row").alias("_cairn_key"))
    kept = keyed.join(small(materialize(gone)), "_cairn_key", "left_anti")
    if some_again:
        kept = kept.join(again, "_cairn_key", "left_anti").unionByName(kept.join(again, "_cairn_key", "left_semi").dropDuplicates(["_cairn_key"]))
    return kept.select(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
