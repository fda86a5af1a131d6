"""Language-model scoring: exact unigram statistics and a gated recurrent network (see gru.py).

Counts of all training tokens are grouped over the whole corpus. The commonest HEAD tokens travel to the
executors; every other token of a document is met with its count in a shuffle. The network is trained by
all tasks in parallel, each on its own training documents in pieces of SEGMENT tokens, in ROUNDS rounds of
averaging (every training document belongs to one round); whole texts are scored with the state carried on.
So what is learned from grows with the corpus, while its size is fixed. A rare word's
probability is its class's, from the network, times its smoothed share of the class's counts.
"""

from __future__ import annotations

import pickle
from itertools import repeat
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read, slices
from cairn.llm.gru import Gru, Lanes, Shape

#: Stands for the end of a text; no word holds a line break.
END = b"\n"
#: Commonest tokens whose counts are sent to every executor.
HEAD = 200_000
SHAPE = Shape(classes=32, members=32, rare=16, hidden=24)
ROUNDS = 3
#: How a token's number is written: of the words and rare classes there may be 65,536.
NUMBER = "<u2"
#: Held out: documents whose crc32 of the id, as text, leaves HELD_OUT[1] divided by HELD_OUT[0].
HELD_OUT = (7, 2)
#: Distinct tokens of slices that a counting task holds before it hands them on; tokens that the network runs over at once
#: (long documents take their steps beside many others).
HELD_TOKENS, TOKENS = 1_000_000, 3_000_000
#: Tokens of a text that the network learns from in one piece; between pieces its state is set to zero.
SEGMENT = 2048
#: Parameter vectors that one task adds up.
ADD = 16


def tokens(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def split(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """tokens() of every text, one after the other, and how many each has; without a Python object for each."""
    raw = [x.as_buffer() if x.is_valid else b"" for x in texts]
    whole = _LOWER[np.frombuffer(b" \n ".join([*raw, b""]), np.uint8)]  # the ends stand apart
    ends = np.cumsum([len(x) + 3 for x in raw]) - 2
    word = ~_SPACE[whole]
    word[ends] = True
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False)).reshape(-1, 2)
    offsets = np.append(0, np.cumsum(edge[:, 1] - edge[:, 0])).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(whole[word])])
    return found, np.diff(np.searchsorted(edge[:, 0], ends, "right"), prepend=0)


def rare_classes(words: pa.BinaryArray) -> np.ndarray:
    """By the first letter outside ASCII (its first two bytes, or none), and by length: 16 classes."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    size = np.diff(at)
    band = (size > 4).astype(np.int64) + (size > 7) + (size > 11)
    place = np.flatnonzero(raw & 0x80)
    owner = np.searchsorted(at, place, "right") - 1
    before = np.arange(len(owner)) - np.searchsorted(owner, owner)
    first = np.bincount(owner[before < 2], raw[place[before < 2]], len(size)).astype(np.int64)
    return np.where(np.bincount(owner, minlength=len(size)) > 0, 4 * (1 + first % 3) + band, band)


def is_held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A table of all texts, split once: a row for each slice of texts, and rows that count the training tokens.

    (ids, held_out, rounds, sizes: arrays with a member for each text; codes binary, its tokens as places in
    words array<binary>) and (token, cls, n), of which the same token may have several.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["ids", "held_out", "rounds", "sizes", "codes", "words", "token", "cls", "n"]

    def run(batches):
        held: list[tuple[pa.Array, np.ndarray]] = []
        id_type, many = None, 0

        def flush():
            if held:
                found = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
                total = np.bincount(found.indices.to_numpy(zero_copy_only=False), np.concatenate([c for _, c in held]), len(found.dictionary)).astype(np.int64)
                held.clear()
                n = len(total)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(n, pa.list_(t)) for t in (id_type, pa.bool_(), pa.int32(), pa.int32())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.binary())),
                     found.dictionary, pa.array(rare_classes(found.dictionary), pa.int32()), pa.array(total)],
                    names=names,
                ).filter(pa.array(total > 0))

        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch):
                flat, sizes = split(part.column(3))
                found = flat.dictionary_encode()
                codes, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary
                learn = np.repeat(~part.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
                held.append((words, np.bincount(codes[learn], minlength=len(words))))
                many += len(words)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                small = codes.astype("<u2" if len(words) <= 1 << 16 else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(whole(part.column(k)) for k in range(3)), whole(pa.array(sizes, pa.int32())), pa.array([small], pa.binary()), whole(words), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names=names
                )
                if many > HELD_TOKENS:
                    yield from flush()
                    many = 0
        yield from flush()

    schema = f"ids array<{kind}>, held_out array<boolean>, rounds array<int>, sizes array<int>, codes binary, words array<binary>, token binary, cls int, n long"
    part_of = F.pmod(F.xxhash64(id_col), F.lit(rounds)).cast("int")
    return materialize(docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), part_of.alias("round"), F.col(text_col).alias("text")).mapInArrow(run, schema))


class Lexicon:
    """What every executor needs of the counts: the head's, and the sums that normalise.

    The head is all tokens from some count on, so chosen that they are HEAD at most. ``tokens`` has them by
    falling count; the first ones are the network's words. After them, ``number``, ``log_count`` and ``far``
    have a place for the rest of each rare class.
    """

    def __init__(self, counts: DataFrame, shape: Shape):
        band = F.floor(F.log2("n") * 8).cast("int")
        least, room = 0, HEAD
        for r in sorted(counts.groupBy(band.alias("b")).count().collect(), key=lambda r: -r.b):  # 504 rows at most
            if r["count"] > room:
                least = r.b + 1
                break
            room -= r["count"]
        rows = counts.filter(band >= least).toArrow()
        token, n, cls = (rows.column(c).to_pylist() for c in ("token", "n", "cls"))
        order = sorted(range(len(token)), key=lambda i: (-n[i], token[i]))
        self.tokens = [token[i] for i in order]
        head_n, head_cls = (np.array([x[i] for i in order], np.int64) for x in (n, cls))
        words = min(shape.words, len(order))
        sums = {r.cls: r for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        self.n, self.v = sum(r.n for r in sums.values()), sum(r.v for r in sums.values())
        own = np.zeros(shape.words)
        own[:words] = head_n[:words]
        all_n, all_v = (np.array([getattr(sums[c], k) if c in sums else 0 for c in range(shape.rare)], float) for k in ("n", "v"))
        rare_n = all_n - np.bincount(head_cls[:words], head_n[:words], shape.rare)
        rare_v = all_v - np.bincount(head_cls[:words], minlength=shape.rare)
        self.counts = np.concatenate([own, rare_n])
        rest = np.arange(shape.rare)
        self.number = np.concatenate([np.arange(words), shape.words + np.concatenate([head_cls[words:], rest])])
        self.log_count = np.concatenate([np.log10(head_n + 1), np.zeros(shape.rare)])
        self.far = len(order)
        rare_log = np.log10(rare_n + rare_v + 1)
        #: What a token adds to the log-probability of its class.
        self.share = np.concatenate([np.zeros(words), (self.log_count[words:] - rare_log[self.number[words:] - shape.words])])


def _lanes(want: np.ndarray, sizes: np.ndarray, shape: Shape):
    fresh = np.zeros(len(want), np.float32)
    fresh[np.cumsum(sizes) - sizes] = 1
    given = np.where(fresh > 0, shape.words + shape.rare, np.roll(want, 1))
    return given, want, fresh, Lanes.pack(sizes)


def numbered(texts: DataFrame, sent) -> DataFrame:
    """A table of every text of a coded() table with its tokens as the network's numbers, and what needs no network.

    (key, id, held_out, round, want binary, n_tokens, known, base, share) for each row, and (key, token, tf)
    for its tokens outside the head. Only the words of a slice are looked up, each once.
    """
    kind = texts.schema["ids"].dataType.elementType.simpleString()
    fields = ["key", "id", "held_out", "round", "want", "n_tokens", "known", "base", "share", "token", "tf"]
    kinds = (pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches):
        lex = pickle.loads(sent.value)
        place, per_token, number = dict(zip(lex.tokens, range(lex.far), strict=True)), log10(lex.n + lex.v + 1), lex.number.astype(NUMBER)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held_out, part, sizes = (batch.column(k)[i].values for k in range(4))
                sizes, words = sizes.to_numpy().astype(np.int64), batch.column(5)[i].values
                raw = batch.column(4)[i].as_buffer()
                codes = np.frombuffer(raw, "<u2" if len(raw) == 2 * sizes.sum() else "<u4")
                of = np.fromiter(map(place.get, words.to_pylist(), repeat(-1)), np.int64, len(words))
                rest = np.flatnonzero(of < 0)
                of[rest] = lex.far + rare_classes(words.take(pa.array(rest)))
                d = len(sizes)
                keys = key + np.arange(d)
                key += d
                begin = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x[of][codes], begin)  # noqa: E731, B023
                want, far = number[of][codes], (of >= lex.far)[codes]
                wants = pa.array([want[a : a + n].tobytes() for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)], pa.binary())
                known = np.add.reduceat((~far).astype(np.int64), begin)
                numbers = (sizes, known, total(lex.log_count) - sizes * per_token, total(lex.share))
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids, held_out, part, wants, *map(pa.array, numbers), pa.nulls(d, pa.binary()), pa.nulls(d, pa.int64())], names=fields)
                rest = np.flatnonzero(far)
                pair, tf = np.unique(np.repeat(np.arange(d), sizes)[rest] * len(words) + codes[rest], return_counts=True)
                n = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[pair // len(words)]), pa.nulls(n, ids.type), *(pa.nulls(n, t) for t in kinds), words.take(pa.array(pair % len(words))), pa.array(tf.astype(np.int64))], names=fields
                )

    schema = f"key long, id {kind}, held_out boolean, round int, want binary, n_tokens long, known long, base double, share double, token binary, tf long"
    return materialize(texts.filter("codes IS NOT NULL").select("ids", "held_out", "rounds", "sizes", "codes", "words").mapInArrow(run, schema))


def _vector(weight: float, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([v.tobytes()], pa.binary())], names=["w", "v"])


def train(rows: DataFrame, counts: np.ndarray, shape: Shape = SHAPE, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters learned from all rows of ``rows`` (round, want), one vector of fixed length."""
    sc = rows.sparkSession.sparkContext
    vector = Gru.new(shape, counts).vector()
    for r in range(rounds):
        start = sc.broadcast(vector)

        def run(batches, start=start):
            model, seen, held, n = Gru.of(shape, start.value), 0, [], 0

            def learn():
                if held:
                    model.train(*_lanes(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)), shape))
                    held.clear()
                return n

            for batch in batches:
                for want in batch.column(0):
                    own = np.frombuffer(want.as_py(), NUMBER).astype(np.int32)
                    held += [own[k : k + SEGMENT] for k in range(0, len(own), SEGMENT)]
                    n += len(own)
                    if n > TOKENS:
                        seen, n = seen + learn(), 0
            seen += learn()
            if seen:
                yield _vector(seen, model.vector().astype(np.float64) * seen)

        def add(batches):
            w, v = 0.0, None
            for batch in batches:
                for i in range(batch.num_rows):
                    x = np.frombuffer(batch.column(1)[i].as_py())
                    w, v = w + batch.column(0)[i].as_py(), x if v is None else v + x
            if v is not None:
                yield _vector(w, v)

        kind = "w double, v binary"
        parts = materialize(rows.filter(F.col("round") == r).select("want").mapInArrow(run, kind))
        while (n := parts.count()) > ADD:
            parts = materialize(parts.repartition(-(-n // ADD)).mapInArrow(add, kind))
        sums = parts.collect()  # ADD vectors at most
        if total := sum(x.w for x in sums):
            vector = (sum(np.frombuffer(x.v) for x in sums) / total).astype(np.float32)
    return vector


def score(rows: DataFrame, counts: DataFrame, vector: np.ndarray, shape: Shape = SHAPE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score) of every row of a numbered() table: log10 probabilities."""
    params = rows.sparkSession.sparkContext.broadcast(vector)
    texts = rows.filter("want IS NOT NULL").select("key", "id", "held_out", "n_tokens", "known", "base", "share", "want")

    def run(batches):
        model, held, n = Gru.of(shape, params.value), [], 0

        def judge():
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("n_tokens").to_numpy()
            want = np.concatenate([np.frombuffer(x.as_buffer(), NUMBER) for c in table.column("want").chunks for x in c]).astype(np.int32)
            lp = model.score(*_lanes(want, sizes, shape)) / log(10)
            found = pa.array(table.column("share").to_numpy() + np.add.reduceat(lp, np.cumsum(sizes) - sizes))
            yield from table.drop_columns(["share", "want"]).append_column("model", found).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += pa.compute.sum(batch.column(3)).as_py()
            if n > TOKENS:
                yield from judge()
                held, n = [], 0
        if held:
            yield from judge()

    kind = rows.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(run, f"key long, id {kind}, held_out boolean, n_tokens long, known long, base double, model double")
    far = rows.filter("token IS NOT NULL").select("key", "token", "tf").join(counts.select("token", "n"), "token")
    far = far.groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("far"), F.sum("tf").alias("far_known"))
    more = F.coalesce("far", F.lit(0.0))
    return scored.join(far, "key", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = SHAPE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts are empty: one token, the end. Null ids count as the empty string (not held out); repeated
    rows are rows of their own, and train twice. Without training documents every count is zero. Other
    columns are not read; an empty table gives no rows.
    """
    docs = docs.select(id_col, text_col)
    texts = coded(docs, id_col, text_col)
    counts = materialize(texts.filter("token IS NOT NULL").groupBy("token", "cls").agg(F.sum("n").alias("n")))
    lexicon = Lexicon(counts, shape)
    rows = numbered(texts, docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon)))
    vector = train(rows.filter("want IS NOT NULL AND NOT held_out"), lexicon.counts, shape)
    return score(rows, counts, vector, shape).select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(lexicon.n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(read(spark, sf_dir, "documents"))
