"""What the corpus operators share: word rules, bounded batches, shared storage, skew-proof joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of characters other than space and \\t..\\r. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in HOT_SHARE of all rows is hot; at most HOT_SHARE keys can be.
HOT_SHARE = 512
#: Bytes of text that an Arrow function works on at once; bytes of an Arrow batch.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Narrow rows (of about 100 bytes) that are broadcast, at most.
FEW_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table. Where the session has no own size of Arrow batches, BATCH_BYTES is set: executors hold
    several batches in the JVM and in Python, and texts make the usual ones large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "64m", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` (a written table of narrow rows), to be broadcast if it has ``rows`` at most; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


#: Folders that this process has written to.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, base, True)
    _WRITTEN.append(f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> int:
    """Removes all intermediate tables that this process has written; results that read them are of no more use.
    How many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key), safe if one key holds most of ``left``.

    ``count`` is the column of ``right`` with the key's rows in ``left``, of ``total``. Keys with over
    total/HOT_SHARE rows are HOT_SHARE at most, so they are broadcast; the others meet in a shuffle, in
    which rows that have found their match already, or have no key, are dealt out evenly.
    """
    cols = [c for c in right.columns if c != key]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    pack = F.struct(*cols)
    hot = right.filter(is_hot).select(key, pack.alias("_hot"))
    cold = right.filter(~is_hot).select(key, F.lit(0).cast("long").alias("_salt"), pack.alias("_cold"))
    found = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)))
    )
    both = found.join(cold, [key, "_salt"], "left").withColumn("_pack", F.coalesce("_hot", "_cold"))
    return both.select(*left.columns, *(F.col(f"_pack.{c}").alias(c) for c in cols))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, a row at least: bounds what is held at once."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` and more fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items())])


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest hash of ``key`` (all, if fewer), without sorting more than about n rows.

    A share of the hash's range that holds more than n rows with near certainty is filtered first, so that
    partitions hand on few rows whatever their number.
    """
    total = df.count()
    share = min(1.0, (n + 6 * n**0.5 + 50) / total) if total else 1.0
    h = F.xxhash64(key)
    return df.filter(h <= F.lit(int((share - 0.5) * 2.0**64) if share < 1 else (1 << 63) - 1)).orderBy(h, key).limit(n)
