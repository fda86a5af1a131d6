"""Streams of points and of requests.

A point's best candidate is chosen per micro-batch (foreachBatch), where aggregates need no watermark. The
limiter keeps its two counters per key as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators import lookup

UNITS = {"second": 1, "minute": 60, "day": 86_400}


def geocode_stream(points: DataFrame, index: dict[str, DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that geocodes each micro-batch of ``points`` and hands it to ``sink`` (called again after a failure: it should overwrite its batch)."""
    return points.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: sink(lookup.reverse_geocode(df, index), n)).start()


def limit_stream(valid: DataFrame, short: str = "second", long: str = "day") -> DataFrame:
    """``valid`` (req_id, ts, rate_key, rate_per_second, rate_per_day; streaming) -> (req_id, status), by arrival.

    Within a micro-batch requests of a key are taken by time, so a batch run over the same order agrees.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s_at, s_n, d_at, d_n = state.get if state.exists else (-1, 0, -1, 0)
        own = list(frames)  # a key's requests of one micro-batch
        if own:
            f, status = pd.concat(own).sort_values(["ts", "req_id"]), []
            seconds = f["ts"].astype("int64") // {"ns": 10**9, "us": 10**6, "ms": 10**3, "s": 1}[f["ts"].dt.unit]
            for t, rps, rpd in zip(seconds, f["rate_per_second"], f["rate_per_day"], strict=True):
                a, b = t // UNITS[short], t // UNITS[long]
                s_n, d_n = (s_n if a == s_at else 0), (d_n if b == d_at else 0)
                s_at, d_at = a, b
                if rps:
                    s_n += 1
                ok = not rps or s_n <= rps
                if ok and rpd:
                    d_n += 1
                    ok = d_n <= rpd
                status.append(200 if ok else 429)
            yield pd.DataFrame({"req_id": f["req_id"], "status": pd.array(status, "int32")})
        state.update((int(s_at), int(s_n), int(d_at), int(d_n)))

    return valid.groupBy("rate_key").applyInPandasWithState(run, "req_id long, status int", "s_at long, s_n long, d_at long, d_n long", "append", GroupStateTimeout.NoTimeout)


def _through(spark, df: DataFrame, start: Callable[[DataFrame, str], object], name: str) -> None:
    """Sends a table through a stream: written to the shared folder, then read as a stream until it is done."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import atexit
        import shutil
        import tempfile

        base = tempfile.mkdtemp(prefix="cairn-stream-")
        atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    start(spark.readStream.schema(df.schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


def stream_rate_limit(spark, d: str) -> DataFrame:
    from cairn.plans.queries import requests

    valid = requests(spark, d).filter("login IS NOT NULL").select("req_id", "ts", "rate_key", "rate_per_second", "rate_per_day")

    def start(stream, path):
        return limit_stream(stream, "minute", "day").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()

    return spark.read.schema("req_id long, status int").parquet(f"{_through(spark, valid, start, 'limit')}/out")


def stream_lookup(spark, d: str) -> DataFrame:
    from cairn.plans.queries import index_tables, points

    out: list[str] = []

    def start(stream, path):
        out.append(f"{path}/out")
        return geocode_stream(stream, index_tables(spark, d), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/state")

    _through(spark, points(spark, d), start, "lookup")
    return spark.read.parquet(out[0]).drop("batch")


def _oracles() -> dict[str, str]:
    from cairn.plans.queries import ORACLES, _REQ, _sql

    return {"stream_lookup": ORACLES["reverse_geocode"], "stream_rate_limit": _sql("SELECT req_id, status FROM limited WHERE status <> 401", **_REQ)}


QUERIES = {"stream_lookup": stream_lookup, "stream_rate_limit": stream_rate_limit}
ORACLES = _oracles()
