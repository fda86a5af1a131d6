"""Python data source ``osm_pbf``: nodes, ways or relations of OpenStreetMap PBF files.

    register(spark)
    spark.read.format("osm_pbf").option("entity", "way").load("/data/area.osm.pbf")

Option ``entity`` (node, way, relation) is the pushed-down part of a scan: blocks are skipped group by
group. Files are listed by their blob headers only; ``blobs`` blobs (default 64) make a partition, so
executors inflate and decode in parallel. Paths (a list, or comma-separated) may be any that pyarrow.fs opens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAGS = "tags map<string,string>"
SCHEMAS = {
    "node": f"id bigint, lat double, lon double, {TAGS}",
    "way": f"id bigint, refs array<bigint>, {TAGS}",
    "relation": f"id bigint, members array<struct<type:string,ref:bigint,role:string>>, {TAGS}",
}
_MAP = pa.field("tags", pa.map_(pa.string(), pa.string()))
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), _MAP]),
    "way": pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), _MAP]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(_MEMBER)), _MAP]),
}
#: Fixed value: member types by number.
MEMBERS = ("node", "way", "relation")


def varint(buf, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(buf) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: ints for varints, slices for strings, messages and packed lists."""
    at, end = 0, len(buf)
    while at < end:
        key, at = varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(buf, at)
        elif kind == 2:
            n, at = varint(buf, at)
            value, at = buf[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = buf[at : at + n], at + n
        yield key >> 3, value


def unzigzag(x):
    return (x >> 1) ^ -(x & 1)


def packed(buf, signed: bool = False) -> np.ndarray:
    """A packed list of varints, all at once."""
    raw = np.frombuffer(buf, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 0x80)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    values = np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)
    return ((values >> np.uint64(1)) ^ (~(values & np.uint64(1)) + np.uint64(1))).view(np.int64) if signed else values.view(np.int64)


def inflate(blob) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return bytes(parts[1])
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("this blob is neither raw nor zlib-compressed")


def _tags(words, keys, values):
    return [(words[k], words[v]) for k, v in zip(keys.tolist(), values.tolist(), strict=True)]


def elements(block: bytes, entity: str) -> Iterator[tuple]:
    """Rows of one kind in a primitive block."""
    words, groups, scale, dy, dx = [], [], 100, 0, 0
    for n, v in fields(memoryview(block)):
        if n == 1:
            words = [bytes(w).decode("utf-8", "replace") for _, w in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n in (17, 19, 20):
            v = v - (1 << 64) if v >> 63 else v
            scale, dy, dx = (v, dy, dx) if n == 17 else (scale, v, dx) if n == 19 else (scale, dy, v)
    wanted = {"node": (1, 2), "way": (3,), "relation": (4,)}[entity]
    for group in groups:
        for n, v in fields(group):
            if n not in wanted:
                continue
            if n == 2:
                yield from _dense(dict(fields(v)), words, scale, dy, dx)
                continue
            one = dict(fields(v))
            tags = _tags(words, packed(one.get(2, b"")), packed(one.get(3, b"")))
            if n == 1:
                yield unzigzag(one[1]), (dy + scale * unzigzag(one[8])) / 1e9, (dx + scale * unzigzag(one[9])) / 1e9, tags
            elif n == 3:
                yield one[1], np.cumsum(packed(one.get(8, b""), True)).tolist(), tags
            else:
                refs, kinds, roles = np.cumsum(packed(one.get(9, b""), True)).tolist(), packed(one.get(10, b"")).tolist(), packed(one.get(8, b"")).tolist()
                yield one[1], [{"type": MEMBERS[k], "ref": r, "role": words[w]} for k, r, w in zip(kinds, refs, roles, strict=True)], tags


def _dense(d, words, scale, dy, dx):
    ids, lat, lon = (np.cumsum(packed(d.get(k, b""), True)) for k in (1, 8, 9))
    marks = packed(d.get(10, b"")).tolist()
    at = 0
    for i, y, x in zip(ids.tolist(), ((dy + scale * lat) / 1e9).tolist(), ((dx + scale * lon) / 1e9).tolist(), strict=True):
        tags = []
        while at < len(marks) and marks[at]:
            tags.append((words[marks[at]], words[marks[at + 1]]))
            at += 2
        at += 1
        yield i, y, x, tags


@dataclass
class Blobs(InputPartition):
    path: str
    start: int
    count: int


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(name)


def headers(f) -> Iterator[tuple[int, str, int]]:
    """(offset, kind, size of the blob) of every blob from the file's position on."""
    while len(head := f.read(4)) == 4:
        at = f.tell() - 4
        parts = dict(fields(f.read(int.from_bytes(head, "big"))))
        yield at, bytes(parts[1]).decode(), parts[3]
        f.seek(f.tell() + parts[3])


class Reader(DataSourceReader):
    def __init__(self, options, schema):
        listed = json.loads(options["paths"]) if "paths" in options else []  # load([a, b])
        self.paths = [p for path in [*listed, options.get("path", "")] for p in path.split(",") if p]
        self.entity, self.blobs, self.schema = options.get("entity", "node"), int(options.get("blobs", 64)), schema

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as f:
                at = [offset for offset, kind, _ in headers(f) if kind == "OSMData"]
            out += [Blobs(path, at[k], len(at[k : k + self.blobs])) for k in range(0, len(at), self.blobs)]
        return out

    def read(self, partition):
        schema = ARROW[self.entity]
        with _open(partition.path) as f:
            f.seek(partition.start)
            left = partition.count
            while left:
                size = int.from_bytes(f.read(4), "big")
                parts = dict(fields(f.read(size)))
                blob = f.read(parts[3])
                if bytes(parts[1]) != b"OSMData":
                    continue
                left -= 1
                rows = list(elements(inflate(blob), self.entity))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return SCHEMAS[self.options.get("entity", "node")]

    def reader(self, schema):
        return Reader(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(OsmPbf)
