"""Tiled lookups against a comparison of every pair, and their plans."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import cells
from cairn.operators import index, lookup, near, osm
from cairn.streaming.lookup import geocode_stream

LEVEL = 17


def lines_of(rng, n, at, spread, nodes, grid):
    """Lines of 1 to ``nodes`` nodes on a grid, so that distances tie."""
    size = rng.integers(1, nodes + 1, n)
    begin = np.round((rng.normal(0, spread, (n, 2)) + at) / grid) * grid
    return [[tuple(p) for p in np.round((b + np.cumsum(rng.normal(0, 2e-4, (k, 2)), 0)) / grid) * grid] for b, k in zip(begin, size, strict=True)]


def posted_in(line, single):
    lat, lon = np.array(line).T
    if single or len(line) == 1:
        return sorted(set(cells.keys(lat, lon, LEVEL).tolist()))
    return sorted(set(cells.under(lat[:-1], lon[:-1], lat[1:], lon[1:], LEVEL)[1].tolist()))


def slow(lat, lon, lines, posted, single):
    """(line, dist) by comparing with every line that is posted around the point."""
    around = [int(cells.beside(cells.keys([lat], [lon], LEVEL), a, b, LEVEL)[0]) for a, b in cells.OFFSETS]
    best = None
    for k, line in enumerate(lines):
        ranks = [r for r, c in enumerate(around) if c in posted[k]]
        ends = [(p, p) for p in line] if single else list(zip(line[:-1], line[1:], strict=True))
        for seg, ((y, x), (y2, x2)) in enumerate(ends if ranks else []):
            dy, dx = y2 - y, x2 - x
            n = dy * dy + dx * dx
            t = 0.0 if n == 0 else max(0.0, min(1.0, ((lat - y) * dy + (lon - x) * dx) / n))
            cos = np.cos(np.radians(lat))
            d = np.radians(lat - (y + t * dy)) ** 2 + np.radians(lon - (x + t * dx)) ** 2 * cos * cos
            best = min(best or (np.inf,), (d, ranks[0], k, seg))
    return best and (best[2], best[0], best[3])


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("few", [0, 8, 10**9])
@pytest.mark.parametrize("at", [(43.7, 7.4), (-33.0, 179.9999), (45.0, 45.0), (0.0, 0.0)])
def test_lines_against_every_pair(monkeypatch, single, few, at):
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "PAIRS", 500)
    rng = np.random.default_rng(5)
    lines = lines_of(rng, 150, at, 1e-4, 1 if single else 4, 5e-5) + lines_of(rng, 60, at, 2e-3, 1 if single else 6, 5e-5)
    posted = [posted_in(x, single) for x in lines]
    if not single:  # a partial index
        posted = [x[: 1 + k % 3] for k, x in enumerate(posted)]
    lat, lon = (np.round((rng.normal(0, 1e-3, (120, 2)) + at) / 5e-5) * 5e-5).T
    key = cells.keys(lat, lon, LEVEL)
    around = np.stack([cells.beside(key, a, b, LEVEL) for a, b in cells.OFFSETS], 1)
    nodes = pa.array([[{"lat": a, "lon": b} for a, b in x] for x in lines], pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))
    # The same rows in two tiles, of which the points lie in one or the other.
    twice = near.Lines(np.repeat([0, 1], len(lines)), pa.array(posted * 2, pa.list_(pa.int64())), pa.concat_arrays([nodes, nodes]), LEVEL, single)
    tile = np.arange(len(lat)) % 2
    row, dist, seg, _ = twice.nearest(near.Points(tile, lat, lon, np.cos(np.radians(lat)), around))
    for k in range(len(lat)):
        want = slow(lat[k], lon[k], lines, [set(x) for x in posted], single)
        got = None if row[k] < 0 else (int(row[k]) - tile[k] * len(lines), dist[k], int(seg[k]))
        assert got == want


@pytest.mark.parametrize("level", [0, 1, 2, 4])
def test_cells_are_around_each_other(level):
    """Index rows go to the tiles around their cells, points look around their own: both must mean the same."""
    every = np.arange(6 * 4**level)
    pairs = {(k, n) for a, b in cells.OFFSETS for k, n in zip(every.tolist(), cells.beside(every, a, b, level).tolist(), strict=True)}
    assert pairs == {(n, k) for k, n in pairs}


def test_tiles_are_cut_between_tiles(monkeypatch):
    monkeypatch.setattr(near, "ROWS", 4)
    table = lambda tile, side: pa.table({"tile": pa.array(tile, pa.int64()), "side": side})
    ready, kept = near._cut(table([1, 1, 2, 2], [0, 9, 0, 9]))
    assert (len(ready), len(kept)) == (2, 2)
    ready, kept = near._cut(table([None, None, 2, 2], [9, 9, 0, 9]))
    assert (len(ready), len(kept)) == (2, 2)
    ready, kept = near._cut(table([2] * 6, [0] * 2 + [9] * 4))
    assert (len(ready), kept["side"].to_pylist()) == (6, [0, 0])
    assert near._cut(table([2] * 6, [0] * 5 + [9]))[0] is None


def saved(spark, tmp_path):
    at = lambda k, c: ((F.col("id") * k) % 997 / 1e5 + c).cast("double")
    rows = spark.range(3000).select("id", at(7919, 43.7).alias("lat"), at(104729, 7.4).alias("lon"))
    rows.select(F.col("id").alias("qid"), "lat", "lon").write.parquet(f"{tmp_path}/points")
    index.address_cells(rows.selectExpr("id AS addr_id", "lat + 1e-5 AS lat", "lon", "'1' AS housenumber", "'R' AS street")).write.parquet(f"{tmp_path}/addr_cells")
    node = lambda up: F.struct((F.col("lat") + up).cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"))
    nodes = F.array(node(0.0), node(1e-4))
    ways = rows.select(F.col("id").alias("way_id"), F.lit("W").alias("name"), nodes.alias("nodes"))
    ways.write.parquet(f"{tmp_path}/street_ways")
    index.line_cells(ways, "way_id").write.parquet(f"{tmp_path}/street_cells")
    return [spark.read.parquet(f"{tmp_path}/{t}") for t in ("points", "addr_cells", "street_cells", "street_ways")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_address_broadcasts_nothing(spark, tmp_path):
    points, addr, _, _ = saved(spark, tmp_path)
    best = lookup.nearest_address(points, addr)
    assert "Broadcast" not in plan(best)
    assert best.count() == 3000


def test_nearest_street_broadcasts_nothing(spark, tmp_path):
    points, _, street_cells, street_ways = saved(spark, tmp_path)
    best = lookup.nearest_street(points, street_cells, street_ways)
    assert "Broadcast" not in plan(best)
    assert best.filter("dist < 1e-13").count() == 3000


def test_house_numbers_broadcast_no_addresses(spark, tmp_path):
    _, addr, _, street_ways = saved(spark, tmp_path)
    # An end of each way lies on address 7's place, the other one nowhere.
    ways = street_ways.filter("way_id = 7").withColumn("nodes", F.expr("transform(nodes, (n, i) -> IF(i = 0, named_struct('lat', CAST(n.lat + 1e-5 AS float), 'lon', n.lon), n))"))
    found = osm.with_numbers(ways, addr).filter("start_number > 0")
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.select("way_id", "start_number", "end_number").collect()] == [(7, 1, 0)]


def all_tables(spark, tmp_path):
    points, addr, street_cells, street_ways = saved(spark, tmp_path)
    square = [(43.0, 7.0), (43.0, 8.0), (44.0, 8.0), (44.0, 7.0)]
    area = spark.createDataFrame([(k, f"A{k}", 2 * k, "FR", [{"lat": a, "lon": b} for a, b in square], 1.0) for k in (1, 2)], "poly_id long, name string, admin_level int, country_code string, vertices array<struct<lat:float,lon:float>>, area float")
    return points, {"addr_cells": addr, "street_cells": street_cells, "street_ways": street_ways, "admin_polygons": area, "admin_cells": index.polygon_cells(area)}


def broadcasts_points(text):
    """Whether there is anything of the points below a broadcast."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            if "qid" in "".join(lines[k:end]):
                return True
    return False


def test_reverse_geocode_broadcasts_no_points(spark, tmp_path):
    points, tables = all_tables(spark, tmp_path)
    out = lookup.reverse_geocode(points, tables)
    assert not broadcasts_points(plan(out))
    assert {tuple(r) for r in out.select("road", "house_number", "country", "state").distinct().collect()} == {("R", "1", "A1", "A2")}


def test_reverse_geocode_does_not_shuffle_pairs_to_make_them_distinct(spark, tmp_path):
    points, tables = all_tables(spark, tmp_path)
    out = lookup.reverse_geocode(points, {k: tables[k] for k in index.MODES["admin_only"]})
    assert not any("Exchange hashpartitioning(qid" in x and "poly_id" in x for x in plan(out).split("\n"))


def test_stream_broadcasts_no_points(spark, tmp_path):
    points, tables = all_tables(spark, tmp_path)
    seen = []
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/points")
    geocode_stream(stream, tables, lambda df, n: seen.append((plan(df), df.filter("road = 'R' AND country = 'A1'").count())), f"{tmp_path}/state").awaitTermination()
    assert sum(n for _, n in seen) == 3000
    assert not any(broadcasts_points(text) for text, _ in seen)
