"""Spherical grid cells: the cube-face quadratic projection of the public S2 library.

A cell's key packs (face, i, j) of its level: face * 4**level + i * 2**level + j. Keys are computed by
Arrow functions; s2_cell_id() gives the Hilbert id of the library for exchange with other tools.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREET_LEVEL, ADMIN_LEVEL = 17, 10
#: Own cell first, then the neighbours row by row: the order in which ties are broken.
OFFSETS = ((0, 0), *((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))


def xyz_of(lat, lon):
    phi, theta = np.radians(lat), np.radians(lon)
    return np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)


def face_uv(x, y, z):
    ax, ay, az = np.abs(x), np.abs(y), np.abs(z)
    axis = np.where((ax >= ay) & (ax >= az), 0, np.where(ay >= az, 1, 2))
    main = np.choose(axis, (x, y, z))
    face = axis + 3 * (main < 0)
    u = np.choose(face, (y, -x, -x, z, z, -y)) / np.choose(face, (x, y, z, x, y, z))
    v = np.choose(face, (z, z, -y, y, -x, -x)) / np.choose(face, (x, y, z, x, y, z))
    return face, u, v


def xyz_from_face(face, u, v):
    one = np.ones_like(u)
    return (
        np.choose(face, (one, -u, -u, -one, v, v)),
        np.choose(face, (u, one, -v, -v, -one, u)),
        np.choose(face, (v, v, one, -u, -u, -one)),
    )


def quadratic(u):
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def face_ij(lat, lon, level: int):
    face, u, v = face_uv(*xyz_of(lat, lon))
    n = 1 << level
    return face, *(np.clip(np.floor(quadratic(c) * n).astype(np.int64), 0, n - 1) for c in (u, v))


def pack(face, i, j, level: int):
    return (np.asarray(face, np.int64) << 2 * level) | (i << level) | j


def unpack(key, level: int):
    mask = (1 << level) - 1
    return key >> 2 * level, (key >> level) & mask, key & mask


def keys(lat, lon, level: int) -> np.ndarray:
    return pack(*face_ij(np.asarray(lat, float), np.asarray(lon, float), level), level)


def beside(key, di: int, dj: int, level: int) -> np.ndarray:
    """The cell so many steps away; over an edge of its face by the linear map of the neighbouring face."""
    n = 1 << level
    face, i, j = unpack(np.asarray(key, np.int64), level)
    i, j = np.clip(i + di, -1, n), np.clip(j + dj, -1, n)
    over = (i < 0) | (i >= n) | (j < 0) | (j >= n)
    out = pack(face, np.clip(i, 0, n - 1), np.clip(j, 0, n - 1), level)
    if over.any():
        limit = 1 + 2.0**-50
        u, v = (np.clip((2 * c[over] + 1) / n - 1, -limit, limit) for c in (i, j))
        new, u, v = face_uv(*xyz_from_face(face[over], u, v))
        out[over] = pack(new, *(np.clip(np.floor(0.5 * (c + 1) * n).astype(np.int64), 0, n - 1) for c in (u, v)), level)
    return out


def block(key, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cells and their neighbours (8; 7 at a corner of the cube), each once, in the order of OFFSETS; and how many."""
    every = np.stack([beside(key, a, b, level) for a, b in OFFSETS], 1)
    first = np.ones(every.shape, bool)
    for k in range(1, every.shape[1]):
        first[:, k] = (every[:, :k] != every[:, k : k + 1]).all(1)
    return every[first], first.sum(1)


def _on_faces(a, b):
    """(line, face, u0, v0, u1, v1) of each part of the chords from a to b that is seen from a face of the cube.

    A point is a face's if no other of its coordinates outweighs the face's own: four bounds on the place t
    along the chord, each of them linear.
    """
    parts = []
    for face in range(6):
        axis, sign = face % 3, 1 - 2 * (face // 3)
        low, high = np.zeros_like(a[0]), np.ones_like(a[0])
        for k in {0, 1, 2} - {axis}:
            for side in (1, -1):
                g0, g1 = (sign * p[axis] + side * p[k] for p in (a, b))
                meet = -g0 / np.where(g1 == g0, 1, g1 - g0)
                low = np.where(g1 > g0, np.maximum(low, meet), low)
                high = np.where(g1 < g0, np.minimum(high, meet), np.where((g1 == g0) & (g0 < 0), -1, high))
        line = np.flatnonzero(low <= high)
        ends = []
        for t in (low[line], high[line]):
            x, y, z = (p[line] * (1 - t) + q[line] * t for p, q in zip(a, b, strict=True))
            main = np.maximum((x, y, z)[axis] * sign, 1e-300)
            ends += [(y, -x, -x, -z, -z, y)[face] / main, (z, z, -y, -y, x, x)[face] / main]
        parts.append((line, np.full(len(line), face), *ends))
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def under(lat0, lon0, lat1, lon1, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell) for every cell that a geodesic segment passes through; a cell may come twice.

    On a face's plane geodesics are straight, and so are the borders of cells: a segment is cut where it
    meets the borders between its ends, and each piece lies in the cell of its middle. Segments between
    faces are cut into their parts on each.
    """
    a, b = xyz_of(lat0, lon0), xyz_of(lat1, lon1)
    face, u0, v0 = face_uv(*a)
    other, u1, v1 = face_uv(*b)
    seg = np.arange(len(face))
    if (apart := face != other).any():
        line, *rest = _on_faces(*([c[apart] for c in p] for p in (a, b)))
        own = (seg, face, u0, v0, u1, v1)
        seg, face, u0, v0, u1, v1 = (np.concatenate([x[~apart], y]) for x, y in zip(own, (seg[apart][line], *rest), strict=True))
    n = 1 << level
    at = lambda c: np.clip(np.floor(quadratic(c) * n).astype(np.int64), 0, n - 1)
    whose, where = [np.arange(len(seg))] * 2, [np.zeros(len(seg)), np.ones(len(seg))]
    for c0, c1 in ((u0, u1), (v0, v1)):
        low, high = np.minimum(at(c0), at(c1)), np.maximum(at(c0), at(c1))
        line = np.repeat(np.arange(len(seg)), high - low)
        border = np.arange(len(line)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[line] + 1
        whose.append(line)
        where.append(np.clip((unquadratic(border / n) - c0[line]) / (c1 - c0)[line], 0, 1))
    whose, where = np.concatenate(whose), np.concatenate(where)
    order = np.lexsort((where, whose))
    whose, where = whose[order], where[order]
    inner = (whose[1:] == whose[:-1]) & (where[1:] - where[:-1] > 1e-12)
    line, middle = whose[:-1][inner], ((where[1:] + where[:-1]) / 2)[inner]
    i, j = at(u0[line] + middle * (u1 - u0)[line]), at(v0[line] + middle * (v1 - v0)[line])
    return seg[line], pack(face[line], i, j, level)


def unquadratic(s):
    """Where a part of a face's edge lies on the projected face."""
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) * (1 - s)) / 3)


def centre(key, level: int):
    face, i, j = unpack(np.asarray(key, np.int64), level)
    x, y, z = xyz_from_face(face, *(unquadratic((c + 0.5) / (1 << level)) for c in (i, j)))
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


#: Order of the four quarters along the curve, and how each turns it.
_QUARTER = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
_TURN = np.array([1, 0, 0, 3])


def hilbert(key, level: int) -> np.ndarray:
    """The library's 64-bit cell id, as a signed number."""
    face, i, j = unpack(np.asarray(key, np.int64), level)
    turn, at = face & 1, np.zeros_like(face)
    for bit in range(level - 1, -1, -1):
        q = _QUARTER[turn, 2 * ((i >> bit) & 1) + ((j >> bit) & 1)]
        at, turn = at * 4 + q, turn ^ _TURN[q]
    low = 2 * (30 - level)
    with np.errstate(over="ignore"):
        return (face.astype(np.uint64) << np.uint64(61) | (at.astype(np.uint64) << np.uint64(low + 1)) | np.uint64(1 << low)).view(np.int64)


def _points(lat: pa.Array, lon: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, with zeros where one is missing or not finite, and where that is so."""
    lat, lon = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in (lat, lon))  # null: not a number
    bad = ~(np.isfinite(lat) & np.isfinite(lon))
    return np.where(bad, 0, lat), np.where(bad, 0, lon), bad


def cell(lat: Column, lon: Column, level: int = STREET_LEVEL) -> Column:
    """Key of the cell that holds the point; null for missing or non-finite coordinates."""

    def run(lat: pa.Array, lon: pa.Array) -> pa.Array:
        lat, lon, bad = _points(lat, lon)
        return pa.array(keys(lat, lon, level), mask=bad)

    return F.arrow_udf(run, "long")(lat.cast("double"), lon.cast("double"))


def cells_around(lat: Column, lon: Column, level: int = STREET_LEVEL) -> Column:
    """array<long>: own cell and neighbours; null for missing or non-finite coordinates."""

    def run(lat: pa.Array, lon: pa.Array) -> pa.Array:
        lat, lon, bad = _points(lat, lon)
        flat, n = block(keys(lat, lon, level), level)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat), mask=pa.array(bad))

    return F.arrow_udf(run, "array<long>")(lat.cast("double"), lon.cast("double"))


def s2_cell_id(lat: Column, lon: Column, level: int = STREET_LEVEL) -> Column:
    def run(lat: pa.Array, lon: pa.Array) -> pa.Array:
        lat, lon, bad = _points(lat, lon)
        return pa.array(hilbert(keys(lat, lon, level), level), mask=bad)

    return F.arrow_udf(run, "long")(lat.cast("double"), lon.cast("double"))


def cell_centre(key: Column, level: int = STREET_LEVEL) -> Column:
    """struct<lat, lon> of the cell's centre; null for a missing key."""

    def run(key: pa.Array) -> pa.Array:
        lat, lon = centre(key.fill_null(0).to_numpy(), level)
        return pa.StructArray.from_arrays([pa.array(lat), pa.array(lon)], names=["lat", "lon"], mask=key.is_null())

    return F.arrow_udf(run, "lat double, lon double")(key)


def probes(points: DataFrame, level: int = STREET_LEVEL) -> DataFrame:
    """Each point with each cell around it: adds ``probe_rank`` (0: own cell) and ``cell``."""
    return points.select("*", F.posexplode(cells_around(F.col("lat"), F.col("lon"), level)).alias("probe_rank", "cell"))


def vertices(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array<struct<lat, lon>>: where each list begins and the last ends, and all coordinates."""
    flat = lines.flatten()
    n = np.asarray(lines.value_lengths().fill_null(0))
    lat, lon = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in ("lat", "lon"))
    return np.append(0, np.cumsum(n)), lat, lon


def cells_of_line(nodes: Column, level: int = STREET_LEVEL) -> Column:
    """array<long>: the cells that a polyline passes through, each once. One point is a line of its own."""

    def run(lines: pa.Array) -> pa.Array:
        at, lat, lon = vertices(lines)
        n = np.diff(at)
        of = np.repeat(np.arange(len(n)), n)
        last = np.zeros(len(of), bool)
        last[at[1:][n > 1] - 1] = True
        begin = np.flatnonzero(~last)
        end = begin + (n[of[begin]] > 1)
        seg, cell = under(lat[begin], lon[begin], lat[end], lon[end], level)
        found = np.unique(np.stack([of[begin][seg], cell], 1), axis=0) if len(seg) else np.zeros((0, 2), np.int64)
        starts = np.searchsorted(found[:, 0], np.arange(len(n) + 1))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found[:, 1]), mask=lines.is_null())

    return F.arrow_udf(run, "array<long>")(nodes)
