"""Geometry as column expressions, and as Arrow functions where an expression cannot say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highways that are not streets, and codes of interpolation schemes.
EXCLUDED_HIGHWAYS = ("footway", "path", "track", "steps", "cycleway", "service", "pedestrian", "bridleway", "construction")
INTERPOLATION = {"even": 1, "odd": 2}
MAX_VERTICES = 500
D = "double"


def coord_key(lat: Column, lon: Column) -> Column:
    """Both coordinates in steps of 1e-7 degree, half away from zero, in one number."""
    step = lambda c: (c * 1e7 + F.when(c >= 0, 0.5).otherwise(-0.5)).cast("long")
    return F.shiftleft(step(lat), 32).bitwiseOR(step(lon).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def grid_key(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates in steps of 1e-5 degree, cut towards zero in single precision: how line ends meet addresses."""
    step = lambda c: (c.cast("float") * F.lit(100000).cast("float")).cast("int")
    return step(lat), step(lon)


def polygon_area(vertices: Column) -> Column:
    """Shoelace area in square degrees, single precision."""
    lead = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    cross = F.zip_with(vertices, lead, lambda a, b: a["lat"].cast(D) * b["lon"].cast(D) - b["lat"].cast(D) * a["lon"].cast(D))
    return (F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2).cast("float")


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross properly (touching is not crossing)."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    apart = lambda u, v: ((u > 0) & (v < 0)) | ((u < 0) & (v > 0))
    return apart(side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)) & apart(side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by))


def house_number(s: Column) -> Column:
    """Leading digits as a number; 0 without any."""
    return F.coalesce(F.regexp_extract(s, "^[0-9]+", 0).try_cast("long"), F.lit(0).cast("long"))


def is_street(highway: Column) -> Column:
    return highway.isNotNull() & ~highway.isin(*EXCLUDED_HIGHWAYS)


def interpolation_code(scheme: Column) -> Column:
    return F.when(scheme == "even", 1).when(scheme == "odd", 2).otherwise(0)


def is_border_line(level: Column, country: Column, name: Column) -> Column:
    """A relation that draws a border between two countries rather than one country."""
    return (level == 2) & (F.coalesce(country, F.lit("")) == "") & (name.contains(" - ") | name.contains(" — "))


def dist_sq(dlat: Column, dlon: Column, cos: Column) -> Column:
    """Squared distance in radians from differences in degrees, longitudes scaled by the query's cosine."""
    return F.pow(F.radians(dlat), 2) + F.pow(F.radians(dlon), 2) * cos * cos


def to_segment(lat: Column, lon: Column, cos: Column, a: Column, b: Column) -> Column:
    """struct<dist, t>: squared distance to the segment, and where its nearest point lies (in raw degrees)."""
    x1, y1, x2, y2 = (c.cast(D) for c in (a["lat"], a["lon"], b["lat"], b["lon"]))
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lat - x1) * dx + (lon - y1) * dy) / F.when(n == 0, 1.0).otherwise(n))))
    return F.struct(dist_sq(lat - (x1 + t * dx), lon - (y1 + t * dy), cos).alias("dist"), t.alias("t"))


def segments(nodes: Column) -> Column:
    """array<struct<a, b>> of consecutive nodes."""
    n = F.greatest(F.size(nodes) - 1, F.lit(0))
    return F.zip_with(F.slice(nodes, 1, n), F.slice(nodes, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(lat: Column, lon: Column, vertices: Column) -> Column:
    """Even-odd rule in single precision throughout."""
    f = "float"
    y, x = lat.cast(f), lon.cast(f)
    before = F.concat(F.slice(vertices, -1, 1), F.slice(vertices, 1, F.greatest(F.size(vertices) - 1, F.lit(0))))

    def crosses(i, j):
        slope = (((j["lat"] - i["lat"]) * (x - i["lon"])).cast(f) / F.when(j["lon"] == i["lon"], F.lit(None)).otherwise(j["lon"] - i["lon"])).cast(f)
        return ((i["lon"] > x) != (j["lon"] > x)) & (y < (slope + i["lat"]).cast(f))

    hits = F.zip_with(vertices, before, lambda i, j: F.coalesce(crosses(i, j), F.lit(False)))
    return F.aggregate(hits, F.lit(False), lambda s, h: s != h)


def interpolated(start: Column, end: Column, t: Column, code: Column) -> Column:
    """House number at the part t of the way; even and odd schemes go in steps of two from the start, never down."""
    raw = start + t * (end - start)
    stepped = start + 2 * F.greatest(F.lit(0), F.round((raw - start) / 2).cast("long"))
    return F.when(code.isin(1, 2), stepped).otherwise(F.greatest(F.lit(0), F.round(raw).cast("long")))


def rotated(ring: Column) -> Column:
    """A closed ring turned to begin (and end) at its smallest vertex; an open one unchanged."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    closed = (F.abs(first["lat"] - last["lat"]) < 1e-7) & (F.abs(first["lon"] - last["lon"]) < 1e-7)
    open_ring = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    at = F.array_position(open_ring, F.array_min(open_ring)).cast("int")
    turned = F.concat(F.slice(open_ring, at, F.size(open_ring)), F.slice(open_ring, F.lit(1), at - 1))
    return F.when(closed & (F.size(ring) > 1), F.concat(turned, F.slice(turned, 1, 1))).otherwise(ring)


def has_duplicates(ring: Column) -> Column:
    """Whether a vertex repeats, the closing one aside."""
    body = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    marks = F.transform(body, lambda p: coord_key(p["lat"], p["lon"]))
    return F.size(F.array_distinct(marks)) < F.size(marks)


def crossing(ring: np.ndarray) -> bool:
    """Whether any two segments that are not neighbours cross; segments in order of longitude prune the pairs."""
    n = len(ring) - 1
    if n < 3:
        return False
    a, b = ring[:-1], ring[1:]
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    order = np.argsort(low, kind="stable")
    closed = bool((ring[0] == ring[-1]).all())
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for at, i in enumerate(order):
        stop = at + 1 + int(np.searchsorted(low[order[at + 1 :]], high[i], "right"))
        j = order[at + 1 : stop]
        gap = np.abs(j - i)
        j = j[(gap > 1) & ~(closed & (gap == n - 1))]
        if len(j):
            p, q = a[i], b[i]
            if ((side(p, q, a[j]) * side(p, q, b[j]) < 0) & (side(a[j], b[j], p) * side(a[j], b[j], q) < 0)).any():
                return True
    return False


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with an own stack: vertices farther than the tolerance from their chord stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        w, n = points[i + 1 : j] - a, float(d @ d)
        far = np.hypot(*(w - (np.outer(np.clip(w @ d / n, 0, 1), d) if n else 0)).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def fitted(points: np.ndarray, most: int = MAX_VERTICES) -> np.ndarray:
    """At most about ``most`` vertices: the tolerance is found by 20 halvings of [0, 1] degree."""
    if len(points) <= most:
        return points
    low, high = 0.0, 1.0
    for _ in range(20):
        middle = (low + high) / 2
        low, high = (middle, high) if len(simplified(points, middle)) > most else (low, middle)
    return simplified(points, high)


def _ring(ring) -> np.ndarray:
    return np.array([(p["lat"], p["lon"]) for p in ring], float).reshape(-1, 2)


def ring_crosses_itself(ring: Column) -> Column:
    def run(ring: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else crossing(_ring(r)) for r in ring], dtype=object)

    return F.pandas_udf(run, "boolean")(ring)


def simplify_polygon(ring: Column, most: int = MAX_VERTICES) -> Column:
    def run(ring: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"lat": a, "lon": b} for a, b in fitted(_ring(r), most).tolist()] for r in ring], dtype=object)

    return F.pandas_udf(run, "array<struct<lat:double,lon:double>>")(ring)
