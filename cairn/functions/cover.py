"""Cells under a polygon: every cell of a level that it touches, and which of them lie wholly inside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import cells
from cairn.functions.geom import crossing

#: Points that a flood looks at together.
_BLOCK = 1 << 14


def inside(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points, in blocks of points."""
    out = np.zeros(len(lat), bool)
    a, b = ring, np.roll(ring, 1, axis=0)
    step = max(1, _BLOCK // max(1, len(ring)))
    for k in range(0, len(lat), step):
        y, x = lat[k : k + step, None], lon[k : k + step, None]
        straddles = (a[:, 1] > x) != (b[:, 1] > x)
        rise = np.where(a[:, 1] == b[:, 1], 1.0, b[:, 1] - a[:, 1])
        out[k : k + step] = (straddles & (y < (b[:, 0] - a[:, 0]) * (x - a[:, 1]) / rise + a[:, 0])).sum(1) % 2 == 1
    return out


def polygon(ring: np.ndarray, level: int = cells.ADMIN_LEVEL) -> list[tuple[int, bool]]:
    """(cell, is_interior), sorted. Nothing for fewer than three distinct vertices, repeated ones, or crossing edges.

    Cells under the outline are touched; the others that the polygon holds are found by a flood from them,
    each wave being tested by its cells' centres. A cell off the outline lies wholly inside or outside.
    """
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    ring = ring[np.append(True, (np.diff(ring, axis=0) != 0).any(1))] if len(ring) else ring
    if len(ring) < 3 or len(np.unique(ring, axis=0)) < len(ring) or crossing(np.vstack([ring, ring[:1]])):
        return []
    after = np.roll(ring, -1, axis=0)
    outline = np.unique(cells.under(ring[:, 0], ring[:, 1], after[:, 0], after[:, 1], level)[1])
    seen, wave, held = set(outline.tolist()), outline, []
    while len(wave):
        near = np.unique(np.concatenate([cells.beside(wave, a, b, level) for a, b in cells.OFFSETS[1:]]))
        near = near[[k not in seen for k in near.tolist()]] if len(near) else near
        seen.update(near.tolist())
        lat, lon = cells.centre(near, level)
        wave = near[inside(lat, lon, ring)]
        held.append(wave)
    full = np.concatenate(held) if held else outline[:0]
    return sorted([(int(k), False) for k in outline] + [(int(k), True) for k in full])


def cells_of_polygon(vertices: Column, level: int = cells.ADMIN_LEVEL) -> Column:
    """array<struct<cell, is_interior>>."""

    def run(rings: pa.Array) -> pa.Array:
        at, lat, lon = cells.vertices(rings)
        found = [polygon(np.stack([lat[a:b], lon[a:b]], 1), level) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        flat = [c for f in found for c in f]
        made = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int64()), pa.array([i for _, i in flat], pa.bool_())], names=["cell", "is_interior"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32()), made, mask=rings.is_null())

    return F.arrow_udf(run, "array<struct<cell:long,is_interior:boolean>>")(vertices)
