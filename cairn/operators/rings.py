"""Ring assembly: the member ways of a boundary relation become closed outer rings.

Ways are cut where they meet (at their ends and at every coordinate that occurs twice), the pieces are
chained end to end in member order, and if pieces are left over a bounded search looks for more rings.
One relation is one group; its size is that of the relation.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.functions.geom import crossing

#: Limits of the search: pieces, calls for a ring and in all, pieces in a ring.
MAX_PIECES, RING_CALLS, ALL_CALLS, MAX_DEPTH = 30, 100_000, 500_000, 200

Point = tuple[float, float]
Ring = list[Point]


def mark(p: Point) -> tuple[int, int]:
    """A point in steps of 1e-7 degree, half away from zero."""
    return tuple(int(c * 1e7 + (0.5 if c >= 0 else -0.5)) for c in p)


def pieces_of(lines: list[Ring]) -> list[Ring]:
    """The ways cut at their ends and at coordinates that occur more than once."""
    seen = Counter(mark(p) for line in lines for p in line)
    cuts = {m for m, n in seen.items() if n > 1} | {mark(line[k]) for line in lines if line for k in (0, -1)}
    out = []
    for line in lines:
        piece: Ring = []
        for p in line:
            piece.append(p)
            if mark(p) in cuts and len(piece) > 1:
                out.append(piece)
                piece = [p]
        if len(piece) > 1:
            out.append(piece)
    return out


class Chains:
    """Pieces by the marks of their ends, in order."""

    def __init__(self, pieces: list[Ring]):
        self.pieces, self.ends = pieces, [(mark(p[0]), mark(p[-1])) for p in pieces]
        self.at: dict[tuple[int, int], list[int]] = {}
        for k, (a, b) in enumerate(self.ends):
            self.at.setdefault(a, []).append(k)
            if b != a:
                self.at.setdefault(b, []).append(k)

    def beyond(self, k: int, m) -> tuple[int, int]:
        a, b = self.ends[k]
        return b if a == m else a

    def ring(self, path: list[int]) -> Ring:
        """The path's points; each piece is turned to go on from the one before it."""
        out, here = [], self.ends[path[0]][0]
        for k in path:
            line = self.pieces[k] if self.ends[k][0] == here else self.pieces[k][::-1]
            out += line if not out else line[1:]
            here = self.beyond(k, here)
        return out


def sound(ring: Ring) -> bool:
    return len(ring) >= 4 and not crossing(np.array(ring))


def greedy(chains: Chains) -> tuple[list[Ring], set[int]]:
    rings, used = [], set()
    for k, (first, here) in enumerate(chains.ends):
        if k in used:
            continue
        path = [k]
        while here != first:
            step = next((n for n in chains.at[here] if n not in used and n not in path), None)
            if step is None:
                break
            path.append(step)
            here = chains.beyond(step, here)
        if here == first and (len(path) == 1 and len(chains.pieces[k]) >= 4 or sound(ring := chains.ring(path))):
            rings.append(chains.pieces[k] if len(path) == 1 else ring)
            used.update(path)
    return rings, used


def searched(chains: Chains) -> list[Ring]:
    """Rings by depth-first search from each unused piece, within the limits on calls.

    A search ends with the first path that closes; if that ring crosses itself, its start is given up. Calls
    count in all for starts that were given up only.
    """
    rings, used, lost = [], set(), 0
    for k, (first, end) in enumerate(chains.ends):
        if k in used or lost >= ALL_CALLS:
            continue
        if first == end and len(chains.pieces[k]) >= 4:
            rings.append(chains.pieces[k])
            used.add(k)
            continue
        calls, path, todo, closed = 1, [k], [iter(chains.at[end])], False
        here = [end]
        while todo and not closed and calls < RING_CALLS:
            n = next((n for n in todo[-1] if n not in used and n not in path), None)
            if n is None:
                todo.pop()
                path.pop()
                here.pop()
                continue
            calls += 1
            there = chains.beyond(n, here[-1])
            path.append(n)
            closed = there == first
            if not closed and len(path) - 1 <= MAX_DEPTH:
                todo.append(iter(chains.at[there]))
                here.append(there)
            elif not closed:
                path.pop()
        if closed and sound(ring := chains.ring(path)):
            rings.append(ring)
            used.update(path)
        else:
            lost += calls
    return rings


def outer_rings(members: list[tuple[str, Ring]], every_role: bool = False) -> list[Ring]:
    """Rings of the members that are outer (or of no role, or all)."""
    chains = Chains(pieces_of([line for role, line in members if line and (every_role or role in ("outer", "", None))]))
    rings, used = greedy(chains)
    if len(used) < len(chains.pieces) <= MAX_PIECES and len(more := searched(chains)) > len(rings):
        rings = more
    return rings


def rings_of(members: list[tuple[str, Ring]]) -> list[Ring]:
    """Outer rings; without any, those of all members that repeat no vertex. At least three points each."""
    rings = outer_rings(members)
    if not rings:
        rings = [r for r in outer_rings(members, True) if len({mark(p) for p in r[:-1]}) == len(r) - 1]
    return [r for r in rings if len(r) >= 3]


def assemble(members: DataFrame) -> DataFrame:
    """(rel_id, pos, role, nodes array<struct<lat, lon>>) -> (rel_id, ring_no, ring), one row per ring."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos").to_pylist()
        rings = rings_of([(r["role"], [(p["lat"], p["lon"]) for p in r["nodes"]]) for r in rows])
        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
        made = pa.array([[{"lat": a, "lon": b} for a, b in ring] for ring in rings], kind)
        return pa.table({"rel_id": pa.array([rows[0]["rel_id"]] * len(rings), pa.int64()), "ring_no": pa.array(range(len(rings)), pa.int32()), "ring": made})

    return members.select("rel_id", "pos", "role", "nodes").groupBy("rel_id").applyInArrow(run, "rel_id long, ring_no int, ring array<struct<lat:double,lon:double>>")
