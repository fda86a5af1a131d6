import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import cells, cover, geom
from cairn.operators import osm, rings

SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
BOWTIE = [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def circle(n):
    t = np.linspace(0, 2 * np.pi, n + 1)
    ring = np.stack([48 + np.sin(t), 7 + np.cos(t)], 1)
    ring[-1] = ring[0]
    return ring


def ring_df(spark, *ring_list):
    return spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in r]) for k, r in enumerate(ring_list)], "id int, ring array<struct<lat:double,lon:double>>")


def test_house_numbers(spark):
    cases = {"42": 42, "42a": 42, "123B": 123, "": 0, "abc": 0, "10-12": 10, None: 0}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", geom.house_number(F.col("s")).alias("n"))
    assert {r.s: r.n for r in df.collect()} == cases


def test_highways(spark):
    names = [*geom.EXCLUDED_HIGHWAYS, "residential", "primary", "secondary", "tertiary", "trunk", "motorway", "unclassified", "living_street"]
    df = spark.createDataFrame([(h,) for h in names], "h string").filter(geom.is_street(F.col("h")))
    assert {r.h for r in df.collect()} == set(names[9:])


def test_border_lines(spark):
    rows = [("Deutschland - Österreich", True), ("A — B", True), ("Akrotiri and Dhekelia", False)]
    df = spark.createDataFrame(rows, "n string, want boolean").select("want", geom.is_border_line(F.lit(2), F.lit(""), F.col("n")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_crossing():
    assert not geom.crossing(np.array(SQUARE)) and geom.crossing(np.array(BOWTIE)) and not geom.crossing(np.array(SQUARE[:3]))
    for n in (100, 200):
        assert not geom.crossing(circle(n))
        bad = circle(n)
        bad[[10, 40]] = bad[[40, 10]]
        assert geom.crossing(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=12))
def test_crossing_against_all_pairs(points):
    ring = np.array([*points, points[0]], float)
    n = len(ring) - 1
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = any(
        side(ring[i], ring[i + 1], ring[j]) * side(ring[i], ring[i + 1], ring[j + 1]) < 0 and side(ring[j], ring[j + 1], ring[i]) * side(ring[j], ring[j + 1], ring[i + 1]) < 0
        for i in range(n)
        for j in range(i + 2, n)
        if not (i == 0 and j == n - 1)
    )
    assert geom.crossing(ring) == want


def test_area_duplicates_rotation(spark):
    twice = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    turned = [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    got = ring_df(spark, SQUARE, twice, turned, SQUARE[:3]).select("id", geom.polygon_area(F.col("ring")).alias("a"), geom.has_duplicates(F.col("ring")).alias("d"), geom.rotated(F.col("ring")).alias("r")).orderBy("id").collect()
    assert [r.a for r in got] == [1.0, 0.0, 1.0, 0.5]
    assert [r.d for r in got] == [False, True, False, False]
    assert [tuple(p) for p in got[2].r] == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    assert [tuple(p) for p in got[3].r] == SQUARE[:3]


def test_simplify():
    line = np.array([(0, 0), (0.001, 1), (0, 2), (1, 3)], float)
    assert geom.simplified(line, 0.01).tolist() == [[0, 0], [0, 2], [1, 3]]
    ring = circle(3000)
    slim = geom.fitted(ring)
    assert 3 <= len(slim) <= 500 and (slim[0] == ring[0]).all() and (slim[-1] == ring[-1]).all()
    assert geom.fitted(ring, 4000) is ring


def plain_simplified(points, tolerance):
    """Douglas-Peucker by recursion, one point at a time."""
    if len(points) < 3:
        return points
    (ay, ax), (by, bx) = points[0], points[-1]
    far, at = -1.0, 0
    for k in range(1, len(points) - 1):
        y, x = points[k]
        n = (by - ay) ** 2 + (bx - ax) ** 2
        t = min(1, max(0, ((y - ay) * (by - ay) + (x - ax) * (bx - ax)) / n)) if n else 0
        d = ((y - ay - t * (by - ay)) ** 2 + (x - ax - t * (bx - ax)) ** 2) ** 0.5
        if d > far:
            far, at = d, k
    if far <= tolerance:
        return [points[0], points[-1]]
    return plain_simplified(points[: at + 1], tolerance)[:-1] + plain_simplified(points[at:], tolerance)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(3, 40), st.integers(3, 12))
def test_simplify_against_recursion(seed, n, most):
    points = [tuple(p) for p in np.random.default_rng(seed).uniform(-1, 1, (n, 2)).tolist()]  # no two alike: ties are either's
    ring = [*points, points[0]]
    for tolerance in (0.0, 0.05, 0.5):
        assert geom.simplified(np.array(ring), tolerance).tolist() == [list(p) for p in plain_simplified(ring, tolerance)]
    got = geom.fitted(np.array(ring), most)
    if len(ring) > most:
        low, high = 0.0, 1.0
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (mid, high) if len(plain_simplified(ring, mid)) > most else (low, mid)
        assert got.tolist() == [list(p) for p in plain_simplified(ring, high)]
    else:
        assert len(got) == len(ring)


def test_known_cells_of_the_public_library():
    # level-30 ids of two published points
    assert hex(int(cells.hilbert(cells.keys([49.703498679], [11.770681595], 30), 30)[0]) & (1 << 64) - 1).startswith("0x47a1cbd5")


@settings(max_examples=100, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 180), st.integers(1, 20))
def test_cells(lat, lon, level):
    key = cells.keys([lat], [lon], level)
    assert cells.keys(*cells.centre(key, level), level) == key
    own = cells.block(key, level)[0]
    assert len(own) in (8, 9) and own[0] == key[0]
    for k in own[1:]:
        assert int(key[0]) in cells.block([k], level)[0]


def test_cells_under_geodesics_against_dense_samples():
    rng = np.random.default_rng(5)
    n, level = 500, 6
    lat0, lon0 = rng.uniform(-88, 88, n), rng.uniform(-180, 180, n)
    reach = rng.choice([0, 0.3, 3, 20], n)
    lat1, lon1 = np.clip(lat0 + reach * rng.uniform(-1, 1, n), -89, 89), lon0 + reach * rng.uniform(-1, 1, n)
    seg, cell = cells.under(lat0, lon0, lat1, lon1, level)
    faces = 0
    for k in range(n):
        a, b = (np.array(cells.xyz_of(*p)) for p in ((lat0[k], lon0[k]), (lat1[k], lon1[k])))
        t = np.linspace(0, 1, 4001)[:, None]
        x, y, z = (a * (1 - t) + b * t).T  # chords project to geodesics
        sampled, times = np.unique(cells.keys(np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x)), level), return_counts=True)
        found = set(cell[seg == k].tolist())
        assert set(sampled[times > 1].tolist()) <= found  # a single sample may lie on a border
        assert len(found - set(sampled.tolist())) <= 1 + len(found) // 10  # corners that samples miss
        faces += len({c >> 2 * level for c in found}) > 1
    assert faces > 10
    assert cells.under(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 5)[0].tolist() == []


def test_cells_of_lines_nulls_and_points(spark):
    rows = [(1, None), (2, []), (3, [(43.7, 7.4)]), (4, [(43.7, 7.4), (43.7, 7.4)]), (5, [(43.7, 7.4), (43.71, 7.4), (43.7, 7.4)])]
    df = spark.createDataFrame(rows, "id int, v array<struct<lat:double,lon:double>>")
    got = {r.id: r.c for r in df.select("id", cells.cells_of_line(F.col("v")).alias("c")).collect()}
    own = int(cells.keys(43.7, 7.4, 17))
    assert got[1] is None and got[2] == [] and got[3] == got[4] == [own]
    assert own in got[5] and len(got[5]) == len(set(got[5])) > 10
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, 1.0)], "lat double, lon double").select(cells.cell(F.col("lat"), F.col("lon")).alias("c"), cells.cells_around(F.col("lat"), F.col("lon")).alias("a")).collect()
    assert [r.c is None for r in odd] == [r.a is None for r in odd] == [True, True, False] and len(odd[2].a) == 9


def test_point_in_polygon_and_cover(spark):
    ring = circle(40)[:-1]
    found = dict(cover.polygon(ring, 9))
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(46.8, 49.2, 4000), rng.uniform(5.8, 8.2, 4000)
    held = cover.inside(lat, lon, ring)
    keys = cells.keys(lat, lon, 9).tolist()
    assert all(k in found for k, h in zip(keys, held, strict=True) if h)
    assert all(h for k, h in zip(keys, held, strict=True) if found.get(k))
    assert any(found.values()) and not all(found.values())
    assert cover.polygon(np.array(BOWTIE), 9) == [] and cover.polygon(np.array(SQUARE[:2]), 9) == []
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat[:300], lon[:300], strict=True)], "lat double, lon double").crossJoin(ring_df(spark, ring.tolist()).selectExpr("transform(ring, p -> struct(float(p.lat) AS lat, float(p.lon) AS lon)) AS v"))
    got = [r.h for r in df.select(geom.in_polygon(F.col("lat"), F.col("lon"), F.col("v")).alias("h")).collect()]
    assert np.mean(np.array(got) == held[:300]) > 0.99


def test_rings():
    a, b = SQUARE[:3], [SQUARE[4], SQUARE[3], SQUARE[2]]
    assert len(rings.rings_of([("outer", a), ("", b)])) == 1 and len(rings.rings_of([("outer", a), ("inner", b)])) == 1
    assert rings.rings_of([("outer", a)]) == []
    assert {len(r) for r in rings.rings_of([("outer", SQUARE), ("outer", [(5.0 + x, y) for x, y in SQUARE])])} == {5}
    # two squares that share an edge's ends: a way cut where others meet it
    left, right, middle = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (0.5, 0.4), (1.0, 1.0)]
    assert len(rings.rings_of([("outer", left), ("outer", middle), ("outer", right)])) >= 1
    assert rings.rings_of([("outer", BOWTIE[:3]), ("outer", BOWTIE[2:])]) == []


def test_coord_key(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1e-7, -1e-7), (-48.12345675, 7.5)], "a double, b double").select(geom.coord_key(F.col("a"), F.col("b")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got[0] == 0 and got[1] == (1 << 32) + 0xFFFFFFFF and got[2] == (rings.mark((-48.12345675, 7.5))[0] << 32) + 75_000_000
    assert len(set(got)) == 3


def test_country_codes(spark):
    df = spark.createDataFrame([("FR",), ("FRA",), ("F",), ("",)], "c string").select(osm.country_code(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["FR", "FR", "", ""]


@pytest.mark.parametrize(("start", "end", "t", "code", "want"), [(2, 10, 0.5, 1, 6), (1, 9, 0.3, 2, 3), (10, 2, 0.9, 1, 10), (10, 2, 0.5, 0, 6), (1, 4, 0.5, 0, 3)])
def test_interpolated(spark, start, end, t, code, want):
    df = spark.range(1).select(geom.interpolated(F.lit(start), F.lit(end), F.lit(t), F.lit(code)).alias("n"))
    assert df.first().n == want
