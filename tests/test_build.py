"""The build from a hand-made extract, its snapshot, sources, streams and access, end to end."""

import datetime as dt
import shutil
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.operators import access, index, lookup, rings
from cairn.plans import build
from cairn.sources import accounts, osm_pbf
from cairn.streaming.lookup import geocode_stream

LAT, LON = 43.73, 7.42


def extract():
    nodes = [(1, LAT, LON, {"addr:housenumber": "12b", "addr:street": "Rue Une"}), (2, LAT, LON + 0.01, {"addr:housenumber": "5"})]
    nodes += [(10 + k, LAT + 0.002, LON + 0.0005 * k, {}) for k in range(5)]
    nodes += [(20, LAT + 0.01, LON, {"addr:housenumber": "2", "addr:street": "Quai"}), (21, LAT + 0.01, LON + 0.002, {"addr:housenumber": "10", "addr:street": "Quai"})]
    corners = [(-0.2, -0.2), (-0.2, 0.2), (0.2, 0.2), (0.2, -0.2)]
    nodes += [(100 + k, LAT + a, LON + b, {}) for k, (a, b) in enumerate(corners)]
    nodes += [(200 + k, LAT + a / 4, LON + b / 4, {}) for k, (a, b) in enumerate(corners)]
    nodes += [(300 + k, LAT - 0.03 + 0.0002 * a, LON + 0.0002 * b, {}) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1)))] + [(999, 95.0, 0.0, {})]
    admin = lambda level, name, **t: {"boundary": "administrative", "admin_level": str(level), "name": name} | t
    ways = [
        (1, [10, 11, 12, 13, 14], {"highway": "residential", "name": "Rue Deux"}),
        (2, [10, 14], {"highway": "footway", "name": "Sentier"}),
        (3, [10, 12], {"highway": "primary"}),
        (4, [20, 21], {"addr:interpolation": "even", "addr:street": "Quai", "highway": "residential", "name": "no"}),
        (5, [300, 301, 302, 300], {"addr:housenumber": "7", "addr:street": "Cour"}),
        (6, [100, 101, 102], {}), (7, [102, 103, 100], {}),
        (8, [200, 201, 202, 203, 200], admin(8, "Ville")),
        (9, [10, 999], {"highway": "residential", "name": "broken"}),
        (11, [200, 201, 202, 203, 200], {"boundary": "postal_code", "postal_code": "98000"}),
    ]
    way = lambda k, role="outer": {"type": "way", "ref": k, "role": role}
    relations = [
        (1, [way(6), way(7, ""), {"type": "node", "ref": 1, "role": "label"}], admin(2, "Pays", **{"ISO3166-1:alpha2": "FRA"})),
        (2, [way(6), way(77)], admin(4, "Missing")),
        (3, [way(6), way(7)], admin(2, "A - B")),
        (4, [way(6), way(7)], admin(12, "Too deep")),
    ]
    return nodes, ways, relations


def frames(spark):
    n, w, r = extract()
    return spark.createDataFrame(n, osm_pbf.SCHEMAS["node"]), spark.createDataFrame(w, osm_pbf.SCHEMAS["way"]), spark.createDataFrame(r, osm_pbf.SCHEMAS["relation"])


POINTS = [(1, LAT + 0.0001, LON), (2, LAT + 0.0021, LON + 0.0012), (3, LAT + 0.01, LON + 0.0009), (4, LAT + 0.15, LON + 0.15), (5, 0.0, 0.0), (6, LAT - 0.0299, LON)]
WANT = {
    1: "Rue Une 12b, 98000 Ville, Pays", 2: "Rue Deux, 98000 Ville, Pays", 3: "Quai 2, 98000 Ville, Pays",
    4: "Pays", 5: None, 6: "Cour 7, 98000 Ville, Pays",
}


def test_build_snapshot_modes_and_lookup(spark, tmp_path):
    tables = build.build(*frames(spark))
    assert {r.name for r in tables["street_ways"].collect()} == {"Rue Deux"}
    assert {(r.name, r.admin_level, r.country_code) for r in tables["admin_polygons"].collect()} == {("Pays", 2, "FR"), ("Ville", 8, ""), ("98000", 11, "")}
    assert [(r.start_number, r.end_number, r.interpolation) for r in tables["interp_ways"].collect()] == [(2, 10, 1)]
    build.save(tables, str(tmp_path / "full"))
    loaded = build.load(spark, str(tmp_path / "full"))
    for name in tables:
        assert index.difference(tables[name], loaded[name]).isEmpty()
    points = spark.createDataFrame(POINTS, "qid long, lat double, lon double")
    got = {r.qid: r.display_name for r in lookup.reverse_geocode(points, loaded).collect()}
    assert got == WANT
    between = lookup.nearest_interpolation(points, loaded["interp_cells"], loaded["interp_ways"]).collect()
    assert [(r.qid, r.number) for r in between] == [(3, 6)]
    slim = build.build(*frames(spark), mode="admin_only")
    assert slim.keys() == set(index.MODES["admin_only"])
    assert {r.qid: r.display_name for r in lookup.reverse_geocode(points, slim).collect()}[1] == "98000 Ville, Pays"
    assert {r.name for r in build.build(*frames(spark), max_admin_level=8)["admin_polygons"].collect()} == {"Pays", "Ville"}
    with pytest.raises(Exception):
        build.load(spark, str(tmp_path / "none"))


def test_modes_continents_and_partial_indexes(spark, tmp_path):
    tables = build.build(*frames(spark))
    build.save_modes(tables, str(tmp_path / "all"))
    for mode, needed in index.MODES.items():
        found = build.load(spark, f"{tmp_path}/all/{build.folder(mode)}")
        assert found.keys() == set(needed)
        assert all(index.difference(tables[t], found[t]).isEmpty() for t in ("admin_cells", needed[0]))
    whole = build.load(spark, f"{tmp_path}/all/full")
    build.save_by_continent(whole, str(tmp_path / "parts"))
    assert {r.continent for r in spark.read.parquet(str(tmp_path / "parts" / "addr_points")).filter("addr_id IS NOT NULL").collect()} == {"europe"}
    points = spark.createDataFrame(POINTS, "qid long, lat double, lon double")
    europe = build.load(spark, f"{tmp_path}/parts/europe/full")
    assert {r.qid: r.display_name for r in lookup.reverse_geocode(points, europe).collect()} == WANT
    asia = build.load(spark, f"{tmp_path}/parts/asia/admin-only")
    assert {r.display_name for r in lookup.reverse_geocode(points, asia).collect()} == {None}
    shutil.rmtree(tmp_path / "all" / "tables" / "street_cells")
    assert build.load(spark, f"{tmp_path}/all/admin-only").keys() == set(index.MODES["admin_only"])
    with pytest.raises(ValueError, match="partial"):
        build.load(spark, f"{tmp_path}/all/no-addresses")
    build.save({t: whole[t] for t in ("admin_polygons", "admin_cells", "street_ways")}, str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="street_cells missing"):
        build.load(spark, str(tmp_path / "odd"))


def test_rings_close_retry_and_miss():
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    whole = lambda rings_: [[tuple(p) for p in r] for r in rings_]
    assert whole(rings.rings_of([("outer", square)])) == [square]
    assert whole(rings.rings_of([("outer", square[:3]), ("", square[:1] + square[:1:-1])])) == [square]
    assert rings.rings_of([("outer", square[:3])]) == []
    assert whole(rings.rings_of([("inner", square)])) == [square]  # no outer ring: all members
    # At (0, 1) the first piece in order leads astray; the search goes back and takes the other.
    astray = [(0.0, 1.0), (-1.0, 3.0)]
    found = rings.rings_of([("outer", square[:2]), ("outer", astray), ("outer", square[1:])])
    assert whole(found) == [square[1:] + square[1:2]]
    # The first path that closes crosses itself: its start is given up, though another path would be sound.
    a, b = (0.0, 0.0), (0.0, 4.0)
    bow = [b, (4.0, 0.0), (4.0, 4.0), a]
    arc = [b, (2.0, 5.0), (5.0, 2.0), a]
    chains = rings.Chains([[a, b], bow, arc])
    assert not rings.sound(chains.ring([0, 1]))
    assert [r[0] for r in rings.searched(chains)] == [b]  # from the third piece on: arc and base
    assert rings.searched(rings.Chains([[a, b], bow])) == []
    two = [[(x + 5, y + 5) for x, y in square], square]
    assert whole(rings.rings_of([("outer", two[0][:3]), ("outer", two[1][:3]), ("outer", two[0][2:]), ("outer", two[1][2:])])) == two


def test_missing_accounts_are_empty(spark, tmp_path):
    users, tokens = accounts.load(spark, str(tmp_path / "none.json"))
    assert users.collect() == tokens.collect() == []
    assert users.columns == ["login", "admin", "rate_per_second", "rate_per_day", "rate_by_ip"]


def test_ship_makes_an_archive(spark):
    import zipfile

    import cairn

    assert "cairn/functions/cells.py" in zipfile.ZipFile(cairn.ship(spark)).namelist()


def test_semantics_of_distance_and_interior():
    assert lookup.limit() > lookup.limit(semantics="corrected")
    assert lookup.limit(semantics="corrected") == pytest.approx((75 / 6_371_000) ** 2, rel=0.01)


def test_stream_of_points(spark, tmp_path):
    tables = build.build(*frames(spark))
    spark.createDataFrame(POINTS, "qid long, lat double, lon double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, lat double, lon double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    geocode_stream(stream, tables, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / "c")).awaitTermination()
    assert {r.qid: r.display_name for r in spark.read.parquet(out).collect()} == WANT


# ---- a small PBF writer, from the public description of the format


def vi(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


zz = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
msg = lambda k, b: vi(k << 3 | 2) + vi(len(b)) + b
num = lambda k, n: vi(k << 3) + vi(n)
pk = lambda k, xs: msg(k, b"".join(map(vi, xs)))
deltas = lambda xs: [zz(b - a) for a, b in zip([0, *xs], xs, strict=False)]


def write_pbf(path, nodes, ways, relations):
    words = [""]

    def w(s):
        if s not in words:
            words.append(s)
        return words.index(s)

    kv = lambda t: pk(2, [w(k) for k in t]) + pk(3, [w(v) for v in t.values()])
    e7 = lambda x: round(x * 1e7)
    dense = pk(1, deltas([n[0] for n in nodes])) + pk(8, deltas([e7(n[1]) for n in nodes])) + pk(9, deltas([e7(n[2]) for n in nodes]))
    dense += pk(10, [x for n in nodes for x in (*(y for k, v in n[3].items() for y in (w(k), w(v))), 0)])
    plain = b"".join(msg(1, num(1, zz(n[0] + 5000)) + kv(n[3]) + num(8, zz(e7(n[1]))) + num(9, zz(e7(n[2])))) for n in nodes[:1])
    way = b"".join(msg(3, num(1, i) + kv(t) + pk(8, deltas(refs))) for i, refs, t in ways)
    rel = b"".join(msg(4, num(1, i) + kv(t) + pk(8, [w(m["role"]) for m in ms]) + pk(9, deltas([m["ref"] for m in ms])) + pk(10, [osm_pbf.MEMBERS.index(m["type"]) for m in ms])) for i, ms, t in relations)
    groups = [msg(2, dense) + plain, way, rel]
    with open(path, "wb") as f:
        for kind, body, zipped in [("OSMHeader", b"", False), *(("OSMData", g, k % 2 == 0) for k, g in enumerate(groups))]:
            block = msg(1, b"".join(msg(1, x.encode()) for x in words)) + (msg(2, body) if body else b"")
            blob = num(2, len(block)) + msg(3, zlib.compress(block)) if zipped else msg(1, block)
            head = msg(1, kind.encode()) + num(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


def test_pbf_source(spark, tmp_path):
    path = str(tmp_path / "a.osm.pbf")
    nodes, ways, relations = extract()
    write_pbf(path, nodes, ways, relations)
    osm_pbf.register(spark)
    read = lambda e: spark.read.format("osm_pbf").option("entity", e).option("blobs", 1).load(path)
    got = {r.id: r for r in read("node").collect()}
    assert len(got) == len(nodes) + 1 and got[5001].tags == nodes[0][3]
    assert all(got[n[0]].lat == pytest.approx(n[1], abs=1e-7) and got[n[0]].tags == n[3] for n in nodes)
    both = spark.read.format("osm_pbf").option("entity", "way").load([path, path])
    assert both.count() == 2 * len(ways) == spark.read.format("osm_pbf").option("entity", "way").load(f"{path},{path}").count()
    assert {r.id: (r.refs, r.tags) for r in read("way").collect()} == {i: (refs, t) for i, refs, t in ways}
    assert {r.id: ([m.asDict() for m in r.members], r.tags) for r in read("relation").collect()} == {i: (m, t) for i, m, t in relations}
    tables = build.build(read("node").filter("id < 5000"), read("way"), read("relation"))
    points = spark.createDataFrame(POINTS, "qid long, lat double, lon double")
    assert {r.qid: r.display_name for r in lookup.reverse_geocode(points, tables).collect()} == WANT


def test_accounts_and_access(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"users": {"ann": {"password_hash": "x", "admin": true, "rate_per_second": 1, "rate_per_day": 2},\n "bob": {"admin": false, "rate_by_ip": true, "rate_per_second": 1, "rate_per_day": 0}}, "tokens": {"t1": "ann", "t2": "bob"}}')
    users, tokens = accounts.load(spark, str(path))
    assert {tuple(r) for r in users.collect()} == {("ann", True, 1, 2, False), ("bob", False, 1, 0, True)}
    accounts.save(users, tokens, str(tmp_path / "b"))
    again = accounts.load(spark, str(tmp_path / "b"))
    assert set(again[0].collect()) == set(users.collect()) and set(again[1].collect()) == set(tokens.collect())
    at = lambda s, ms=0: dt.datetime(2024, 1, 1, 0, 0, s, ms * 1000)
    rows = [(1, at(0), "t1", "a"), (2, at(0, 5), "t1", "a"), (3, at(1), "t1", "a"), (4, at(2), "t1", "a"), (5, at(0), "t2", "a"), (6, at(0), "t2", "b"), (7, at(0, 9), "t2", "a"), (8, at(0), None, "a"), (9, at(0), "zz", "a")]
    limited = access.limit_rate(access.validate(spark.createDataFrame(rows, "req_id long, ts timestamp, token string, ip string"), tokens, users))
    assert {r.req_id: r.status for r in limited.collect()} == {1: 200, 2: 429, 3: 200, 4: 429, 5: 200, 6: 200, 7: 429, 8: 401, 9: 401}
    assert [(r.login, r.used) for r in access.daily_usage(limited).collect()] == [("ann", 3)]
    answers = spark.createDataFrame([(1, "{}")], "qid long, json string")
    bodies = {r.req_id: r.body for r in access.respond(limited, answers).collect()}
    assert (bodies[1], bodies[8], bodies[9]) == ("{}", "Missing API key", "Invalid API key")
    none = users.limit(0)
    first = access.create_user(none, None, "root")
    assert first.first().admin and access.create_user(first, "root", "eve").filter("login = 'eve'").first().admin is False
    with pytest.raises(PermissionError):
        access.create_user(users, "bob", "eve")
    with pytest.raises(PermissionError):
        access.delete_user(users, tokens, "ann", "ann")
    left, keys = access.delete_user(users, tokens, "ann", "bob")
    assert [r.login for r in left.collect()] == ["ann"] and [r.token for r in keys.collect()] == ["t1"]
    assert access.delete_token(tokens, "bob", "t1").count() == 2 and access.delete_token(tokens, "ann", "t1").count() == 1
    more, token = access.create_token(tokens, "bob")
    assert more.filter(F.col("token") == token).first().login == "bob"
