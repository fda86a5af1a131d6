"""Every reference operator as a query over the fixture tables, and the same in ANSI SQL.

The Spark side calls the operators of this package; the SQL side is written independently, with CTEs for
the shared fixture tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import address, cells, geom
from cairn.functions.cover import cells_of_polygon
from cairn.operators import access, index, lookup, osm, rings
from cairn.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- fixtures on the Spark side


def addresses(spark, d) -> DataFrame:
    return fx.load(spark, d, "addr_points").unionByName(fx.load(spark, d, "end_addr"))


def streets(spark, d) -> DataFrame:
    return fx.arrays(fx.load(spark, d, "street_nodes"), ["way_id", "name"], "nodes")


def interps(spark, d) -> DataFrame:
    ways = fx.arrays(fx.load(spark, d, "interp_nodes"), ["interp_id", "street", "interpolation"], "nodes")
    return osm.with_numbers(ways, addresses(spark, d))


def polygons(spark, d) -> DataFrame:
    rows = fx.arrays(fx.load(spark, d, "polygon_vertices"), ["poly_id", "name", "admin_level", "cc"], "vertices")
    return rows.select("poly_id", "name", "admin_level", osm.country_code(F.col("cc")).alias("country_code"), "vertices", geom.polygon_area(F.col("vertices")).alias("area"))


def index_tables(spark, d) -> dict[str, DataFrame]:
    ways, lines, areas = streets(spark, d), interps(spark, d), polygons(spark, d)
    return {
        "addr_points": addresses(spark, d), "addr_cells": index.address_cells(addresses(spark, d)),
        "street_ways": ways, "street_cells": index.line_cells(ways, "way_id"),
        "interp_ways": lines, "interp_cells": index.line_cells(lines, "interp_id"),
        "admin_polygons": areas, "admin_cells": index.polygon_cells(areas),
    }


def points(spark, d) -> DataFrame:
    return fx.load(spark, d, "points")


def ways_with_tags(spark, d) -> DataFrame:
    """(way_id, refs, tags) as an extract would have them."""
    refs = fx.load(spark, d, "way_refs").groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    t = fx.load(spark, d, "way_tags")
    pairs = {"highway": "highway", "name": "name", "addr:interpolation": "interpolation", "addr:housenumber": "housenumber", "addr:street": "street"}
    tags = F.map_filter(F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), F.col(c)))), lambda k, v: v.isNotNull())
    return t.select("way_id", tags.alias("tags")).join(refs, "way_id")


def nodes(spark, d) -> DataFrame:
    tags = F.map_filter(F.create_map(F.lit("addr:housenumber"), F.col("housenumber"), F.lit("addr:street"), F.col("street")), lambda k, v: v.isNotNull())
    return fx.load(spark, d, "nodes").select("id", "lat", "lon", tags.alias("tags"))


def relations(spark, d) -> DataFrame:
    r = fx.load(spark, d, "relations")
    pairs = {"boundary": "boundary", "admin_level": "admin_level", "name": "name", "postal_code": "postal_code", "ISO3166-1:alpha2": "iso"}
    tags = F.map_filter(F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), F.col(c)))), lambda k, v: v.isNotNull())
    member = F.struct(F.lit("way").alias("type"), F.col("way_id").alias("ref"), "role")
    own = fx.load(spark, d, "rel_members").groupBy("rel_id").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return r.select("rel_id", tags.alias("tags")).join(own, "rel_id", "left").select(F.col("rel_id").alias("id"), F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"), "tags")


# ---------------------------------------------------------------- fixtures and shared steps on the SQL side

_CTE = {name: fx.text(name) for name in fx.SQL}
_CTE["addresses"] = "SELECT * FROM addr_points UNION ALL SELECT * FROM end_addr"


def _cells(src: str, level: int) -> dict[str, str]:
    """CTEs that add ``cell`` to the rows of ``src`` (lat, lon), as <src>_c."""
    n = 1 << level
    st = lambda c: f"CASE WHEN {c} >= 0 THEN 0.5 * sqrt(1 + 3 * {c}) ELSE 1 - 0.5 * sqrt(1 - 3 * {c}) END"
    ij = lambda c: f"CAST(LEAST({n - 1}, GREATEST(0, floor({c} * {n}))) AS BIGINT)"
    return {
        f"{src}_x": f"SELECT *, cos(radians(lat::DOUBLE)) * cos(radians(lon::DOUBLE)) AS x_, cos(radians(lat::DOUBLE)) * sin(radians(lon::DOUBLE)) AS y_, sin(radians(lat::DOUBLE)) AS z_ FROM {src}",
        f"{src}_f": f"SELECT *, CASE WHEN abs(x_) >= abs(y_) AND abs(x_) >= abs(z_) THEN CASE WHEN x_ < 0 THEN 3 ELSE 0 END WHEN abs(y_) >= abs(z_) THEN CASE WHEN y_ < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z_ < 0 THEN 5 ELSE 2 END END AS face FROM {src}_x",
        f"{src}_u": f"SELECT *, CASE face WHEN 0 THEN y_/x_ WHEN 1 THEN -x_/y_ WHEN 2 THEN -x_/z_ WHEN 3 THEN z_/x_ WHEN 4 THEN z_/y_ ELSE -y_/z_ END AS u_, CASE face WHEN 0 THEN z_/x_ WHEN 1 THEN z_/y_ WHEN 2 THEN -y_/z_ WHEN 3 THEN y_/x_ WHEN 4 THEN -x_/y_ ELSE -x_/z_ END AS v_ FROM {src}_f",
        f"{src}_c": f"SELECT * EXCLUDE (x_, y_, z_, u_, v_, face), face * {n * n} + {ij(st('u_'))} * {n} + {ij(st('v_'))} AS cell FROM {src}_u",
    }


def _crossed(src: str, out: str, keys: list[str], parts: list[str], level: int) -> dict[str, str]:
    """CTE ``out`` (cell, keys): the cells that the segments ``src`` (keys, parts, y1, x1, y2, x2) pass through.

    All fixture lines lie on face 0, on whose plane (y/x, z/x) geodesics and borders of cells are straight:
    the borders between a segment's ends cut it, and the middles of its pieces name the cells.
    """
    n = 1 << level
    every = ", ".join(keys + parts)
    st = lambda c: f"CASE WHEN {c} >= 0 THEN 0.5 * sqrt(1 + 3 * {c}) ELSE 1 - 0.5 * sqrt(1 - 3 * {c}) END"
    ij = lambda c: f"CAST(floor(({st(c)}) * {n}) AS BIGINT)"
    border = f"CASE WHEN 2 * k >= {n} THEN (4 * (k / {n}.0::DOUBLE) ** 2 - 1) / 3 ELSE (1 - 4 * (1 - k / {n}.0::DOUBLE) ** 2) / 3 END"
    ends = lambda a, b: f"unnest(range(LEAST({ij(a)}, {ij(b)}) + 1, GREATEST({ij(a)}, {ij(b)}) + 1)) AS k"
    cut = lambda a, b: f"SELECT {every}, u0, v0, u1, v1, ({border} - {a}) / ({b} - {a}) AS t FROM (SELECT *, {ends(a, b)} FROM {out}_uv)"
    return {
        f"{out}_uv": f"SELECT {every}, tan(radians(x1)) AS u0, tan(radians(y1)) / cos(radians(x1)) AS v0, tan(radians(x2)) AS u1, tan(radians(y2)) / cos(radians(x2)) AS v1 FROM {src}",
        f"{out}_cuts": f"SELECT {every}, u0, v0, u1, v1, 0.0::DOUBLE AS t FROM {out}_uv UNION ALL SELECT {every}, u0, v0, u1, v1, 1.0::DOUBLE FROM {out}_uv UNION ALL {cut('u0', 'u1')} UNION ALL {cut('v0', 'v1')}",
        f"{out}_mids": f"SELECT {every}, u0 + (t + t2) / 2 * (u1 - u0) AS u, v0 + (t + t2) / 2 * (v1 - v0) AS v FROM (SELECT *, LEAD(t) OVER (PARTITION BY {every} ORDER BY t) AS t2 FROM {out}_cuts) WHERE t2 - t > 1e-12",
        out: f"SELECT DISTINCT {ij('u')} * {n} + {ij('v')} AS cell, {', '.join(keys)} FROM {out}_mids",
    }


_N = 1 << cells.STREET_LEVEL
_CTE |= _cells("addresses", 17) | _cells("points", 17)
_CTE["probe"] = f"SELECT qid, lat, lon, k AS probe_rank, cell + di * {_N} + dj AS cell FROM points_c CROSS JOIN (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(cells.OFFSETS)) + ") AS o(k, di, dj)"
_DIST = "pow(radians({0}), 2) + pow(radians({1}), 2) * cos(radians(lat)) * cos(radians(lat))"
_CTE["addr_hits"] = "SELECT qid, probe_rank, addr_id, housenumber, street, " + _DIST.format("a.lat::DOUBLE - p.lat", "a.lon::DOUBLE - p.lon").replace("radians(lat)", "radians(p.lat)") + " AS dist FROM probe p JOIN addresses_c a USING (cell)"
_CTE["addr_best"] = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, probe_rank, addr_id) AS r FROM addr_hits) WHERE r = 1"
for _kind, _key in (("street", "way_id"), ("interp", "interp_id")):
    _CTE[f"{_kind}_segs"] = f"SELECT a.{_key}, a.pos AS seg, a.lat::DOUBLE AS y1, a.lon::DOUBLE AS x1, b.lat::DOUBLE AS y2, b.lon::DOUBLE AS x2 FROM {_kind}_nodes a JOIN {_kind}_nodes b ON a.{_key} = b.{_key} AND b.pos = a.pos + 1"
    _CTE |= _crossed(f"{_kind}_segs", f"{_kind}_cells", [_key], ["seg"], cells.STREET_LEVEL)
    _CTE[f"{_kind}_pairs"] = f"SELECT qid, lat, lon, {_key}, MIN(probe_rank) AS probe_rank FROM probe JOIN {_kind}_cells USING (cell) GROUP BY ALL"
    _CTE[f"{_kind}_t"] = f"SELECT *, CASE WHEN (y2-y1)*(y2-y1)+(x2-x1)*(x2-x1) = 0 THEN 0 ELSE GREATEST(0, LEAST(1, ((lat-y1)*(y2-y1)+(lon-x1)*(x2-x1)) / ((y2-y1)*(y2-y1)+(x2-x1)*(x2-x1)))) END AS t FROM {_kind}_pairs JOIN {_kind}_segs USING ({_key})"
    _CTE[f"{_kind}_d"] = f"SELECT *, {_DIST.format('lat - (y1 + t * (y2 - y1))', 'lon - (x1 + t * (x2 - x1))')} AS dist, {_DIST.format('y2 - y1', 'x2 - x1')} AS len FROM {_kind}_t"
_CTE["street_best"] = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, probe_rank, way_id, seg) AS r FROM street_d JOIN (SELECT DISTINCT way_id, name FROM street_nodes) USING (way_id)) WHERE r = 1"
_CTE["ends"] = "SELECT interp_id, street, interpolation, FIRST(lat ORDER BY pos) AS lat0, FIRST(lon ORDER BY pos) AS lon0, LAST(lat ORDER BY pos) AS lat1, LAST(lon ORDER BY pos) AS lon1 FROM interp_nodes GROUP BY ALL"
_GRID = "CAST(TRUNC({0} * 100000::FLOAT) AS BIGINT)"
_HOUSE = "COALESCE(TRY_CAST(NULLIF(regexp_extract({0}, '^[0-9]+'), '') AS BIGINT), 0)"
_CTE["at_grid"] = f"SELECT {_GRID.format('lat')} AS gy, {_GRID.format('lon')} AS gx, {_HOUSE.format('MAX_BY(housenumber, addr_id)')} AS h FROM addresses GROUP BY 1, 2"
_CTE["numbers"] = f"SELECT e.interp_id, e.street, e.interpolation, COALESCE(a.h, 0) AS start_number, COALESCE(b.h, 0) AS end_number FROM ends e LEFT JOIN at_grid a ON a.gy = {_GRID.format('lat0')} AND a.gx = {_GRID.format('lon0')} LEFT JOIN at_grid b ON b.gy = {_GRID.format('lat1')} AND b.gx = {_GRID.format('lon1')}"
_CTE["interp_sum"] = "SELECT *, SUM(len) OVER (PARTITION BY qid, interp_id) AS whole, COALESCE(SUM(len) OVER (PARTITION BY qid, interp_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ROW_NUMBER() OVER (PARTITION BY qid, interp_id ORDER BY dist, seg) AS k FROM interp_d"
_CTE["interp_best"] = "SELECT * FROM (SELECT *, (before + t * len) / whole AS along, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, probe_rank, interp_id) AS r FROM interp_sum JOIN numbers USING (interp_id) WHERE k = 1 AND start_number > 0 AND end_number > 0 AND whole > 0) WHERE r = 1"
_RAW = "start_number + along * (end_number - start_number)"
_CTE["interp_number"] = f"SELECT qid, dist, interp_id, street, start_number, end_number, interpolation, along, CASE WHEN interpolation IN (1, 2) THEN start_number + 2 * GREATEST(0, CAST(ROUND(({_RAW} - start_number) / 2) AS BIGINT)) ELSE GREATEST(0, CAST(ROUND({_RAW}) AS BIGINT)) END AS number FROM interp_best"
_CTE["ring"] = "SELECT poly_id, pos, lat, lon, COALESCE(LAG(lat) OVER w, LAST_VALUE(lat) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jlat, COALESCE(LAG(lon) OVER w, LAST_VALUE(lon) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jlon FROM polygon_vertices WINDOW w AS (PARTITION BY poly_id ORDER BY pos)"
_CTE["areas"] = "SELECT poly_id, ANY_VALUE(name) AS name, ANY_VALUE(admin_level) AS admin_level, CASE WHEN length(ANY_VALUE(cc)) >= 2 THEN substring(ANY_VALUE(cc), 1, 2) ELSE '' END AS country_code, CAST(abs(SUM(jlat::DOUBLE * lon::DOUBLE - lat::DOUBLE * jlon::DOUBLE ORDER BY pos)) / 2 AS FLOAT) AS area FROM ring JOIN (SELECT DISTINCT poly_id, name, admin_level, cc FROM polygon_vertices) USING (poly_id) GROUP BY poly_id"
_CTE["held"] = "SELECT qid, poly_id FROM (SELECT qid, lat::FLOAT AS y, lon::FLOAT AS x FROM points) p JOIN ring i ON (i.lon > x) <> (i.jlon > x) AND y < (CAST(CAST((i.jlat - i.lat) * (x - i.lon) AS FLOAT) / (i.jlon - i.lon) AS FLOAT) + i.lat) GROUP BY qid, poly_id HAVING COUNT(*) % 2 = 1"
_CTE["admin_best"] = "SELECT * FROM (SELECT qid, a.*, ROW_NUMBER() OVER (PARTITION BY qid, admin_level ORDER BY area, poly_id) AS r FROM held JOIN areas a USING (poly_id)) WHERE r = 1"
_CTE["admin"] = "SELECT qid, " + ", ".join(f"MAX(CASE WHEN admin_level = {k} THEN name END) AS {f}" for k, f in lookup.LEVEL_FIELDS.items()) + ", MAX(CASE WHEN admin_level = 2 THEN country_code END) AS country_code FROM admin_best WHERE admin_level IN (2, 4, 6, 8, 11) GROUP BY qid"
_W = repr(lookup.limit())
_CTE["found"] = f"""SELECT p.qid, CASE WHEN a.street IS NOT NULL THEN a.housenumber WHEN i.street IS NOT NULL THEN CAST(i.number AS VARCHAR) END AS house_number,
    COALESCE(a.street, i.street, s.name) AS road, d.city, d.state, d.county, d.postcode, d.country, d.country_code FROM points p
    LEFT JOIN (SELECT * FROM addr_best WHERE dist < {_W}) a USING (qid) LEFT JOIN (SELECT * FROM interp_number WHERE dist < {_W}) i USING (qid)
    LEFT JOIN (SELECT * FROM street_best WHERE dist < {_W}) s USING (qid) LEFT JOIN admin d USING (qid)"""
_CTE["fields"] = "SELECT qid, " + ", ".join(f"CASE WHEN COALESCE(road, country, city, state) IS NOT NULL THEN {f} END AS {f}" for f in address.FIELDS) + " FROM found"
_ONE = ", ".join(f"'{c}'" for c in address.NUMBER_FIRST)
_TWO = ", ".join(f"'{c}'" for c in address.POSTCODE_FIRST)


def _formatted(src: str) -> dict[str, str]:
    return {
        "rules": f"SELECT *, COALESCE(country_code IN ({_ONE}), FALSE) AS one, COALESCE(country_code IN ({_TWO}), FALSE) AS two FROM {src}",
        "heads": "SELECT *, CASE WHEN road IS NULL THEN NULL WHEN house_number IS NULL THEN road WHEN one OR two THEN house_number || ' ' || road ELSE road || ' ' || house_number END AS line, CASE WHEN one THEN '' ELSE COALESCE(postcode || ' ', '') END || COALESCE(city, '') AS head FROM rules",
        "stated": "SELECT *, CASE WHEN (one OR two) AND state IS NOT NULL THEN CASE WHEN head <> '' THEN head || ', ' || state ELSE state END ELSE head END AS body FROM heads",
        "placed": "SELECT *, CASE WHEN one AND postcode IS NOT NULL THEN CASE WHEN body <> '' THEN body || ' ' || postcode ELSE postcode END WHEN one THEN body ELSE body END AS place FROM stated",
        "formatted": "SELECT *, CASE WHEN COALESCE(road, city, country) IS NOT NULL THEN concat_ws(', ', line, CASE WHEN place <> '' THEN CASE WHEN one THEN place ELSE trim(place) END END, country) END AS display_name FROM placed",
    }


_CTE |= _formatted("fields")


def _needs(name: str, seen: dict[str, None], own: dict[str, str]) -> None:
    import re

    for word in dict.fromkeys(re.findall(r"\w+", own[name])):
        if word in own and word != name and word not in seen:
            _needs(word, seen, own)
    seen[name] = None


def _sql(select: str, **more: str) -> str:
    """``select`` with the CTEs it needs, directly or through others."""
    own, seen = _CTE | more | {"_": select}, {}
    _needs("_", seen, own)
    parts = [f"{n} AS ({own[n]})" for n in seen if n != "_"]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, select: str | None = None, **more: str):
    def add(f):
        QUERIES[name] = f
        if select:
            ORACLES[name] = _sql(select, **more)
        return f

    return add


def metres(c="dist"):
    return F.round(F.sqrt(c) * lookup.EARTH, 3).alias("metres")


_M = "ROUND(sqrt(dist) * 6371000.0, 3) AS metres"

# ---------------------------------------------------------------- filters and scalar functions


@query("addr_filter", "SELECT 'node/' || id AS addr_id, housenumber, street FROM nodes WHERE housenumber IS NOT NULL AND street IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def _(s, d):
    return osm.node_addresses(nodes(s, d)).select("addr_id", "housenumber", "street")


_X = ", ".join(f"'{h}'" for h in geom.EXCLUDED_HIGHWAYS)


@query("highway_filter", f"SELECT way_id, highway FROM way_tags WHERE highway NOT IN ({_X})")
def _(s, d):
    return fx.load(s, d, "way_tags").filter(geom.is_street(F.col("highway"))).select("way_id", "highway")


@query("house_number_parse", f"SELECT addr_id, {_HOUSE.format('housenumber')} AS number FROM addresses")
def _(s, d):
    return addresses(s, d).select("addr_id", geom.house_number(F.col("housenumber")).alias("number"))


@query("interp_code", "SELECT way_id, CASE interpolation WHEN 'even' THEN 1 WHEN 'odd' THEN 2 ELSE 0 END AS code FROM way_tags WHERE interpolation IS NOT NULL")
def _(s, d):
    return fx.load(s, d, "way_tags").filter("interpolation IS NOT NULL").select("way_id", geom.interpolation_code(F.col("interpolation")).alias("code"))


_STEP = "CAST(TRUNC({0} * 1e7 + CASE WHEN {0} >= 0 THEN 0.5 ELSE -0.5 END) AS BIGINT)"


@query("coord_key", f"SELECT id, CASE WHEN y >= 0 THEN y ELSE y END * 4294967296 + CASE WHEN x >= 0 THEN x ELSE x + 4294967296 END AS key FROM (SELECT id, {_STEP.format('lat')} AS y, {_STEP.format('lon')} AS x FROM world)")
def _(s, d):
    return fx.load(s, d, "world").select("id", geom.coord_key(F.col("lat"), F.col("lon")).alias("key"))


for _level in (17, 10):
    @query(f"cell_key_l{_level}", "SELECT id, cell FROM world_c", **_cells("world", _level))
    def _(s, d, level=_level):
        return fx.load(s, d, "world").select("id", cells.cell(F.col("lat"), F.col("lon"), level).alias("cell"))


@query("cell_probes", "SELECT qid, probe_rank, cell FROM probe")
def _(s, d):
    return cells.probes(points(s, d)).select("qid", "probe_rank", "cell")


_STEP_UV = "LEAST(1 + pow(2, -50), GREATEST(-1 - pow(2, -50), (2 * {0} + 1) / 8.0::DOUBLE - 1))"
_BESIDE = _cells("world", 3) | {
    "steps": "SELECT id, k, (cell // 64) AS f, (cell // 8) % 8 + di AS i, cell % 8 + dj AS j FROM world_c CROSS JOIN (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(cells.OFFSETS)) + ") AS o(k, di, dj)",
    "planes": f"SELECT *, {_STEP_UV.format('i')} AS u, {_STEP_UV.format('j')} AS v FROM steps",
    "solid": "SELECT *, CASE f WHEN 0 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN v WHEN 5 THEN v ELSE -u END AS x, CASE f WHEN 0 THEN u WHEN 1 THEN 1 WHEN 4 THEN -1 WHEN 5 THEN u ELSE -v END AS y, CASE f WHEN 2 THEN 1 WHEN 3 THEN -u WHEN 4 THEN -u WHEN 5 THEN -1 ELSE v END AS z FROM planes",
    "faced": "SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS g FROM solid",
    "landed": "SELECT id, k, f, i, j, g, CASE g WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS s, CASE g WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS t FROM faced",
    "beside": "SELECT id, k, CASE WHEN i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 THEN f * 64 + i * 8 + j ELSE g * 64 + LEAST(7, GREATEST(0, CAST(floor(4 * (s + 1)) AS BIGINT))) * 8 + LEAST(7, GREATEST(0, CAST(floor(4 * (t + 1)) AS BIGINT))) END AS cell FROM landed",
    "once": "SELECT id, cell, MIN(k) AS k FROM beside GROUP BY id, cell",
}


@query("cell_neighbors", "SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY k) - 1 AS probe_rank, cell FROM once", **_BESIDE)
def _(s, d):
    return cells.probes(fx.load(s, d, "world"), 3).select("id", "probe_rank", "cell")


# The curve: of 17 steps each names a quarter by its bits and the turn so far, and turns on. Fixed values, as in cells.
_CURVE = _cells("world", 17) | {
    "curve": """SELECT id, cell // 17179869184 AS face, (cell // 131072) % 131072 AS i, cell % 131072 AS j, 16 AS bit, 0::HUGEINT AS place, (cell // 17179869184) % 2 AS turn FROM world_c
        UNION ALL SELECT id, face, i, j, bit - 1, place * 4 + ([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])[turn + 1][q + 1],
            xor(turn, ([1, 0, 0, 3])[([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])[turn + 1][q + 1] + 1])
        FROM (SELECT *, 2 * ((i >> bit) & 1) + ((j >> bit) & 1) AS q FROM curve WHERE bit >= 0)""",
    "ids": "SELECT id, face * 2305843009213693952::HUGEINT + place * 134217728 + 67108864 AS n FROM curve WHERE bit = -1",
}


@query("s2_cell_id", "SELECT id, CAST(CASE WHEN n > 9223372036854775807 THEN n - 18446744073709551616 ELSE n END AS BIGINT) AS s2_id FROM ids", **_CURVE)
def _(s, d):
    return fx.load(s, d, "world").select("id", cells.s2_cell_id(F.col("lat"), F.col("lon")).alias("s2_id"))


@query("border_line_filter", "SELECT rel_id, name FROM relations WHERE NOT (COALESCE(TRY_CAST(admin_level AS INT), 0) = 2 AND COALESCE(iso, '') = '' AND (contains(name, ' - ') OR contains(name, ' — '))) AND name IS NOT NULL")
def _(s, d):
    r = fx.load(s, d, "relations").filter("name IS NOT NULL")
    level = F.coalesce(F.col("admin_level").cast("int"), F.lit(0))
    return r.filter(~geom.is_border_line(level, F.col("iso"), F.col("name"))).select("rel_id", "name")


_BOUND = """SELECT rel_id, CASE boundary WHEN 'postal_code' THEN 11 ELSE CAST(admin_level AS INT) END AS admin_level,
    CASE boundary WHEN 'postal_code' THEN COALESCE(postal_code, name) ELSE name END AS name,
    CASE WHEN boundary = 'administrative' AND admin_level = '2' THEN COALESCE(iso, '') ELSE '' END AS country_code FROM relations
    WHERE (boundary = 'postal_code' AND COALESCE(postal_code, name) IS NOT NULL) OR (boundary = 'administrative' AND CAST(admin_level AS INT) BETWEEN 2 AND 10 AND name IS NOT NULL)"""
_BOUND2 = "SELECT * FROM bounds0 WHERE rel_id IN (SELECT rel_id FROM rel_members) AND NOT (admin_level = 2 AND country_code = '' AND (contains(name, ' - ') OR contains(name, ' — ')))"


@query("postal_label", "SELECT rel_id, admin_level, name FROM bounds0 WHERE admin_level = 11", bounds0=_BOUND)
def _(s, d):
    r = relations(s, d)
    ok, level, label, _ = osm.boundary()
    return r.filter(ok & (level == 11)).select(F.col("id").alias("rel_id"), level.alias("admin_level"), label.alias("name"))


@query("boundary_relations", "SELECT rel_id, admin_level, name, country_code, (SELECT COUNT(*) FROM rel_members m WHERE m.rel_id = b.rel_id) AS n_members FROM bounds b", bounds0=_BOUND, bounds=_BOUND2)
def _(s, d):
    return osm.boundary_relations(relations(s, d)).select("rel_id", "admin_level", "name", "country_code", F.size("members").cast("long").alias("n_members"))


@query("max_admin_level", "SELECT rel_id, admin_level FROM bounds WHERE admin_level <= 6", bounds0=_BOUND, bounds=_BOUND2)
def _(s, d):
    return osm.boundary_relations(relations(s, d), 6).select("rel_id", "admin_level")


# ---------------------------------------------------------------- joins of the build

_WAYS = {
    "refs": "SELECT way_id, COUNT(*) AS n_refs FROM way_refs GROUP BY way_id",
    "lines": "SELECT w.way_id, COUNT(n.id) AS n_found, AVG(n.lat) AS mlat, AVG(n.lon) AS mlon FROM way_refs w LEFT JOIN nodes n ON n.id = w.ref GROUP BY w.way_id",
    "resolved": "SELECT * FROM refs JOIN lines USING (way_id) JOIN way_tags USING (way_id)",
}


@query("way_node_resolve", "SELECT way_id, n_refs, n_found, n_refs = n_found AS complete FROM refs JOIN lines USING (way_id)", **_WAYS)
def _(s, d):
    r = osm.resolve(ways_with_tags(s, d), nodes(s, d))
    return r.select("way_id", F.size("refs").cast("long").alias("n_refs"), F.size("nodes").cast("long").alias("n_found"), "complete")


@query("centroid", "SELECT 'way/' || way_id AS addr_id, ROUND(mlat, 9) AS lat, ROUND(mlon, 9) AS lon FROM resolved WHERE housenumber IS NOT NULL AND street IS NOT NULL AND interpolation IS NULL AND n_found > 0", **_WAYS)
def _(s, d):
    b = osm.building_addresses(osm.resolve(ways_with_tags(s, d), nodes(s, d)))
    return b.select("addr_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("street_way_filter", f"SELECT way_id, name, n_refs FROM resolved WHERE highway NOT IN ({_X}) AND name IS NOT NULL AND n_refs = n_found AND n_refs >= 2 AND interpolation IS NULL", **_WAYS)
def _(s, d):
    return osm.street_ways(osm.resolve(ways_with_tags(s, d), nodes(s, d))).select("way_id", "name", F.size("nodes").cast("long").alias("n_refs"))


@query("interpolation_way_filter", "SELECT way_id AS interp_id, street, CASE interpolation WHEN 'even' THEN 1 WHEN 'odd' THEN 2 ELSE 0 END AS interpolation FROM resolved WHERE interpolation IS NOT NULL AND street IS NOT NULL AND n_refs = n_found AND n_refs >= 2", **_WAYS)
def _(s, d):
    return osm.interpolation_ways(osm.resolve(ways_with_tags(s, d), nodes(s, d))).select("interp_id", "street", "interpolation")


@query("address_union", "SELECT 'node/' || id AS addr_id, street FROM nodes WHERE housenumber IS NOT NULL AND street IS NOT NULL UNION ALL SELECT 'way/' || way_id, street FROM resolved WHERE housenumber IS NOT NULL AND street IS NOT NULL AND interpolation IS NULL AND n_found > 0", **_WAYS)
def _(s, d):
    b = osm.building_addresses(osm.resolve(ways_with_tags(s, d), nodes(s, d)))
    return osm.node_addresses(nodes(s, d)).unionByName(b).select("addr_id", "street")


@query("member_semi", "SELECT way_id FROM way_tags WHERE way_id IN (SELECT way_id FROM rel_members JOIN bounds USING (rel_id))", bounds0=_BOUND, bounds=_BOUND2)
def _(s, d):
    used = osm.boundary_relations(relations(s, d)).select(F.explode("members.way_id").alias("way_id"))
    return fx.load(s, d, "way_tags").join(used, "way_id", "left_semi").select("way_id")


_COMPLETE = _WAYS | {"bounds0": _BOUND, "bounds": _BOUND2, "good": "SELECT way_id FROM resolved WHERE n_found = n_refs"}


@query("member_missing_anti", "SELECT rel_id, COUNT(*) AS n FROM rel_members JOIN bounds b USING (rel_id) WHERE rel_id NOT IN (SELECT rel_id FROM rel_members WHERE way_id NOT IN (SELECT way_id FROM good)) GROUP BY rel_id", **_COMPLETE)
def _(s, d):
    lines = osm.resolve(ways_with_tags(s, d), nodes(s, d)).filter("complete")
    return osm.complete_members(osm.boundary_relations(relations(s, d)), lines).groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"))


@query("member_diagnostics", "SELECT rel_id, COUNT(*) AS total, COUNT(g.way_id) AS found, COUNT(*) - COUNT(g.way_id) AS missing FROM rel_members m JOIN bounds USING (rel_id) LEFT JOIN good g ON g.way_id = m.way_id GROUP BY rel_id", **_COMPLETE)
def _(s, d):
    lines = osm.resolve(ways_with_tags(s, d), nodes(s, d)).filter("complete")
    return osm.member_diagnostics(osm.boundary_relations(relations(s, d)), lines)


_CLOSED = {
    "bway": "SELECT way_id, way_id % 12 AS level, COUNT(*) + CASE WHEN way_id % 3 = 0 THEN 1 ELSE 0 END AS n, way_id % 3 = 0 OR FIRST(ref ORDER BY pos, ref) = LAST(ref ORDER BY pos, ref) AS closed FROM way_refs GROUP BY way_id",
    "found_refs": "SELECT way_id, COUNT(n.id) AS hits, COUNT(*) AS refs FROM way_refs w LEFT JOIN nodes n ON n.id = w.ref GROUP BY way_id",
}


@query("closed_boundaries", "SELECT 'way/' || way_id AS source, CAST(level AS INT) AS admin_level, 'Way ' || way_id AS name, n FROM bway JOIN found_refs USING (way_id) WHERE closed AND hits = refs AND n >= 4 AND level BETWEEN 2 AND 10", **_CLOSED)
def _(s, d):
    """Every third way returns to its first node; all are tagged as boundaries."""
    ways = ways_with_tags(s, d).withColumn("refs", F.when(F.col("way_id") % 3 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")))
    tags = F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), (F.col("way_id") % 12).cast("string"), F.lit("name"), F.concat(F.lit("Way "), "way_id"))
    made = osm.closed_boundaries(osm.resolve(ways.withColumn("tags", tags), nodes(s, d)))
    return made.select("source", "admin_level", "name", F.size("ring").cast("long").alias("n"))


@query("first_nodes", "SELECT way_id, COUNT(*) AS n, CAST(MAX_BY(lat, pos) AS DOUBLE) AS lat FROM (SELECT l_suppkey AS way_id, CAST(l_partkey / 1e3 AS FLOAT) AS lat, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem) WHERE pos <= 255 GROUP BY way_id")
def _(s, d):
    """Lines of many nodes are cut at 255."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("way_id"), F.row_number().over(own).alias("pos"), (F.col("l_partkey") / 1e3).alias("lat"), F.lit(0.0).alias("lon"))
    cut = fx.arrays(rows, ["way_id"], "nodes").withColumn("nodes", osm.narrow())
    return cut.select("way_id", F.size("nodes").cast("long").alias("n"), F.element_at("nodes", -1)["lat"].cast("double").alias("lat"))


@query("split_points", "SELECT gy, gx, COUNT(*) AS n FROM (SELECT CAST(ROUND(n.lat * 1e7) AS BIGINT) AS gy, CAST(ROUND(n.lon * 1e7) AS BIGINT) AS gx FROM way_refs w JOIN nodes n ON n.id = w.ref) GROUP BY gy, gx HAVING COUNT(*) > 1")
def _(s, d):
    at = fx.load(s, d, "way_refs").join(nodes(s, d).withColumnRenamed("id", "ref"), "ref").select(geom.coord_key(F.col("lat"), F.col("lon")).alias("k"))
    low = F.col("k").bitwiseAND(F.lit(0xFFFFFFFF))
    many = at.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.select(F.shiftright("k", 32).alias("gy"), F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).alias("gx"), "n")


@query("interp_endpoints", "SELECT interp_id, start_number, end_number FROM numbers")
def _(s, d):
    return interps(s, d).select("interp_id", "start_number", "end_number")


# ---------------------------------------------------------------- geometry


@query("polygon_area", "SELECT poly_id, ROUND(area::DOUBLE, 8) AS area FROM areas")
def _(s, d):
    return polygons(s, d).select("poly_id", F.round(F.col("area").cast("double"), 8).alias("area"))


@query("ring_dup_coords", "SELECT way_id, COUNT(DISTINCT (lat, lon)) < COUNT(*) AS dup FROM (SELECT *, MAX(pos) OVER (PARTITION BY way_id) AS top FROM street_nodes) WHERE pos < top GROUP BY way_id")
def _(s, d):
    return streets(s, d).select("way_id", geom.has_duplicates(F.col("nodes")).alias("dup"))


_SIDE = "(({2}-{0})*({5}-{1})-({3}-{1})*({4}-{0}))"
_CROSS = f"sign({_SIDE.format('a.y1', 'a.x1', 'a.y2', 'a.x2', 'b.y1', 'b.x1')}) * sign({_SIDE.format('a.y1', 'a.x1', 'a.y2', 'a.x2', 'b.y2', 'b.x2')}) < 0 AND sign({_SIDE.format('b.y1', 'b.x1', 'b.y2', 'b.x2', 'a.y1', 'a.x1')}) * sign({_SIDE.format('b.y1', 'b.x1', 'b.y2', 'b.x2', 'a.y2', 'a.x2')}) < 0"


_RINGS = {
    "rn": "SELECT l_orderkey AS ring_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, (l_partkey * 7919) % 997 / 1e3 AS lat, (l_suppkey * 104729 + l_linenumber * 31) % 991 / 1e3 AS lon, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem",
    "rc": "SELECT ring_id, pos, lat, lon, n FROM rn WHERE n >= 4 UNION ALL SELECT ring_id, n + 1, lat, lon, n FROM rn WHERE n >= 4 AND pos = 1",
    "rs": "SELECT a.ring_id, a.pos AS k, a.n, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM rc a JOIN rc b ON a.ring_id = b.ring_id AND b.pos = a.pos + 1",
}


def closed_rings(s, d) -> DataFrame:
    from pyspark.sql.window import Window

    li = s.read.parquet(f"{d}/lineitem.parquet")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.select(F.col("l_orderkey").alias("ring_id"), F.row_number().over(own).alias("pos"), (F.col("l_partkey") * 7919 % 997 / 1e3).alias("lat"), ((F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 991 / 1e3).alias("lon"))
    ring = fx.arrays(rows, ["ring_id"], "ring").filter(F.size("ring") >= 4)
    return ring.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))


@query("segments_intersect", f"SELECT ring_id, COUNT(*) AS n FROM (SELECT a.ring_id FROM rs a JOIN rs b ON a.ring_id = b.ring_id AND b.k > a.k WHERE {_CROSS}) GROUP BY ring_id", **_RINGS)
def _(s, d):
    segs = closed_rings(s, d).select("ring_id", F.posexplode(geom.segments(F.col("ring"))).alias("k", "s"))
    ends = lambda p: [F.col(f"s.{e}.{c}").alias(f"{p}{e}{c}") for e in "ab" for c in ("lat", "lon")]
    both = segs.select("ring_id", F.col("k").alias("i"), *ends("l")).join(segs.select("ring_id", F.col("k").alias("j"), *ends("r")), "ring_id").filter("j > i")
    crossed = geom.segments_cross(*(F.col(f"{p}{e}{c}") for p in "lr" for e in "ab" for c in ("lat", "lon")))
    return both.filter(crossed).groupBy("ring_id").agg(F.count(F.lit(1)).alias("n"))


@query("ring_self_intersection", f"SELECT ring_id, BOOL_OR(hit) AS crosses FROM (SELECT r.ring_id, EXISTS (SELECT 1 FROM rs a JOIN rs b ON a.ring_id = b.ring_id AND b.k > a.k + 1 AND NOT (a.k = 1 AND b.k = a.n) WHERE a.ring_id = r.ring_id AND {_CROSS}) AS hit FROM (SELECT DISTINCT ring_id FROM rc) r) GROUP BY ring_id", **_RINGS)
def _(s, d):
    return closed_rings(s, d).select("ring_id", geom.ring_crosses_itself(F.col("ring")).alias("crosses"))


_TURNED = _RINGS | {
    "least": "SELECT ring_id, n, FIRST(pos ORDER BY lat, lon, pos) AS low FROM rn WHERE n >= 4 GROUP BY ring_id, n",
    "turned": "SELECT ring_id, (pos - low + n) % n AS k, lat, lon FROM rn JOIN least USING (ring_id, n) UNION ALL SELECT ring_id, n, lat, lon FROM rn JOIN least USING (ring_id, n) WHERE pos = low",
}


def drawn(ring, digits=3):
    """The ring's vertices as text."""
    place = lambda p: F.concat_ws(" ", *(F.format_string(f"%.{digits}f", p[c]) for c in ("lat", "lon")))
    return F.array_join(F.transform(ring, place), ",")


@query("ring_normalise", "SELECT ring_id, string_agg(printf('%.3f %.3f', lat, lon), ',' ORDER BY k) AS ring FROM turned GROUP BY ring_id", **_TURNED)
def _(s, d):
    return closed_rings(s, d).select("ring_id", drawn(geom.rotated(F.col("ring"))).alias("ring"))


@query("simplify_polygon", None)
def _(s, d):
    return closed_rings(s, d).select("ring_id", drawn(geom.simplify_polygon(F.col("ring"), 5)).alias("ring"))


@query("cover_edge", "SELECT way_id, cell FROM street_cells")
def _(s, d):
    return index.line_cells(streets(s, d), "way_id").select("way_id", "cell")


_COVER = {"sides": "SELECT poly_id, pos, jlat::DOUBLE AS y1, jlon::DOUBLE AS x1, lat::DOUBLE AS y2, lon::DOUBLE AS x2 FROM ring"} | _crossed("sides", "outline", ["poly_id"], ["pos"], 13)
_COVER |= {
    "boxed": "SELECT poly_id, unnest(range(MIN(cell // 8192), MAX(cell // 8192) + 1)) AS i, MIN(cell % 8192) AS j0, MAX(cell % 8192) AS j1 FROM outline GROUP BY poly_id",
    "grid": "SELECT poly_id, i * 8192 + j AS cell, (i + 0.5) / 8192.0::DOUBLE AS s, (j + 0.5) / 8192.0::DOUBLE AS t FROM (SELECT poly_id, i, unnest(range(j0, j1 + 1)) AS j FROM boxed)",
    "middle": "SELECT poly_id, cell, degrees(atan(CASE WHEN s >= 0.5 THEN (4 * s * s - 1) / 3 ELSE (1 - 4 * (1 - s) * (1 - s)) / 3 END)) AS clon, CASE WHEN s >= 0.5 THEN (4 * s * s - 1) / 3 ELSE (1 - 4 * (1 - s) * (1 - s)) / 3 END AS u, CASE WHEN t >= 0.5 THEN (4 * t * t - 1) / 3 ELSE (1 - 4 * (1 - t) * (1 - t)) / 3 END AS v FROM grid",
    "centred": "SELECT poly_id, cell, clon, degrees(atan2(v, sqrt(1 + u * u))) AS clat FROM middle",
    "within": "SELECT c.poly_id, c.cell FROM centred c JOIN ring r ON r.poly_id = c.poly_id AND (r.lon::DOUBLE > clon) <> (r.jlon::DOUBLE > clon) AND clat < (r.jlat::DOUBLE - r.lat::DOUBLE) * (clon - r.lon::DOUBLE) / (r.jlon::DOUBLE - r.lon::DOUBLE) + r.lat::DOUBLE GROUP BY c.poly_id, c.cell HAVING COUNT(*) % 2 = 1",
}


@query("cover_polygon", "SELECT poly_id, cell, FALSE AS is_interior FROM outline UNION ALL SELECT poly_id, cell, TRUE FROM within WHERE NOT EXISTS (SELECT 1 FROM outline o WHERE o.poly_id = within.poly_id AND o.cell = within.cell)", **_COVER)
def _(s, d):
    return polygons(s, d).select("poly_id", F.explode(cells_of_polygon(F.col("vertices"), 13)).alias("c")).select("poly_id", "c.cell", "c.is_interior")


@query("ring_assembly", None)
def _(s, d):
    lines = osm.resolve(ways_with_tags(s, d), nodes(s, d)).filter("complete")
    made = rings.assemble(osm.complete_members(osm.boundary_relations(relations(s, d)), lines))
    return made.select("rel_id", "ring_no", F.size("ring").alias("n"), drawn(F.col("ring"), 5).alias("ring"))


# ---------------------------------------------------------------- index tables


@query("cell_postings", "SELECT cell, string_agg(way_id, ',' ORDER BY way_id) AS ids FROM street_cells GROUP BY cell")
def _(s, d):
    return index.postings(index.line_cells(streets(s, d), "way_id"), "way_id").select("cell", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_KINDS = {"sc": "SELECT cell, COUNT(*) AS n FROM street_cells GROUP BY cell", "ac": "SELECT cell, COUNT(*) AS n FROM addresses_c GROUP BY cell", "ic": "SELECT cell, COUNT(*) AS n FROM interp_cells GROUP BY cell"}


@query("geo_cells_full_outer", "SELECT cell, COALESCE(sc.n, 0) AS n_streets, COALESCE(ac.n, 0) AS n_addresses, COALESCE(ic.n, 0) AS n_interps FROM sc FULL JOIN ac USING (cell) FULL JOIN ic USING (cell)", **_KINDS)
def _(s, d):
    t = index_tables(s, d)
    return index.merged_cells(t["street_cells"], t["addr_cells"], t["interp_cells"])


@query("cell_union_distinct", "SELECT cell FROM sc UNION SELECT cell FROM ac UNION SELECT cell FROM ic", **_KINDS)
def _(s, d):
    t = index_tables(s, d)
    return t["street_cells"].select("cell").union(t["addr_cells"].select("cell")).union(t["interp_cells"].select("cell")).distinct()


_WORLD = _cells("world", 10) | {"boxes": "SELECT * FROM (VALUES " + ", ".join(str(c) for c in index.CONTINENTS) + ") AS b(continent, lat0, lat1, lon0, lon1)"}
_S = "((cell // 1024) % 1024 + 0.5) / 1024"
_T = "(cell % 1024 + 0.5) / 1024"
_BACK = "CASE WHEN {0} >= 0.5 THEN (4 * {0} * {0} - 1) / 3 ELSE (1 - 4 * (1 - {0}) * (1 - {0})) / 3 END"
_WORLD |= {
    "cst": f"SELECT id, cell, cell // 1048576 AS face, ({_S})::DOUBLE AS s, ({_T})::DOUBLE AS t FROM world_c",
    "cuv": f"SELECT id, cell, face, {_BACK.format('s')} AS u, {_BACK.format('t')} AS v FROM cst",
    "cxyz": "SELECT id, cell, CASE face WHEN 0 THEN 1 WHEN 1 THEN -u WHEN 2 THEN -u WHEN 3 THEN -1 ELSE v END AS x, CASE face WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN -v WHEN 3 THEN -v WHEN 4 THEN -1 ELSE u END AS y, CASE face WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 1 WHEN 3 THEN -u WHEN 4 THEN -u ELSE -1 END AS z FROM cuv",
    "cll": "SELECT id, cell, degrees(atan2(z, sqrt(x * x + y * y))) AS clat, degrees(atan2(y, x)) AS clon FROM cxyz",
    "inbox": "SELECT id, cell, continent FROM cll JOIN boxes ON clat BETWEEN lat0 AND lat1 AND clon BETWEEN lon0 AND lon1",
}


def world_cells(s, d) -> DataFrame:
    return fx.load(s, d, "world").select("id", cells.cell(F.col("lat"), F.col("lon"), 10).alias("cell"))


@query("cell_centre", "SELECT id, ROUND(clat, 6) AS lat, ROUND(clon, 6) AS lon FROM cll", **_WORLD)
def _(s, d):
    return world_cells(s, d).select("id", cells.cell_centre(F.col("cell"), 10).alias("c")).select("id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("continent_filter", "SELECT id, continent FROM inbox", **_WORLD)
def _(s, d):
    return index.by_continent(world_cells(s, d), 10).select("id", "continent")


@query("continent_counts", "SELECT continent, COUNT(DISTINCT id) AS n FROM inbox GROUP BY continent", **_WORLD)
def _(s, d):
    return index.by_continent(world_cells(s, d), 10).groupBy("continent").agg(F.countDistinct("id").alias("n"))


@query("used_by_continent", "SELECT DISTINCT w.id, w.lat, w.lon, continent FROM world w JOIN inbox USING (id)", **_WORLD)
def _(s, d):
    return index.used_by_continent(fx.load(s, d, "world"), world_cells(s, d), "id", 10).select("id", "lat", "lon", "continent")


_TABLES = {"addr_points": "addresses", "addr_cells": "addresses_c", "street_ways": "(SELECT DISTINCT way_id FROM street_nodes)", "street_cells": "street_cells", "interp_ways": "ends", "interp_cells": "interp_cells", "admin_polygons": "areas"}


@query("index_stats", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS n FROM {c}" for t, c in _TABLES.items()))
def _(s, d):
    t = index_tables(s, d)
    return index.stats({k: t[k] for k in _TABLES})


_MODES = [(m, t) for m, ts in index.MODES.items() for t in ts if t in _TABLES]


@query("mode_tables", " UNION ALL ".join(f"SELECT '{m}' AS mode, '{t}' AS \"table\", COUNT(*) AS n FROM {_TABLES[t]}" for m, t in _MODES))
def _(s, d):
    n = index.stats({k: v for k, v in index_tables(s, d).items() if k in _TABLES})
    return s.createDataFrame(_MODES, "mode string, table string").join(n, "table").select("mode", "table", "n")


@query("multiset_diff", "SELECT 'left' AS side, housenumber, COUNT(*) AS n FROM (SELECT housenumber, street FROM addr_points EXCEPT ALL SELECT housenumber, street FROM addr_points WHERE addr_id % 3 <> 0) GROUP BY 2 UNION ALL SELECT 'right', housenumber, COUNT(*) FROM (SELECT housenumber, street FROM addr_points WHERE addr_id % 3 <> 0 EXCEPT ALL SELECT housenumber, street FROM addr_points) GROUP BY 2")
def _(s, d):
    a = fx.load(s, d, "addr_points")
    b = a.filter("addr_id % 3 <> 0").select("housenumber", "street")
    return index.difference(a.select("housenumber", "street"), b).groupBy("side", "housenumber").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- lookups


@query("nearest_addr", f"SELECT qid, addr_id, housenumber, street, {_M} FROM addr_best")
def _(s, d):
    return lookup.nearest_address(points(s, d), index.address_cells(addresses(s, d))).select("qid", "addr_id", "housenumber", "street", metres())


@query("nearest_street", f"SELECT qid, name, {_M} FROM street_best")
def _(s, d):
    w = streets(s, d)
    return lookup.nearest_street(points(s, d), index.line_cells(w, "way_id"), w).select("qid", "name", metres())


@query("nearest_interp", f"SELECT qid, interp_id, street, {_M} FROM interp_best")
def _(s, d):
    w = interps(s, d)
    return lookup.nearest_interpolation(points(s, d), index.line_cells(w, "interp_id"), w).select("qid", "interp_id", "street", metres())


@query("interp_number", "SELECT qid, interp_id, number FROM interp_number")
def _(s, d):
    w = interps(s, d)
    return lookup.nearest_interpolation(points(s, d), index.line_cells(w, "interp_id"), w).select("qid", "interp_id", "number")


def _held(s, d):
    a = polygons(s, d)
    return lookup.containing(points(s, d), index.polygon_cells(a), a)


@query("pip_join", "SELECT qid, poly_id FROM held")
def _(s, d):
    return _held(s, d).select("qid", "poly_id")


@query("admin_smallest", "SELECT qid, admin_level, poly_id, name FROM admin_best")
def _(s, d):
    return lookup.smallest_per_level(_held(s, d)).select("qid", "admin_level", "poly_id", "name")


@query("admin_pivot", "SELECT qid, country, state, county, city, postcode, country_code FROM admin")
def _(s, d):
    return lookup.admin_fields(lookup.smallest_per_level(_held(s, d)))


_CASES = "SELECT c_custkey AS qid, " + ", ".join(f"CASE WHEN (c_custkey // {1 << k}) % 2 = 0 THEN {v} END AS {f}" for k, (f, v) in enumerate((("house_number", "CAST(c_custkey % 90 AS VARCHAR)"), ("road", "c_name"), ("city", "c_mktsegment"), ("state", "'State'"), ("county", "'County'"), ("postcode", "'98000'"), ("country", "'Land'")))) + ", CASE c_custkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' WHEN 2 THEN 'FR' WHEN 3 THEN '' END AS country_code FROM customer"


def address_cases(s, d) -> DataFrame:
    """Every combination of present and absent fields, under each kind of rule."""
    k = F.col("c_custkey")
    values = {"house_number": (k % 90).cast("string"), "road": F.col("c_name"), "city": F.col("c_mktsegment"), "state": F.lit("State"), "county": F.lit("County"), "postcode": F.lit("98000"), "country": F.lit("Land")}
    some = [F.when(F.shiftright(k, i) % 2 == 0, v).alias(f) for i, (f, v) in enumerate(values.items())]
    code = F.when(k % 5 == 0, "US").when(k % 5 == 1, "JP").when(k % 5 == 2, "FR").when(k % 5 == 3, "")
    return s.read.parquet(f"{d}/customer.parquet").select(k.alias("qid"), *some, code.alias("country_code"))


_FORMATTED = {"cases": _CASES} | _formatted("cases")


@query("format_rules", "SELECT qid, NOT (one OR two) AS number_after, NOT one AS postcode_before_city, one OR two AS include_state FROM rules", **_FORMATTED)
def _(s, d):
    return address_cases(s, d).select("qid", address.format_rules(F.col("country_code")).alias("r")).select("qid", "r.*")


@query("format_address", "SELECT qid, display_name FROM formatted", **_FORMATTED)
def _(s, d):
    return address_cases(s, d).select("qid", address.display_name(F.col).alias("display_name"))


_JSON = "'\"address\":{' || concat_ws(',', " + ", ".join(f"'\"{f}\":\"' || {f} || '\"'" for f in address.FIELDS) + ") || '}'"


@query("address_json", f"SELECT qid, '{{' || concat_ws(',', '\"display_name\":\"' || display_name || '\"', {_JSON}) || '}}' AS body FROM formatted", **_FORMATTED)
def _(s, d):
    return address_cases(s, d).select("qid", address.address_json(F.col).alias("body"))


@query("reverse_geocode", "SELECT qid, " + ", ".join(address.FIELDS) + ", display_name FROM formatted")
def _(s, d):
    return lookup.reverse_geocode(points(s, d), index_tables(s, d))


@query("lookup_admin_only", "SELECT qid, " + ", ".join(address.FIELDS) + ", display_name FROM formatted", found="SELECT p.qid, NULL::VARCHAR AS house_number, NULL::VARCHAR AS road, d.city, d.state, d.county, d.postcode, d.country, d.country_code FROM points p LEFT JOIN admin d USING (qid)")
def _(s, d):
    t = index_tables(s, d)
    return lookup.reverse_geocode(points(s, d), {k: t[k] for k in index.MODES["admin_only"]})


# ---------------------------------------------------------------- access

_REQ = {
    "valid": "SELECT r.*, u.login, u.rate_per_second, u.rate_per_day, u.rate_by_ip, CASE WHEN u.rate_by_ip THEN u.login || ':' || r.ip ELSE u.login END AS rate_key FROM requests r LEFT JOIN tokens t ON t.token = r.token LEFT JOIN users u ON u.login = t.login",
    "first": "SELECT *, rate_per_second = 0 OR ROW_NUMBER() OVER (PARTITION BY rate_key, date_trunc('minute', ts) ORDER BY ts, req_id) <= rate_per_second AS ok FROM valid WHERE login IS NOT NULL",
    "second": "SELECT *, SUM(ok::INT) OVER (PARTITION BY rate_key, date_trunc('day', ts) ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING) AS dn FROM first",
    "limited": "SELECT req_id, token, login, rate_key, CASE WHEN NOT ok OR (rate_per_day > 0 AND dn > rate_per_day) THEN 429 ELSE 200 END AS status FROM second UNION ALL SELECT req_id, token, login, rate_key, 401 FROM valid WHERE login IS NULL",
}


def requests(s, d) -> DataFrame:
    return access.validate(fx.load(s, d, "requests"), fx.load(s, d, "tokens"), fx.load(s, d, "users"))


@query("token_validate", "SELECT req_id, login, rate_key FROM valid", **_REQ)
def _(s, d):
    return requests(s, d).select("req_id", "login", "rate_key")


@query("rate_limit", "SELECT req_id, status FROM limited", **_REQ)
def _(s, d):
    return access.limit_rate(requests(s, d), "minute", "day").select("req_id", "status")


_USED = "SELECT login, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS used FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rate_key, date_trunc('second', ts) ORDER BY ts, req_id) AS sn FROM valid) WHERE login IS NOT NULL AND rate_per_day > 0 AND NOT rate_by_ip AND (rate_per_second = 0 OR sn <= rate_per_second) GROUP BY 1, 2"


@query("daily_usage", _USED, **_REQ)
def _(s, d):
    return access.daily_usage(access.limit_rate(requests(s, d))).withColumn("day", F.col("day").cast("string"))


@query(
    "serve_requests",
    f"SELECT req_id, status, CASE status WHEN 200 THEN body WHEN 429 THEN 'Rate limit exceeded' WHEN 401 THEN CASE WHEN token IS NULL THEN 'Missing API key' ELSE 'Invalid API key' END END AS body FROM limited LEFT JOIN (SELECT qid, '{{' || concat_ws(',', '\"display_name\":\"' || display_name || '\"', {_JSON}) || '}}' AS body FROM formatted) ON qid = req_id",
    **_REQ, **_FORMATTED,
)
def _(s, d):
    answers = address_cases(s, d).select("qid", address.address_json(F.col).alias("json"))
    return access.respond(access.limit_rate(requests(s, d), "minute", "day"), answers)
