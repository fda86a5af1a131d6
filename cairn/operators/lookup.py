"""Point lookups: points and index tables meet by cell, candidates are refined, and the best one per point stays.

Nearest lines and places are searched tile by tile (cairn.operators.near). Ties go to the probe rank (own cell
first), then to the smaller id. Polygons are met in equi-joins on the cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import cells
from cairn.functions.address import FIELDS, display_name
from cairn.functions.geom import dist_sq, in_polygon, interpolated, segments
from cairn.operators import near

SEARCH_DISTANCE, METRES_PER_DEGREE, EARTH = 75.0, 111_320.0, 6_371_000.0
#: Most rows of an index that are broadcast: narrow postings, and polygons of up to 500 vertices.
POSTINGS, POLYGONS = 100_000, 2_000
#: Which level fills which field of an address.
LEVEL_FIELDS = {2: "country", 4: "state", 6: "county", 8: "city", 11: "postcode"}


def limit(distance: float = SEARCH_DISTANCE, semantics: str = "reference") -> float:
    """Squared distances in radians are compared with this; "corrected" also has the limit in radians."""
    from math import radians

    x = distance / METRES_PER_DEGREE
    return (radians(x) if semantics == "corrected" else x) ** 2


def _cos():
    return F.cos(F.radians("lat"))


def _found(points: DataFrame, kinds: dict, level: int) -> DataFrame:
    """near.nearest() for ``kinds`` by name, with dist, seg, t and p of each under its name."""
    hits = near.nearest(points.select("qid", "lat", "lon", _cos().alias("cos")), list(kinds.values()), level)
    return hits.select("qid", "cos", *(F.col(f"{c}{k}").alias(f"{name}_{c}") for k, name in enumerate(kinds) for c in ("dist", "seg", "t", "p")))


def _answers(found: DataFrame, name: str, answer: list, within: float | None) -> DataFrame:
    """(qid, dist, answer) of the points that have a hit of the kind, ``within`` the limit."""
    dist = F.col(f"{name}_dist")
    return found.filter(dist.isNotNull() if within is None else dist < within).select("qid", dist.alias("dist"), *answer)


def _places(addr_cells: DataFrame) -> tuple[DataFrame, str, bool]:
    at = F.array(F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    return addr_cells.filter("cell IS NOT NULL").select(F.array("cell").alias("posted"), at.alias("nodes"), F.struct("addr_id", "housenumber", "street").alias("p")), "addr_id", True


def _lines(line_cells: DataFrame, ways: DataFrame, key: str, payload: list[str]) -> tuple[DataFrame, str, bool]:
    """Ways with all their cells. Planners take lists for short, so they would broadcast this side: it is merged."""
    posted = line_cells.filter("cell IS NOT NULL").groupBy(key).agg(F.collect_list("cell").alias("posted"))
    return posted.hint("merge").join(ways, key).select("posted", "nodes", F.struct(*payload).alias("p")), key, False


def _streets(street_cells: DataFrame, street_ways: DataFrame):
    return _lines(street_cells, street_ways, "way_id", ["way_id", "name"])


def _numbered(interp_cells: DataFrame, interp_ways: DataFrame):
    some = F.exists(segments(F.col("nodes")), lambda s: (s["a"]["lat"] != s["b"]["lat"]) | (s["a"]["lon"] != s["b"]["lon"]))
    ways = interp_ways.filter("start_number > 0 AND end_number > 0").filter(some)
    return _lines(interp_cells, ways, "interp_id", ["interp_id", "street", "start_number", "end_number", "interpolation", "nodes"])


def nearest_address(points: DataFrame, addr_cells: DataFrame, within: float | None = None, level: int = cells.STREET_LEVEL) -> DataFrame:
    """(qid, dist, addr_id, housenumber, street): the nearest of ``addr_cells`` (cell, addr_id, lat, lon, housenumber, street)."""
    return _answers(_found(points, {"a": _places(addr_cells)}, level), "a", ["a_p.addr_id", "a_p.housenumber", "a_p.street"], within)


def nearest_street(points: DataFrame, street_cells: DataFrame, street_ways: DataFrame, within: float | None = None, level: int = cells.STREET_LEVEL) -> DataFrame:
    """(qid, dist, way_id, name): the nearest of ``street_ways`` (way_id, name, nodes), indexed by (cell, way_id)."""
    return _answers(_found(points, {"s": _streets(street_cells, street_ways)}, level), "s", ["s_p.way_id", "s_p.name"], within)


def _number():
    """The house number where the found interpolation way passes; the place along it is measured in squared lengths."""
    part = lambda s: dist_sq(s["b"]["lat"].cast("double") - s["a"]["lat"], s["b"]["lon"].cast("double") - s["a"]["lon"], F.col("cos"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    sizes, seg = F.transform(segments(F.col("i_p.nodes")), part), F.col("i_seg").cast("int")
    along = (add(F.slice(sizes, F.lit(1), seg)) + F.col("i_t") * F.get(sizes, seg)) / add(sizes)
    return interpolated(F.col("i_p.start_number"), F.col("i_p.end_number"), along, F.col("i_p.interpolation"))


def nearest_interpolation(points: DataFrame, interp_cells: DataFrame, interp_ways: DataFrame, within: float | None = None, level: int = cells.STREET_LEVEL) -> DataFrame:
    """(qid, dist, interp_id, street, number): the house number where the nearest interpolation way passes.

    Ways without both numbers, or without length, are passed over.
    """
    found = _found(points, {"i": _numbered(interp_cells, interp_ways)}, level)
    return _answers(found, "i", ["i_p.interp_id", "i_p.street", _number().alias("number")], within)


def _at_most(table: DataFrame, n: int) -> bool:
    return table.select(table.columns[0]).limit(n + 1).count() <= n


def _index_side(table: DataFrame, few: bool) -> DataFrame:
    """``table`` for a join with points: only what was counted is broadcast. Planners take points and their pairs with
    polygons for as small as the files they come from, and would send those to the driver."""
    return table.hint("broadcast" if few else "merge")


def _containing(points: DataFrame, admin_cells: DataFrame, polygons: DataFrame, semantics: str, level: int) -> DataFrame:
    """containing(), a polygon perhaps several times for a point.

    Covers are complete, so a point's own cell names all polygons that may hold it; they are tested by their
    bounding box, then by the even-odd rule. A cell that lies inside a polygon needs no test: any cell around
    the point in "reference" mode, the own one only in "corrected" mode.
    """
    own = points.select("qid", "lat", "lon", cells.cell(F.col("lat"), F.col("lon"), level).alias("cell"))
    # What the answer needs of a polygon travels with its postings, so no key is met by all points of a country.
    kept = ["poly_id", "name", "admin_level", "area", "country_code"]
    few = _at_most(admin_cells, POSTINGS)
    posted = _index_side(admin_cells.select("cell", "poly_id", "is_interior").join(_index_side(polygons.select(*kept), few), "poly_id"), few)
    boxed = polygons.select("poly_id", "vertices")
    for name, least, axis in (("lat0", F.array_min, "lat"), ("lat1", F.array_max, "lat"), ("lon0", F.array_min, "lon"), ("lon1", F.array_max, "lon")):
        boxed = boxed.withColumn(name, least(F.col("vertices")[axis]))
    y, x = F.col("lat").cast("float"), F.col("lon").cast("float")
    boxes = y.between(F.col("lat0"), F.col("lat1")) & x.between(F.col("lon0"), F.col("lon1"))
    tested = own.join(posted.filter("NOT is_interior"), "cell").join(_index_side(boxed, few and _at_most(polygons, POLYGONS)), "poly_id").filter(boxes).filter(in_polygon(F.col("lat"), F.col("lon"), F.col("vertices")))
    around = cells.probes(points.select("qid", "lat", "lon"), level) if semantics == "reference" else own
    sure = around.join(posted.filter("is_interior"), "cell")
    return tested.select("qid", *kept).unionByName(sure.select("qid", *kept))


def containing(points: DataFrame, admin_cells: DataFrame, polygons: DataFrame, semantics: str = "reference", level: int = cells.ADMIN_LEVEL) -> DataFrame:
    """(qid, poly_id, name, admin_level, area, country_code): every polygon that holds a point."""
    return _containing(points, admin_cells, polygons, semantics, level).dropDuplicates(["qid", "poly_id"])


def smallest_per_level(held: DataFrame) -> DataFrame:
    """(qid, admin_level, poly_id, name, area, country_code): of each level the smallest polygon."""
    best = F.min_by(F.struct("poly_id", "name", "area", "country_code"), F.struct("area", "poly_id"))
    return held.groupBy("qid", "admin_level").agg(best.alias("b")).select("qid", "admin_level", "b.*")


def admin_fields(best: DataFrame) -> DataFrame:
    """(qid, country, state, county, city, postcode, country_code): levels as fields; other levels are dropped."""
    pick = lambda level, c: F.max(F.when(F.col("admin_level") == level, F.col(c)))
    fields = [pick(level, "name").alias(f) for level, f in LEVEL_FIELDS.items()]
    return best.filter(F.col("admin_level").isin(*LEVEL_FIELDS)).groupBy("qid").agg(*fields, pick(2, "country_code").alias("country_code"))


def reverse_geocode(points: DataFrame, index: dict[str, DataFrame], distance: float = SEARCH_DISTANCE, semantics: str = "reference", street_level: int = cells.STREET_LEVEL, admin_level: int = cells.ADMIN_LEVEL) -> DataFrame:
    """(qid, the FIELDS of an address, display_name) for every point.

    ``index`` may lack tables (no addresses, admin only): what they would give is null. The road is that of
    the nearest address, else of the nearest interpolation, else the nearest street. Without road, city,
    state and country the address is empty.
    """
    within = limit(distance, semantics)
    points = points.select("qid", "lat", "lon")
    kinds = {}
    if "addr_cells" in index:
        kinds["a"] = _places(index["addr_cells"])
    if "interp_cells" in index:
        kinds["i"] = _numbered(index["interp_cells"], index["interp_ways"])
    if "street_cells" in index:
        kinds["s"] = _streets(index["street_cells"], index["street_ways"])
    wanted = {"a_road": ("a", lambda: F.col("a_p.street")), "a_number": ("a", lambda: F.col("a_p.housenumber")), "i_road": ("i", lambda: F.col("i_p.street")), "i_number": ("i", _number), "s_road": ("s", lambda: F.col("s_p.name"))}
    out = _found(points, kinds, street_level) if kinds else points
    out = out.select("qid", *((F.when(F.col(f"{k}_dist") < within, c()) if k in kinds else F.lit(None)).cast("string").alias(name) for name, (k, c) in wanted.items()))
    held = _containing(points, index["admin_cells"], index["admin_polygons"], semantics, admin_level)
    # The smallest of a level is the same if a polygon comes several times, so the pairs are not shuffled to be made distinct.
    admin = admin_fields(smallest_per_level(held.filter(F.col("admin_level").isin(*LEVEL_FIELDS))))
    # Both have a row a point; planners don't know, and would broadcast one.
    out = out.join(admin.hint("merge"), "qid", "left")
    number = F.when(F.col("a_road").isNotNull(), F.col("a_number")).when(F.col("i_road").isNotNull(), F.col("i_number"))
    out = out.withColumns({"house_number": number, "road": F.coalesce("a_road", "i_road", "s_road")})
    empty = F.coalesce("road", "country", "city", "state").isNull()
    out = out.select("qid", *(F.when(~empty, F.col(f)).alias(f) for f in FIELDS))
    return out.withColumn("display_name", display_name(F.col))
