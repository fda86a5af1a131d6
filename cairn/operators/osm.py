"""From nodes, ways and relations to addresses, streets, interpolation ways and boundaries.

Inputs: nodes(id, lat, lon, tags map), ways(id, refs array, tags map), relations(id, members
array<struct<type, ref, role>>, tags map). Ways are filtered by their tags before their nodes are looked
up, since that join is the dominant shuffle at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geom import interpolation_code, is_border_line, is_street

MAX_NODES = 255
ADMIN_LEVELS, POSTAL_LEVEL = (2, 10), 11


def tag(name: str) -> Column:
    return F.col("tags")[name]


def valid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def node_addresses(nodes: DataFrame) -> DataFrame:
    """(addr_id, lat, lon, housenumber, street) of nodes that have both tags."""
    both = tag("addr:housenumber").isNotNull() & tag("addr:street").isNotNull()
    named = (tag("addr:housenumber").alias("housenumber"), tag("addr:street").alias("street"))
    return valid_nodes(nodes).filter(both).select(F.concat(F.lit("node/"), "id").alias("addr_id"), "lat", "lon", *named)


def resolve(ways: DataFrame, nodes: DataFrame, key: str = "way_id") -> DataFrame:
    """``ways`` (key, refs) -> (key, nodes: found ones in order, complete: all were found).

    One shuffle of all references and one back; order is kept by position. Ways without references, or of
    which no node is found, have an empty list.
    """
    refs = ways.select(key, F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(valid_nodes(nodes).select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("_n"))
    line = F.transform("_n", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    out = ways.join(lists.select(key, line.alias("nodes")), key, "left")
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    return out.withColumn("nodes", F.coalesce("nodes", none)).withColumn("complete", F.size("nodes") == F.size("refs"))


def building_addresses(resolved: DataFrame) -> DataFrame:
    """Ways with both address tags: the mean of the nodes found (a closing node counts twice)."""
    mean = lambda c: F.aggregate("nodes", F.lit(0.0), lambda s, p: s + p[c], lambda s: s / F.size("nodes"))
    both = tag("addr:housenumber").isNotNull() & tag("addr:street").isNotNull() & tag("addr:interpolation").isNull() & (F.size("nodes") > 0)
    return resolved.filter(both).select(F.concat(F.lit("way/"), "way_id").alias("addr_id"), mean("lat").alias("lat"), mean("lon").alias("lon"), tag("addr:housenumber").alias("housenumber"), tag("addr:street").alias("street"))


def narrow(nodes: str = "nodes") -> Column:
    """The first MAX_NODES nodes in single precision."""
    return F.transform(F.slice(nodes, 1, MAX_NODES), lambda p: F.struct(p["lat"].cast("float").alias("lat"), p["lon"].cast("float").alias("lon")))


def street_ways(resolved: DataFrame) -> DataFrame:
    """(way_id, name, nodes) of named streets whose nodes are all there; interpolation ways are none."""
    ok = is_street(tag("highway")) & tag("name").isNotNull() & F.col("complete") & (F.size("refs") >= 2) & tag("addr:interpolation").isNull()
    return resolved.filter(ok).select("way_id", tag("name").alias("name"), narrow().alias("nodes"))


def interpolation_ways(resolved: DataFrame) -> DataFrame:
    """(interp_id, street, interpolation, nodes)."""
    ok = tag("addr:interpolation").isNotNull() & tag("addr:street").isNotNull() & F.col("complete") & (F.size("refs") >= 2)
    return resolved.filter(ok).select(F.col("way_id").alias("interp_id"), tag("addr:street").alias("street"), interpolation_code(tag("addr:interpolation")).alias("interpolation"), narrow().alias("nodes"))


def boundary(tags=tag, max_level: int = 0) -> tuple[Column, Column, Column, Column]:
    """Of a boundary's tags: whether it is one, its level, its label and its country code."""
    admin, postal = tags("boundary") == "administrative", tags("boundary") == "postal_code"
    number = F.regexp_extract(F.coalesce(tags("admin_level"), F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    level = F.when(admin, number).when(postal, POSTAL_LEVEL)
    label = F.when(postal, F.coalesce(tags("postal_code"), tags("name"))).otherwise(tags("name"))
    ok = (level.between(*ADMIN_LEVELS) & admin) | postal
    if max_level:
        ok &= level <= max_level
    country = F.coalesce(F.when(level == 2, tags("ISO3166-1:alpha2")), F.lit(""))
    return F.coalesce(ok & label.isNotNull(), F.lit(False)), level, label, country


def country_code(code: Column) -> Column:
    """Its first two letters; empty if there are fewer."""
    return F.when(F.length(code) >= 2, F.substring(code, 1, 2)).otherwise("")


def boundary_relations(relations: DataFrame, max_level: int = 0) -> DataFrame:
    """(rel_id, admin_level, name, country_code, members array<struct<pos, way_id, role>>), border lines left out."""
    ok, level, label, country = boundary(max_level=max_level)
    ways = F.filter(F.transform("members", lambda m, i: F.struct(i.alias("pos"), m["type"].alias("type"), m["ref"].alias("way_id"), m["role"].alias("role"))), lambda m: m["type"] == "way")
    out = relations.filter(ok).select(F.col("id").alias("rel_id"), level.alias("admin_level"), label.alias("name"), country.alias("country_code"), F.transform(ways, lambda m: F.struct(m["pos"].alias("pos"), m["way_id"].alias("way_id"), m["role"].alias("role"))).alias("members"))
    return out.filter((F.size("members") > 0) & ~is_border_line(F.col("admin_level"), F.col("country_code"), F.col("name")))


def closed_boundaries(resolved: DataFrame, max_level: int = 0) -> DataFrame:
    """(source, admin_level, name, country_code, ring) of closed boundary ways with at least four references."""
    ok, level, label, country = boundary(max_level=max_level)
    closed = (F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)) & F.col("complete")
    return resolved.filter(ok & closed).select(F.concat(F.lit("way/"), "way_id").alias("source"), level.alias("admin_level"), label.alias("name"), country.alias("country_code"), F.col("nodes").alias("ring"))


def complete_members(relations: DataFrame, geometries: DataFrame) -> DataFrame:
    """(rel_id, pos, way_id, role, nodes): members of the relations all of whose ways have a geometry."""
    members = relations.select("rel_id", F.explode("members").alias("m")).select("rel_id", "m.*")
    with_lines = members.join(geometries.select("way_id", "nodes"), "way_id", "left")
    broken = with_lines.filter(F.col("nodes").isNull()).select("rel_id").distinct()
    return with_lines.join(broken, "rel_id", "left_anti")


def member_diagnostics(relations: DataFrame, geometries: DataFrame) -> DataFrame:
    """(rel_id, total, found, missing): how many members of each relation have a geometry."""
    members = relations.select("rel_id", F.explode("members.way_id").alias("way_id"))
    known = members.join(geometries.select("way_id", F.lit(True).alias("_ok")).distinct(), "way_id", "left")
    out = known.groupBy("rel_id").agg(F.count(F.lit(1)).alias("total"), F.count("_ok").alias("found"))
    return out.withColumn("missing", F.col("total") - F.col("found"))


def with_numbers(interp: DataFrame, addresses: DataFrame) -> DataFrame:
    """``interp`` with start_number and end_number: those of the addresses where the way begins and ends.

    Planners take all addresses, grouped, for smaller than their file and would broadcast them, once for each end: they are merged.
    """
    from cairn.functions.geom import grid_key, house_number

    y, x = grid_key(F.col("lat"), F.col("lon"))
    known = addresses.select(y.alias("_y"), x.alias("_x"), "addr_id", "housenumber").groupBy("_y", "_x").agg(house_number(F.max_by("housenumber", "addr_id")).alias("_h")).hint("merge")
    for name, at in (("start_number", 1), ("end_number", -1)):
        p = F.element_at("nodes", at)
        y, x = grid_key(p["lat"], p["lon"])
        interp = interp.withColumns({"_y": y, "_x": x}).join(known, ["_y", "_x"], "left").withColumn(name, F.coalesce("_h", F.lit(0).cast("long"))).drop("_y", "_x", "_h")
    return interp
