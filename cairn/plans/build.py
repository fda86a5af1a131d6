"""The index build: from nodes, ways and relations to the tables that lookups read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import cells
from cairn.operators import index, osm, rings

VERSION = 1


def build(nodes: DataFrame, ways: DataFrame, relations: DataFrame, max_admin_level: int = 0, street_level: int = cells.STREET_LEVEL, admin_level: int = cells.ADMIN_LEVEL, mode: str = "full") -> dict[str, DataFrame]:
    """All tables of ``mode`` (see index.MODES).

    Only ways that some table needs take part in the node join: tagged ones, and members of boundaries.
    """
    bounds = osm.boundary_relations(relations, max_admin_level)
    members = bounds.select(F.explode("members.way_id").alias("way_id")).distinct().withColumn("_member", F.lit(True))
    tagged = F.coalesce(osm.tag("highway"), osm.tag("addr:interpolation"), osm.tag("addr:housenumber"), osm.tag("boundary")).isNotNull()
    needed = ways.withColumnRenamed("id", "way_id").join(members, "way_id", "left").filter(tagged | F.col("_member"))
    lines = osm.resolve(needed, nodes)
    polygons = osm.closed_boundaries(lines, max_admin_level)
    geometries = lines.filter(F.col("_member") & F.col("complete") & (F.size("refs") >= 1))
    assembled = rings.assemble(osm.complete_members(bounds, geometries)).join(bounds.drop("members"), "rel_id")
    assembled = assembled.select(F.concat(F.lit("relation/"), "rel_id", F.lit("/"), "ring_no").alias("source"), "admin_level", "name", "country_code", "ring")
    areas = index.prepare_polygons(polygons.unionByName(assembled).withColumnRenamed("source", "poly_id"))
    tables = {"admin_polygons": areas, "admin_cells": index.polygon_cells(areas, level=admin_level)}
    if mode != "admin_only":
        streets = osm.street_ways(lines)
        tables |= {"street_ways": streets, "street_cells": index.line_cells(streets, "way_id", street_level)}
    if mode == "full":
        addr = osm.node_addresses(nodes).unionByName(osm.building_addresses(lines))
        interp = osm.with_numbers(osm.interpolation_ways(lines), addr)
        tables |= {"addr_points": addr, "addr_cells": index.address_cells(addr, street_level), "interp_ways": interp, "interp_cells": index.line_cells(interp, "interp_id", street_level)}
    return {t: tables[t] for t in index.MODES[mode]}


def _write(df: DataFrame, path: str, files: int | None = None, by: str | None = None) -> None:
    if "cell" in df.columns:
        df = (df.repartitionByRange(files, "cell") if files else df.repartitionByRange("cell")).sortWithinPartitions("cell")
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def _note(spark: SparkSession, path: str, places: dict[str, str]) -> None:
    """What load() reads: the tables of an index and where each lies, seen from ``path``."""
    row = (VERSION, sorted(places), [places[t] for t in sorted(places)])
    spark.createDataFrame([row], "version int, tables array<string>, places array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/_meta.json")


def save(tables: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """One Parquet table each; postings are range-partitioned and sorted by cell, so that footers prune probes."""
    for name, df in tables.items():
        _write(df, f"{path}/{name}", files)
    _note(next(iter(tables.values())).sparkSession, path, {t: t for t in tables})


def folder(mode: str) -> str:
    return mode.replace("_", "-")


def save_modes(tables: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """An index for every mode that ``tables`` suffice for, below ``path``: each table is written once, and the
    index of a mode names those that it has."""
    for name, df in tables.items():
        _write(df, f"{path}/tables/{name}", files)
    for mode, needed in index.MODES.items():
        if set(needed) <= tables.keys():
            _note(next(iter(tables.values())).sparkSession, f"{path}/{folder(mode)}", {t: f"../tables/{t}" for t in needed})


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved index, whatever its mode. A directory without boundaries is no index, and one with
    some of the tables of streets and addresses but not all that its mode needs is a partial one: both are errors."""
    from pyspark.errors import AnalysisException

    meta = spark.read.json(f"{path}/_meta.json").first()
    if meta is None or meta.version != VERSION or "admin_polygons" not in meta.tables:
        raise ValueError(f"no index of version {VERSION} in {path}")
    mode = min((m for m, needed in index.MODES.items() if set(meta.tables) <= set(needed)), key=lambda m: len(index.MODES[m]), default="full")
    if missing := set(index.MODES[mode]) - set(meta.tables):
        raise ValueError(f"partial index in {path}: {', '.join(sorted(missing))} missing")
    found = {}
    for table, place in zip(meta.tables, meta.places, strict=True):
        try:
            found[table] = spark.read.parquet(f"{path}/{place}")
        except AnalysisException as e:
            raise ValueError(f"partial index in {path}: {table} missing") from e
    return found


#: Tables, their postings and key, and whether they are of the level of boundaries.
KINDS = (("street_ways", "street_cells", "way_id", False), ("addr_points", "addr_cells", "addr_id", False), ("interp_ways", "interp_cells", "interp_id", False), ("admin_polygons", "admin_cells", "poly_id", True))


def save_by_continent(tables: dict[str, DataFrame], path: str, street_level: int = cells.STREET_LEVEL, admin_level: int = cells.ADMIN_LEVEL, files: int | None = None) -> None:
    """Each table once, partitioned by continent: postings whose cell lies in its box, and the rows they name.
    Below ``path``/<continent>/<mode> lies an index that load() opens, for every mode that ``tables`` suffice for."""
    for kind, posts, key, admin in KINDS:
        if kind in tables:
            level = admin_level if admin else street_level
            _write(index.by_continent(tables[posts], level), f"{path}/{posts}", files, "continent")
            _write(index.used_by_continent(tables[kind], tables[posts], key, level), f"{path}/{kind}", None, "continent")
    spark = next(iter(tables.values())).sparkSession
    there = {(t, r.continent) for t in tables for r in spark.read.parquet(f"{path}/{t}").select("continent").distinct().collect()}  # eight at most
    for continent, *_ in index.CONTINENTS:
        for mode, needed in index.MODES.items():
            if set(needed) <= tables.keys():
                for t in needed:
                    if (t, continent) not in there:  # nothing lies there: an empty table
                        tables[t].limit(0).write.mode("overwrite").parquet(f"{path}/{t}/continent={continent}")
                        there.add((t, continent))
                _note(spark, f"{path}/{continent}/{folder(mode)}", {t: f"../../{t}/continent={continent}" for t in needed})
