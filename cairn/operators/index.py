"""Index tables: cell postings, modes, continents, statistics, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import cells
from cairn.functions.cover import cells_of_polygon
from cairn.functions.geom import fitted, polygon_area, rotated, simplify_polygon  # noqa: F401
from cairn.operators.osm import country_code

#: Tables by mode: all, without addresses, boundaries only.
MODES = {
    "full": ("addr_points", "addr_cells", "street_ways", "street_cells", "interp_ways", "interp_cells", "admin_polygons", "admin_cells"),
    "no_addresses": ("street_ways", "street_cells", "admin_polygons", "admin_cells"),
    "admin_only": ("admin_polygons", "admin_cells"),
}
#: Name and least and greatest latitude and longitude.
CONTINENTS = (
    ("africa", -35.0, 37.5, -25.0, 55.0),
    ("asia", -12.0, 82.0, 25.0, 180.0),
    ("europe", 35.0, 72.0, -25.0, 45.0),
    ("north-america", 7.0, 84.0, -170.0, -50.0),
    ("south-america", -56.0, 13.0, -82.0, -34.0),
    ("oceania", -50.0, 0.0, 110.0, 180.0),
    ("central-america", 7.0, 23.5, -120.0, -57.0),
    ("antarctica", -90.0, -60.0, -180.0, 180.0),
)


def address_cells(addr: DataFrame, level: int = cells.STREET_LEVEL) -> DataFrame:
    """Addresses with their cell; what a lookup needs lies in the posting itself, so it costs one join."""
    single = lambda c: F.col(c).cast("float").alias(c)
    return addr.select(cells.cell(F.col("lat"), F.col("lon"), level).alias("cell"), "addr_id", single("lat"), single("lon"), "housenumber", "street")


def line_cells(ways: DataFrame, key: str, level: int = cells.STREET_LEVEL) -> DataFrame:
    return ways.select(F.explode(cells.cells_of_line(F.col("nodes"), level)).alias("cell"), key)


def prepare_polygons(rings: DataFrame, key: str = "poly_id") -> DataFrame:
    """(key, name, admin_level, country_code, ring) -> admin_polygons: turned, simplified, narrowed, measured."""
    out = rings.filter(F.size("ring") >= 3).withColumn("ring", simplify_polygon(rotated(F.col("ring")))).filter(F.size("ring") >= 3)
    single = F.transform("ring", lambda p: F.struct(p["lat"].cast("float").alias("lat"), p["lon"].cast("float").alias("lon")))
    return out.select(key, "name", "admin_level", country_code(F.col("country_code")).alias("country_code"), single.alias("vertices")).withColumn("area", polygon_area(F.col("vertices")))


def polygon_cells(polygons: DataFrame, key: str = "poly_id", level: int = cells.ADMIN_LEVEL) -> DataFrame:
    """(cell, key, is_interior)."""
    return polygons.select(key, F.explode(cells_of_polygon(F.col("vertices"), level)).alias("c")).select("c.cell", key, "c.is_interior")


def postings(pairs: DataFrame, key: str) -> DataFrame:
    """(cell, ids): sorted distinct ids of each cell, for exports."""
    return pairs.groupBy("cell").agg(F.sort_array(F.collect_set(key)).alias("ids"))


def merged_cells(street: DataFrame, addr: DataFrame, interp: DataFrame) -> DataFrame:
    """(cell, n_streets, n_addresses, n_interps): every cell of any kind once."""
    n = lambda df, name: df.groupBy("cell").agg(F.count(F.lit(1)).alias(name))
    out = n(street, "n_streets").join(n(addr, "n_addresses"), "cell", "full_outer").join(n(interp, "n_interps"), "cell", "full_outer")
    return out.select("cell", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_streets", "n_addresses", "n_interps")))


def continents(spark) -> DataFrame:
    return spark.createDataFrame(CONTINENTS, "continent string, lat0 double, lat1 double, lon0 double, lon1 double")


def by_continent(pairs: DataFrame, level: int = cells.STREET_LEVEL) -> DataFrame:
    """``pairs`` (cell, ...) with ``continent``, once for each box that holds the cell's centre (boxes overlap)."""
    boxes = F.broadcast(continents(pairs.sparkSession))
    at = pairs.withColumn("_at", cells.cell_centre(F.col("cell"), level))
    held = F.col("_at.lat").between(F.col("lat0"), F.col("lat1")) & F.col("_at.lon").between(F.col("lon0"), F.col("lon1"))
    return at.join(boxes, held).select(*pairs.columns, "continent")


def used_by_continent(table: DataFrame, pairs: DataFrame, key: str, level: int = cells.STREET_LEVEL) -> DataFrame:
    """Rows of ``table`` with each continent in which one of their cells lies."""
    return table.join(by_continent(pairs, level).select(key, "continent").distinct(), key)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with repeats) of one only, with ``side``: an order-insensitive comparison of two builds."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
