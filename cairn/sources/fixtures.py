"""Spatial tables derived from the driver's tables. One text serves Spark and ANSI SQL engines alike:
integer arithmetic and one division by 1e5, so both get the same coordinates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACES = "(VALUES (0), (1), (2), (3), (4), (5)) AS p(v)"

SQL = {
    "addr_points": """SELECT c_custkey AS addr_id, CAST((4370000 + (c_custkey * 7919) % 9973) / 1e5 AS FLOAT) AS lat,
        CAST((740000 + (c_custkey * 104729) % 9967) / 1e5 AS FLOAT) AS lon,
        CONCAT(CAST(c_custkey % 200 AS STRING), SUBSTRING('abcdefgh', CAST(c_custkey % 8 AS INT) + 1, 1)) AS housenumber,
        CONCAT('Rue ', c_mktsegment) AS street FROM {customer}""",
    "points": """SELECT o_orderkey AS qid, (4370000 + (o_orderkey * 6101) % 9949) / 1e5 AS lat,
        (740000 + (o_orderkey * 15485863) % 9941) / 1e5 AS lon FROM {orders}""",
    "street_nodes": f"""SELECT p_partkey AS way_id, CONCAT(p_brand, ' ', p_name) AS name, v AS pos,
        CAST((4370000 + (p_partkey * 3571) % 9941 + v * ((p_partkey * 37) % 61)) / 1e5 AS FLOAT) AS lat,
        CAST((740000 + (p_partkey * 7877) % 9929 + v * ((p_partkey * 53) % 59 - 29)) / 1e5 AS FLOAT) AS lon
        FROM {{part}} CROSS JOIN {_PLACES} WHERE v < 2 + p_size % 5""",
    "interp_nodes": f"""SELECT s_suppkey AS interp_id, CONCAT('Interp ', s_name) AS street, s_suppkey % 3 AS interpolation, v AS pos,
        CAST((4370000 + (s_suppkey * 5003) % 9931 + v * ((s_suppkey * 41) % 47 + 3)) / 1e5 AS FLOAT) AS lat,
        CAST((740000 + (s_suppkey * 2003) % 9923 + v * ((s_suppkey * 43) % 53 - 26)) / 1e5 AS FLOAT) AS lon
        FROM {{supplier}} CROSS JOIN {_PLACES} WHERE v < 2 + s_suppkey % 2""",
    "end_addr": """SELECT 10000000 + 2 * s_suppkey + e AS addr_id,
        CAST((4370000 + (s_suppkey * 5003) % 9931 + e * (1 + s_suppkey % 2) * ((s_suppkey * 41) % 47 + 3)) / 1e5 AS FLOAT) AS lat,
        CAST((740000 + (s_suppkey * 2003) % 9923 + e * (1 + s_suppkey % 2) * ((s_suppkey * 43) % 53 - 26)) / 1e5 AS FLOAT) AS lon,
        CASE WHEN s_suppkey % 11 = 0 THEN 'none' WHEN (s_suppkey % 5 = 0) = (e = 0) THEN CONCAT(CAST(20 + s_suppkey % 50 AS STRING), 'b')
             ELSE CAST(2 + s_suppkey % 9 AS STRING) END AS housenumber, CONCAT('Interp ', s_name) AS street
        FROM {supplier} CROSS JOIN (VALUES (0), (1)) AS p(e) WHERE s_suppkey % 13 <> 0""",
    "polygons": """SELECT 2000000 + r_regionkey AS poly_id, CONCAT('Country ', r_name) AS name, 2 AS admin_level,
        CASE r_regionkey WHEN 0 THEN 'FR' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'DEU' ELSE '' END AS cc,
        4370000 + r_regionkey * 1900 AS clat, 740000 + r_regionkey * 2100 AS clon, 2500 AS h, r_regionkey % 2 AS diamond FROM {region}
        UNION ALL SELECT l * 1000000 + n_nationkey, CONCAT('Area ', CAST(l AS STRING), ' ', n_name), l, '', 4370000 + (n_nationkey * 397 + l * 31) % 9000,
        740000 + (n_nationkey * 1543 + l * 57) % 9000, 2600 - 200 * l, (n_nationkey + l) % 2
        FROM {nation} CROSS JOIN (VALUES (3), (4), (6), (8), (11)) AS p(l)""",
    "polygon_vertices": """SELECT poly_id, name, admin_level, cc, v AS pos,
        CAST((clat + CASE WHEN diamond = 0 THEN CASE WHEN v IN (0, 3) THEN -h ELSE h END ELSE CASE v WHEN 0 THEN -h WHEN 2 THEN h ELSE 0 END END) / 1e5 AS FLOAT) AS lat,
        CAST((clon + CASE WHEN diamond = 0 THEN CASE WHEN v IN (0, 1) THEN -h ELSE h END ELSE CASE v WHEN 1 THEN -h WHEN 3 THEN h ELSE 0 END END) / 1e5 AS FLOAT) AS lon
        FROM (<polygons>) AS g CROSS JOIN (VALUES (0), (1), (2), (3)) AS q(v)""",
    "nodes": """SELECT p_partkey AS id, (4370000 + (p_partkey * 3571) % 9941) / 1e5 AS lat, (740000 + (p_partkey * 7877) % 9929) / 1e5 AS lon,
        CASE WHEN p_partkey % 3 = 0 THEN CONCAT(CAST(p_size AS STRING), p_brand) END AS housenumber,
        CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS street FROM {part} WHERE p_partkey % 97 <> 0""",
    "way_refs": """SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS ref FROM {lineitem}""",
    "way_tags": """SELECT o_orderkey AS way_id,
        CASE o_orderkey % 13 WHEN 0 THEN 'footway' WHEN 1 THEN 'residential' WHEN 2 THEN 'primary' WHEN 3 THEN 'steps' WHEN 4 THEN 'service' WHEN 5 THEN 'path' END AS highway,
        CASE WHEN o_orderkey % 4 <> 0 THEN CONCAT('Street ', o_orderpriority) END AS name,
        CASE o_orderkey % 17 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' WHEN 2 THEN 'all' END AS interpolation,
        CASE WHEN o_orderkey % 6 = 0 THEN CONCAT(CAST(o_orderkey % 90 AS STRING), '-x') END AS housenumber,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS street FROM {orders}""",
    "relations": """SELECT c_custkey AS rel_id,
        CASE c_custkey % 5 WHEN 0 THEN 'postal_code' WHEN 4 THEN 'historic' ELSE 'administrative' END AS boundary,
        CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE CAST(c_custkey % 13 AS STRING) END AS admin_level,
        CASE WHEN c_custkey % 19 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 3 = 0 THEN CONCAT(c_mktsegment, ' - ', c_name) ELSE c_name END AS name,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(98000 + c_custkey AS STRING) END AS postal_code,
        CASE WHEN c_custkey % 4 = 0 THEN 'FRA' WHEN c_custkey % 4 = 1 THEN 'U' END AS iso FROM {customer}""",
    "rel_members": """SELECT o_custkey AS rel_id, o_orderkey AS way_id, CASE o_orderkey % 3 WHEN 0 THEN 'outer' WHEN 1 THEN '' ELSE 'inner' END AS role FROM {orders}""",
    "requests": """SELECT event_id AS req_id, ts, CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 97 = 0 THEN 'unknown' ELSE CONCAT('t:', event_type) END AS token,
        CONCAT('ip', CAST(user_id % 3 AS STRING)) AS ip, event_type FROM {events}""",
    "users": """SELECT DISTINCT event_type AS login, FALSE AS admin, CASE WHEN event_type < 'd' THEN 0 ELSE 1 END AS rate_per_second,
        CASE WHEN event_type < 'b' THEN 0 ELSE 50 END AS rate_per_day, event_type > 's' AS rate_by_ip FROM {events}""",
    "tokens": """SELECT DISTINCT CONCAT('t:', event_type) AS token, event_type AS login FROM {events}""",
    "world": """SELECT event_id AS id, ((event_id * 7919) % 170011 - 85000) / 1e3 AS lat, ((event_id * 104729) % 359981 - 179990) / 1e3 AS lon FROM {events}""",
}


def text(name: str, named=lambda t: t) -> str:
    """The fixture's SQL, its tables named by ``named``."""
    sql = re.sub(r"<(\w+)>", lambda m: SQL[m[1]], SQL[name])
    return re.sub(r"\{(\w+)\}", lambda m: named(m[1]), sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"<(\w+)>", lambda m: SQL[m[1]], SQL[name])
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


def arrays(rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Long rows (keys, pos, lat, lon) -> one row with the ordered array<struct<lat, lon>>."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias(into))
