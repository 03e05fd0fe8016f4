"""The registry of queries: each applies an operator to the driver's tables; SQL is its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB text."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    """c rounded to six digits, under a name: sums of doubles have no fixed order."""
    return F.round(c, 6).alias(name)


def grid_width(n: int) -> int:
    return 30 if n <= 1500 else 100 if n <= 15000 else 300


def elev(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """(cells, height, width): orders as a grid: cid, i, j, h, zone."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    w = grid_width(n)
    cells = orders.select(
        F.col("o_orderkey").alias("cid"),
        F.floor(F.col("o_orderkey") / w).alias("i"),
        (F.col("o_orderkey") % w).alias("j"),
        F.col("o_totalprice").alias("h"),
        F.col("o_orderpriority").alias("zone"),
    )
    return cells, -(-n // w), w


def with_rain(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """cells with rain, the summed quantity of the order's lines (0 without)."""
    rain = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cid")).agg(F.sum("l_quantity").alias("q"))
    return cells.join(rain, "cid", "left").withColumn("rain", F.coalesce("q", F.lit(0.0))).drop("q")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the unit vector x, y, z of the first three elements of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    a = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return e.select("vec_id", "label", *[(c / n).alias(x) for c, x in zip(a, "xyz")])


#: DuckDB texts of the same fixtures.
ELEV = """w AS (SELECT CASE WHEN count(*) <= 1500 THEN 30 WHEN count(*) <= 15000 THEN 100 ELSE 300 END AS w FROM orders),
rn AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
elev AS (SELECT o.o_orderkey AS cid, o.o_orderkey // w.w AS i, o.o_orderkey % w.w AS j, o.o_totalprice AS h,
  o.o_orderpriority AS zone, coalesce(rn.q, 0.0) AS rain
  FROM orders o CROSS JOIN w LEFT JOIN rn ON o.o_orderkey = rn.l_orderkey),
dim AS (SELECT max(i) + 1 AS hh, max(w.w) AS ww FROM elev, w)"""
#: The same without the zone, for recursive texts: strings make DuckDB fail there.
ELEVN = ELEV.replace("\n  o.o_orderpriority AS zone,", "").replace("o.o_totalprice AS h", "o.o_totalprice + 0.0 AS h")
OFF = "off(k, di, dj) AS (VALUES (0,1,0),(1,1,1),(2,0,1),(3,-1,1),(4,-1,0),(5,-1,-1),(6,0,-1),(7,1,-1))"
NBR = OFF + """,
nbr AS (SELECT a.cid, a.i, a.j, a.h, a.zone, a.rain, o.k, b.cid AS nid, b.h AS nh, b.zone AS nzone, b.rain AS nrain
  FROM elev a CROSS JOIN off o JOIN elev b ON b.i = a.i + o.di AND b.j = a.j + o.dj)"""
NBRN = NBR.replace("a.zone, ", "").replace("b.zone AS nzone, ", "")
D8 = """best AS (SELECT cid, max_by({'k': k, 'nid': nid}, {'s': (h - nh) / CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1.0 END, 'k': -k}) AS b
  FROM nbr WHERE h > nh GROUP BY cid),
d8 AS (SELECT e.cid, e.i, e.j, e.h, e.rain, coalesce(b.b.k, 255) AS code, coalesce(b.b.nid, e.cid) AS down FROM elev e LEFT JOIN best b USING (cid))"""
PATHS = """up(cid, root, depth) AS (SELECT cid, cid, 0 FROM d8 WHERE code = 255
  UNION ALL SELECT d.cid, u.root, u.depth + 1 FROM up u JOIN d8 d ON d.down = u.cid AND d.cid <> u.cid)"""
CLOUD = """cloud AS (SELECT vec_id, label, a / n AS x, b / n AS y, c / n AS z FROM (
  SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c,
    sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE + embedding[3]::DOUBLE * embedding[3]::DOUBLE) AS n FROM embeddings))"""
N = 16
SPHERE = f"""bases(face, rx, ry, rz, ux, uy, uz, nx, ny, nz) AS (VALUES (0,0,0,-1,0,-1,0,1,0,0),(1,0,0,1,0,-1,0,-1,0,0),
  (2,1,0,0,0,0,1,0,1,0),(3,1,0,0,0,0,-1,0,-1,0),(4,1,0,0,0,-1,0,0,0,1),(5,-1,0,0,0,-1,0,0,0,-1)),
cells AS (SELECT cid, cid // {N * N} AS face, (cid // {N}) % {N} AS i, cid % {N} AS j, ((cid // {N}) % {N} + 0.5::DOUBLE) / {N} AS u, (cid % {N} + 0.5::DOUBLE) / {N} AS v FROM range({6 * N * N}) t(cid)),
tans AS (SELECT *, tan((u - 0.5) * pi() / 2) AS s, tan((v - 0.5) * pi() / 2) AS t FROM cells),
raw AS (SELECT c.*, b.* EXCLUDE (face), nx + s * rx + t * ux AS qx, ny + s * ry + t * uy AS qy, nz + s * rz + t * uz AS qz FROM tans c JOIN bases b USING (face)),
sph AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS ql, qx / sqrt(qx * qx + qy * qy + qz * qz) AS x, qy / sqrt(qx * qx + qy * qy + qz * qz) AS y, qz / sqrt(qx * qx + qy * qy + qz * qz) AS z FROM raw)"""
#: d p / d u and d p / d v, and the metric, on top of SPHERE.
JAC = """jac AS (SELECT *, pi() / 2 * (1 + s * s) AS ds, pi() / 2 * (1 + t * t) AS dt FROM sph),
jac2 AS (SELECT *, ds * (x * rx + y * ry + z * rz) AS pu, dt * (x * ux + y * uy + z * uz) AS pv FROM jac),
jac3 AS (SELECT *, (rx * ds - x * pu) / ql AS jux, (ry * ds - y * pu) / ql AS juy, (rz * ds - z * pu) / ql AS juz,
  (ux * dt - x * pv) / ql AS jvx, (uy * dt - y * pv) / ql AS jvy, (uz * dt - z * pv) / ql AS jvz FROM jac2),
met AS (SELECT *, jux * jux + juy * juy + juz * juz AS guu, jux * jvx + juy * jvy + juz * jvz AS guv, jvx * jvx + jvy * jvy + jvz * jvz AS gvv FROM jac3)"""
