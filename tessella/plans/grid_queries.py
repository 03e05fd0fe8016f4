"""Queries of projections, masks, neighbour joins and raster operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import rules
from ..operators import grid
from ..operators.graph import settled
from .registry import CLOUD, ELEV, JAC, N, NBR, OFF, SPHERE, cloud, elev, query, r6, table, with_rain

# --- projections -------------------------------------------------------------------------------


@query(f"WITH {SPHERE} SELECT cid, face::INT AS face, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sph")
def p1_to_sphere(spark, sf_dir):
    return grid.sphere_cells(spark, N).select("cid", "face", *[r6(F.col(c), c) for c in "xyz"])


@query(f"WITH {SPHERE} SELECT cid, face::INT AS face, i, j, round(u, 6) AS u, round(v, 6) AS v FROM sph")
def p2_from_sphere(spark, sf_dir):
    """Round trip: the face and parameters come from the vector alone."""
    c = grid.sphere_cells(spark, N)
    p = [F.col(k) for k in "xyz"]
    face = geo.face_of(p)
    u, v = geo.project_to_face(face, p)
    return c.select("cid", face.cast("int").alias("face"), geo.cell_of(u, N).alias("i"), geo.cell_of(v, N).alias("j"), r6(u, "u"), r6(v, "v"))


@query(f"""WITH {SPHERE} SELECT cid, round(atan((x * 0 + y * 0 + z * -1) / x) * 2 / pi() + 0.5, 6) AS u, round(atan(-y / x) * 2 / pi() + 0.5, 6) AS v
FROM sph WHERE x > 0.2""")
def p3_project_to_face(spark, sf_dir):
    c = grid.sphere_cells(spark, N).where("x > 0.2")
    u, v = geo.project_to_face(F.lit(0), [F.col(k) for k in "xyz"])
    return c.select("cid", r6(u, "u"), r6(v, "v"))


@query(f"WITH {SPHERE}, {JAC} SELECT cid, round(guu, 6) AS guu, round(guv, 6) AS guv, round(gvv, 6) AS gvv FROM met")
def p4_metric(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    g = geo.metric(F.col("face"), F.col("u"), F.col("v"))
    return c.select("cid", *[r6(x, n) for x, n in zip(g, ("guu", "guv", "gvv"))])


@query(f"""WITH {SPHERE}, {JAC}, w AS (SELECT *, jux + 0.5 * jvx AS wx, juy + 0.5 * jvy AS wy, juz + 0.5 * jvz AS wz FROM met)
SELECT cid, round(sqrt(wx * wx + wy * wy + wz * wz), 6) AS length, 1.0::DOUBLE AS a, 0.5::DOUBLE AS b FROM w""")
def p5_transfer_vector(spark, sf_dir):
    """A tangent vector taken over to a neighbouring face: its length there, and its components once back."""
    c = grid.sphere_cells(spark, N)
    f, u, v = F.col("face"), F.col("u"), F.col("v")
    p = [F.col(k) for k in "xyz"]
    side = lambda x, k: F.when(x >= 0, k).otherwise(k + 1)
    g = F.when(f < 2, side(p[1], 2)).when(f < 4, side(p[2], 4)).otherwise(side(p[0], 0))
    c = c.withColumn("g", g)
    u2, v2 = geo.project_to_face(F.col("g"), p)
    c = settled(c.withColumns({"u2": u2, "v2": v2}))
    there = (F.col("g"), F.col("u2"), F.col("v2"))
    c = c.withColumns(dict(zip(("a2", "b2"), geo.transfer_vector(f, u, v, F.lit(1.0), F.lit(0.5), *there))))
    c = settled(c)  # else each of the many uses of a component would work it out again
    a2, b2 = F.col("a2"), F.col("b2")
    guu, guv, gvv = geo.metric(*there)
    a, b = geo.transfer_vector(*there, a2, b2, f, u, v)
    return c.select("cid", r6(F.sqrt(guu * a2 * a2 + 2 * guv * a2 * b2 + gvv * b2 * b2), "length"), r6(a, "a"), r6(b, "b"))


@query(f"""WITH {SPHERE} SELECT a.cid, round(acos(least(greatest(a.x * b.x + a.y * b.y + a.z * b.z, -1.0), 1.0)), 6) AS arc,
round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS chord FROM sph a JOIN sph b ON b.cid = 0""")
def p6_distances(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    first = c.where("cid = 0").select(*[F.col(k).alias(f"{k}0") for k in "xyz"])
    p, q = [F.col(k) for k in "xyz"], [F.col(f"{k}0") for k in "xyz"]
    d = [a - b for a, b in zip(p, q)]
    return c.join(F.broadcast(first)).select("cid", r6(geo.arc(p, q), "arc"), r6(F.sqrt(geo.dot(d, d)), "chord"))


@query(f"""WITH {SPHERE} SELECT cid, round(degrees(asin(least(greatest(z, -1.0), 1.0))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon,
round({N} * 1000.0 * 4 / (2 * pi()), 6) AS radius FROM sph""")
def p7_latitude_longitude(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    lat = F.degrees(F.asin(F.least(F.greatest(F.col("z"), F.lit(-1.0)), F.lit(1.0))))
    return c.select("cid", r6(lat, "lat"), r6(F.degrees(F.atan2("y", "x")), "lon"), r6(F.lit(geo.planet_radius(N, 1000.0)), "radius"))


@query(f"WITH {SPHERE} SELECT cid, face::INT AS face, i, j, ((face * {N} + i) * {N} + j)::BIGINT AS flat, round(u, 6) AS u, round(v, 6) AS v FROM sph")
def p8_flat_index(spark, sf_dir):
    """Surrogate key, composite key and cell centre."""
    c = grid.sphere_cells(spark, N)
    return c.select("cid", "face", "i", "j", ((F.col("face") * N + F.col("i")) * N + F.col("j")).cast("long").alias("flat"), r6(F.col("u"), "u"), r6(F.col("v"), "v"))


@query(f"""WITH {SPHERE}, {JAC} SELECT face::INT AS face, count(*) AS cells, round(sum(sqrt(guu * gvv - guv * guv) / {N * N}), 6) AS area FROM met GROUP BY face""")
def p10_cell_areas(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    guu, guv, gvv = geo.metric(F.col("face"), F.col("u"), F.col("v"))
    return c.withColumn("a", F.sqrt(guu * gvv - guv * guv) / (N * N)).groupBy("face").agg(F.count("a").alias("cells"), r6(F.sum("a"), "area"))


@query(f"""WITH {SPHERE}, {JAC} SELECT cid, round(sqrt(guu * x * x + 2 * guv * x * y + gvv * y * y), 6) AS norm FROM met""")
def p11_vector_norm(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    guu, guv, gvv = geo.metric(F.col("face"), F.col("u"), F.col("v"))
    x, y = F.col("x"), F.col("y")
    return c.select("cid", r6(F.sqrt(guu * x * x + 2 * guv * x * y + gvv * y * y), "norm"))


@query(f"""WITH {SPHERE}, {JAC}, e AS (SELECT *, -y / sqrt(x * x + y * y) AS ex, x / sqrt(x * x + y * y) AS ey FROM met WHERE x * x + y * y > 1e-9),
r AS (SELECT *, jux * ex + juy * ey AS ru, jvx * ex + jvy * ey AS rv, guu * gvv - guv * guv AS det FROM e)
SELECT cid, round((gvv * ru - guv * rv) / det, 6) AS a, round((guu * rv - guv * ru) / det, 6) AS b FROM r""")
def p12_geographic_frame(spark, sf_dir):
    """The cell components of the unit vector to the east."""
    c = grid.sphere_cells(spark, N).where("x * x + y * y > 1e-9")
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    a, b = geo.solve_tangent([-F.col("y") / n, F.col("x") / n, F.lit(0.0)], F.col("face"), F.col("u"), F.col("v"))
    return c.select("cid", r6(a, "a"), r6(b, "b"))


ROT = "plates(label, ox, oy, oz) AS (SELECT DISTINCT label, 0.1 * (label + 1), 0.05 * label, 0.2 FROM embeddings)"


@query(f"""WITH {CLOUD}, {ROT}, m AS (SELECT c.*, ox, oy, oz, sqrt(ox * ox + oy * oy + oz * oz) AS w FROM cloud c JOIN plates USING (label)),
k AS (SELECT *, ox / w AS kx, oy / w AS ky, oz / w AS kz, cos(w * 2.0) AS c, sin(w * 2.0) AS s FROM m),
q AS (SELECT vec_id, x * c + (ky * z - kz * y) * s + kx * (kx * x + ky * y + kz * z) * (1 - c) AS a,
  y * c + (kz * x - kx * z) * s + ky * (kx * x + ky * y + kz * z) * (1 - c) AS b,
  z * c + (kx * y - ky * x) * s + kz * (kx * x + ky * y + kz * z) * (1 - c) AS d,
  oy * z - oz * y AS va, oz * x - ox * z AS vb, ox * y - oy * x AS vc FROM k)
SELECT vec_id, round(a / sqrt(a * a + b * b + d * d), 6) AS x, round(b / sqrt(a * a + b * b + d * d), 6) AS y, round(d / sqrt(a * a + b * b + d * d), 6) AS z,
  round(sqrt(va * va + vb * vb + vc * vc), 6) AS speed FROM q""")
def p13_rotate_points(spark, sf_dir):
    """Every point turned about its plate's pole, and its velocity."""
    c = cloud(spark, sf_dir)
    plates = c.select("label").distinct().select("label", (0.1 * (F.col("label") + 1)).alias("ox"), (0.05 * F.col("label")).alias("oy"), F.lit(0.2).alias("oz"))
    m = c.join(plates, "label")
    p, o = [F.col(k) for k in "xyz"], [F.col(f"o{k}") for k in "xyz"]
    q, v = geo.rotate(p, o, 2.0), geo.cross(o, p)
    return m.select("vec_id", *[r6(x, n) for x, n in zip(q, "xyz")], r6(F.sqrt(geo.dot(v, v)), "speed"))


@query(f"""WITH {SPHERE} SELECT 2 AS lod, face::INT AS face, least(floor(u * 4), 3)::BIGINT AS tx, least(floor(v * 4), 3)::BIGINT AS ty, count(*) AS n FROM sph GROUP BY ALL""")
def p15_tile_of_point(spark, sf_dir):
    c = grid.sphere_cells(spark, N)
    return c.groupBy(F.lit(2).alias("lod"), "face", geo.cell_of(F.col("u"), 4).alias("tx"), geo.cell_of(F.col("v"), 4).alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELEV} SELECT i * 2 + s // 2 AS i, j * 2 + s % 2 AS j, h FROM elev, range(4) t(s)")
def p16_upsample(spark, sf_dir):
    return grid.upsample(elev(spark, sf_dir)[0].select("i", "j", "h"), 2)


# --- masks -------------------------------------------------------------------------------------


@query(f"WITH {ELEV} SELECT cid, (i = 0 OR j = 0 OR i = hh - 1 OR j = ww - 1) AS border FROM elev, dim")
def f1_border_mask(spark, sf_dir):
    c, h, w = elev(spark, sf_dir)
    return c.select("cid", ((F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == h - 1) | (F.col("j") == w - 1)).alias("border"))


@query(f"""WITH {ELEV}, {NBR}, t AS (SELECT cid, max((nzone = '1-URGENT')::INT) AS near FROM nbr GROUP BY cid)
SELECT cid, CASE WHEN zone = '1-URGENT' THEN 1 WHEN t.near = 1 THEN 2 ELSE 0 END AS mask FROM elev JOIN t USING (cid)""")
def f2_active_mask(spark, sf_dir):
    """1 inside, 2 the ring around it, 0 outside."""
    c, _, _ = elev(spark, sf_dir)
    wide = grid.stencil(c, ["zone"], keep=["cid"])
    near = F.lit(False)
    for k in range(8):
        near = near | F.coalesce(F.col(f"zone_{k}") == "1-URGENT", F.lit(False))
    return wide.select("cid", F.when(F.col("zone") == "1-URGENT", 1).when(near, 2).otherwise(0).alias("mask"))


@query(f"""WITH {ELEV} SELECT CASE WHEN h < 60000 THEN 'sea' WHEN rain > 150 AND h < 150000 THEN 'lake' ELSE 'land' END AS kind, count(*) AS n FROM elev GROUP BY 1""")
def f3_surface_kinds(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    kind = F.when(F.col("h") < 60000, "sea").when((F.col("rain") > 150) & (F.col("h") < 150000), "lake").otherwise("land")
    return c.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3 AND embedding[1] > 0")
def f4_compress(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where((F.col("label") != 3) & (F.get("embedding", F.lit(0)) > 0)).select("vec_id", "label")


@query(f"""WITH {ELEV} SELECT cid, (h > 200000 OR (h > 100000 AND rain < 50)) AS ice FROM elev""")
def f8_ice_mask(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    return c.select("cid", ((F.col("h") > 200000) | ((F.col("h") > 100000) & (F.col("rain") < 50))).alias("ice"))


@query(f"WITH {ELEV}, {NBR} SELECT DISTINCT cid FROM nbr WHERE zone <> nzone AND nzone = '5-LOW'")
def f10_is_neighbour(spark, sf_dir):
    """Cells of another zone beside a low-priority one: a semi-join on the neighbour edges."""
    c, _, _ = elev(spark, sf_dir)
    e = grid.edges(c, ["zone"], own=["zone"])
    return e.where((F.col("zone") != F.col("n_zone")) & (F.col("n_zone") == "5-LOW")).select("cid").distinct()


@query(f"""WITH {ELEV}, base AS (SELECT cid, i, j, CASE WHEN h < 60000 THEN 'ocean' WHEN rain > 150 THEN 'wetland' WHEN h > 250000 THEN 'alpine' ELSE 'plain' END AS cover FROM elev)
SELECT cover, count(*) AS n FROM base GROUP BY cover""")
def u4_overlay(spark, sf_dir):
    """Layers in order of precedence, the last one winning."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    cover = F.lit("plain")
    for test, name in ((F.col("h") > 250000, "alpine"), (F.col("rain") > 150, "wetland"), (F.col("h") < 60000, "ocean")):
        cover = F.when(test, name).otherwise(cover)
    return c.groupBy(cover.alias("cover")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'part' AS side, p_partkey AS id, p_retailprice AS price FROM part WHERE p_size < 5
UNION ALL SELECT 'order', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def u1_append(spark, sf_dir):
    a = table(spark, sf_dir, "part").where("p_size < 5").select(F.lit("part").alias("side"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("side"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.unionByName(b)


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2) EXCEPT SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def u2_keep(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("label").isin(1, 2)).select("vec_id").exceptAll(e.where("vec_id % 3 = 0").select("vec_id"))


@query(f"""WITH {ELEV} SELECT i, j, h, true AS valid FROM elev WHERE i < 10 UNION ALL SELECT i, j, h, false FROM elev WHERE i = 10""")
def u3_pad_rows(spark, sf_dir):
    """A block with the next block's first row attached, and marked so."""
    c = elev(spark, sf_dir)[0]
    own = c.where("i < 10").select("i", "j", "h", F.lit(True).alias("valid"))
    return own.unionByName(c.where("i = 10").select("i", "j", "h", F.lit(False).alias("valid")))


# --- neighbour joins and rasters ---------------------------------------------------------------


@query(f"WITH {ELEV}, {NBR} SELECT cid, round(sum(nh * 0.125), 6) AS g, count(*) AS n FROM nbr GROUP BY cid")
def j1_weighted_gather(spark, sf_dir):
    """Weighted sums over an edge table."""
    e = grid.edges(elev(spark, sf_dir)[0], ["h"])
    return e.groupBy("cid").agg(r6(F.sum(F.col("n_h") * 0.125), "g"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELEV}, {NBR} SELECT cid, k, nid FROM nbr")
def j2_neighbours(spark, sf_dir):
    return grid.edges(elev(spark, sf_dir)[0], []).select("cid", "k", "nid")


PTS = """pts AS (SELECT p_partkey AS pid, (p_partkey * 7919 % 9973) / 9973.0::DOUBLE * (hh - 1) AS a, (p_partkey * 104729 % 9967) / 9967.0::DOUBLE * (ww - 1) AS b FROM part, dim)"""


def points(spark, sf_dir, h, w):
    """Scattered sampling points of the grid."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("pid"),
        (F.col("p_partkey") * 7919 % 9973 / 9973.0 * (h - 1)).alias("a"),
        (F.col("p_partkey") * 104729 % 9967 / 9967.0 * (w - 1)).alias("b"),
    )


@query(f"""WITH {ELEV}, {PTS}, c AS (SELECT pid, least(floor(a)::BIGINT + s, hh - 1) AS i, least(floor(b)::BIGINT + t, ww - 1) AS j,
  (CASE WHEN s = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE WHEN t = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) AS w
  FROM pts, dim, range(2) s(s), range(2) t(t))
SELECT pid, round(sum(c.w * h), 6) AS h FROM c JOIN elev USING (i, j) GROUP BY pid""")
def j9_bilinear(spark, sf_dir):
    c, h, w = elev(spark, sf_dir)
    out = grid.sample(grid.corners(points(spark, sf_dir, h, w), "a", "b", h, w), c, "h", ["pid"])
    return out.select("pid", r6(F.col("h"), "h"))


@query(f"""WITH {ELEV}, {PTS}, f AS (SELECT pid, floor(a)::BIGINT AS i0, floor(b)::BIGINT AS j0, a - floor(a) AS s, b - floor(b) AS t, hh, ww FROM pts, dim),
c AS (SELECT pid, least(greatest(i0 + p - 1, 0), hh - 1) AS i, least(greatest(j0 + q - 1, 0), ww - 1) AS j,
  CASE p WHEN 0 THEN -s*(s-1)*(s-2)/6 WHEN 1 THEN (s+1)*(s-1)*(s-2)/2 WHEN 2 THEN -(s+1)*s*(s-2)/2 ELSE (s+1)*s*(s-1)/6 END *
  CASE q WHEN 0 THEN -t*(t-1)*(t-2)/6 WHEN 1 THEN (t+1)*(t-1)*(t-2)/2 WHEN 2 THEN -(t+1)*t*(t-2)/2 ELSE (t+1)*t*(t-1)/6 END AS w
  FROM f, range(4) p(p), range(4) q(q))
SELECT pid, round(sum(c.w * h), 4) AS h FROM c JOIN elev USING (i, j) GROUP BY pid""")
def j10_cubic(spark, sf_dir):
    c, h, w = elev(spark, sf_dir)
    out = grid.sample(grid.cubic_nodes(points(spark, sf_dir, h, w), "a", "b", h, w), c, "h", ["pid"])
    return out.select("pid", F.round("h", 4).alias("h"))


@query(f"WITH {ELEV}, {PTS} SELECT pid, cid, h FROM pts JOIN elev ON i = floor(a + 0.5)::BIGINT AND j = floor(b + 0.5)::BIGINT")
def j11_nearest_cell(spark, sf_dir):
    c, h, w = elev(spark, sf_dir)
    p = points(spark, sf_dir, h, w).select("pid", F.floor(F.col("a") + 0.5).alias("i"), F.floor(F.col("b") + 0.5).alias("j"))
    return p.join(c.select("i", "j", "cid", "h"), ["i", "j"]).select("pid", "cid", "h")


@query(f"""WITH {ELEV}, coarse AS (SELECT i // 5 AS bi, j // 5 AS bj, avg(h) AS m FROM elev GROUP BY 1, 2)
SELECT cid, round(h - m, 4) AS above FROM elev JOIN coarse ON i // 5 = bi AND j // 5 = bj""")
def j12_cross_resolution(spark, sf_dir):
    """Fine cells against the coarse cell they lie in."""
    c, _, _ = elev(spark, sf_dir)
    key = {"bi": F.floor(F.col("i") / 5), "bj": F.floor(F.col("j") / 5)}
    coarse = c.groupBy(*[v.alias(k) for k, v in key.items()]).agg(F.avg("h").alias("m"))
    return c.withColumns(key).join(coarse, ["bi", "bj"]).select("cid", F.round(F.col("h") - F.col("m"), 4).alias("above"))


@query(f"""WITH {SPHERE}, {OFF},
t AS (SELECT s.cid, o.k, tan(((s.i + o.di + 0.5::DOUBLE) / {N} - 0.5) * pi() / 2) AS p, tan(((s.j + o.dj + 0.5::DOUBLE) / {N} - 0.5) * pi() / 2) AS q, b.* EXCLUDE (face)
  FROM cells s CROSS JOIN off o JOIN bases b USING (face)),
l AS (SELECT cid, k, nx + p * rx + q * ux AS x, ny + p * ry + q * uy AS y, nz + p * rz + q * uz AS z FROM t),
v AS (SELECT cid, k, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM l),
a AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x >= 0 THEN 0 ELSE 1 END
  WHEN abs(y) >= abs(z) THEN CASE WHEN y >= 0 THEN 2 ELSE 3 END ELSE CASE WHEN z >= 0 THEN 4 ELSE 5 END END AS face FROM v),
u AS (SELECT cid, k, face, atan((x * rx + y * ry + z * rz) / (x * nx + y * ny + z * nz)) * (2 / pi()) + 0.5 AS a, atan((x * ux + y * uy + z * uz) / (x * nx + y * ny + z * nz)) * (2 / pi()) + 0.5 AS b FROM a JOIN bases USING (face))
SELECT cid, k, ((face * {N} + greatest(least(floor(a * {N}), {N - 1}), 0)) * {N} + greatest(least(floor(b * {N}), {N - 1}), 0))::BIGINT AS nid FROM u""")
def j13_cube_edges(spark, sf_dir):
    """Neighbours across cube edges; tests also hold them against a search on the sphere."""
    return grid.sphere_neighbours(grid.sphere_cells(spark, N), N)


@query(f"""WITH {ELEV}, {NBR} SELECT least(zone, nzone) AS low, greatest(zone, nzone) AS high, sum(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS weight
FROM nbr WHERE k < 4 AND zone <> nzone GROUP BY 1, 2""")
def j17_label_contacts(spark, sf_dir):
    from ..operators.joins import label_contacts

    return label_contacts(grid.edges(elev(spark, sf_dir)[0], ["zone"], own=["zone"]), "zone", "n_zone")


@query(f"""WITH {ELEV}, g AS (SELECT cid, i, j, h, lag(h) OVER (PARTITION BY j ORDER BY i) AS up, lead(h) OVER (PARTITION BY j ORDER BY i) AS dn,
  lag(h) OVER (PARTITION BY i ORDER BY j) AS lf, lead(h) OVER (PARTITION BY i ORDER BY j) AS rt FROM elev)
SELECT cid, round((coalesce(dn, h) - coalesce(up, h)) / 2, 6) AS gi, round((coalesce(rt, h) - coalesce(lf, h)) / 2, 6) AS gj,
round(sqrt(((coalesce(dn, h) - coalesce(up, h)) / 2) ** 2 + ((coalesce(rt, h) - coalesce(lf, h)) / 2) ** 2), 4) AS slope FROM g""")
def r1_gradient(spark, sf_dir):
    wide = grid.stencil(elev(spark, sf_dir)[0], ["h"], keep=["cid"])
    at = lambda k: F.coalesce(F.col(f"h_{k}"), F.col("h"))
    gi, gj = (at(0) - at(4)) / 2, (at(2) - at(6)) / 2
    return wide.select("cid", r6(gi, "gi"), r6(gj, "gj"), F.round(F.sqrt(gi * gi + gj * gj), 4).alias("slope"))


@query(f"""WITH {ELEV}, a AS (SELECT cid, i, j, 0.25 * coalesce(lag(h) OVER (PARTITION BY j ORDER BY i), h) + 0.5 * h + 0.25 * coalesce(lead(h) OVER (PARTITION BY j ORDER BY i), h) AS h FROM elev),
b AS (SELECT cid, i, j, 0.25 * coalesce(lag(h) OVER (PARTITION BY i ORDER BY j), h) + 0.5 * h + 0.25 * coalesce(lead(h) OVER (PARTITION BY i ORDER BY j), h) AS h FROM a)
SELECT cid, round(h + 0.000001, 4) AS h FROM b""")
def r2_smooth(spark, sf_dir):
    from ..operators.raster import smooth

    out = smooth(elev(spark, sf_dir)[0].select("cid", "i", "j", "h"), "h", 1)
    return out.select("cid", F.round(F.col("h") + 0.000001, 4).alias("h"))  # halves are common here: round them one way


@query(f"""WITH {ELEV}, {OFF}, g(d, w) AS (SELECT d - 2, exp(-((d - 2) ** 2) / 2.0) FROM range(5) t(d)),
a AS (SELECT e.cid, e.i, e.j, sum(g.w * f.h) / sum(g.w) AS h FROM elev e, g JOIN elev f ON f.i = e.i + g.d AND f.j = e.j GROUP BY ALL),
b AS (SELECT e.cid, sum(g.w * f.h) / sum(g.w) AS h FROM a e, g JOIN a f ON f.j = e.j + g.d AND f.i = e.i GROUP BY ALL)
SELECT cid, round(h, 4) AS h FROM b""")
def r3_gaussian(spark, sf_dir):
    from ..operators.raster import gaussian

    return gaussian(elev(spark, sf_dir)[0].select("cid", "i", "j", "h"), "h", 1.0, 2).select("cid", F.round("h", 4).alias("h"))


@query(f"WITH {ELEV}, {NBR} SELECT cid, round(sum(nh - h), 4) AS lap FROM nbr WHERE k % 2 = 0 GROUP BY cid")
def r4_laplacian(spark, sf_dir):
    from ..operators.raster import laplacian

    return laplacian(elev(spark, sf_dir)[0], "h").select("cid", F.round("lap", 4).alias("lap"))


@query(f"""WITH {ELEV}, {NBR}, l1 AS (SELECT cid, any_value(i) AS i, any_value(j) AS j, any_value(h) + 0.2 * sum(nh - h) AS h FROM nbr WHERE k % 2 = 0 GROUP BY cid),
l2 AS (SELECT a.cid, any_value(a.h) + 0.2 * sum(b.h - a.h) AS h FROM l1 a CROSS JOIN off o JOIN l1 b ON b.i = a.i + o.di AND b.j = a.j + o.dj WHERE k % 2 = 0 GROUP BY a.cid)
SELECT cid, round(h, 4) AS h FROM l2""")
def r5_diffusion(spark, sf_dir):
    """Two explicit steps."""
    from ..operators.raster import diffuse

    return diffuse(elev(spark, sf_dir)[0].select("cid", "i", "j", "h"), "h", 0.2, 2).select("cid", F.round("h", 4).alias("h"))


@query(f"""WITH RECURSIVE {ELEV}, {OFF}, s AS (SELECT cid, i, j FROM elev WHERE h < 60000),
d AS (SELECT e.cid, min(3 * greatest(abs(e.i - s.i), abs(e.j - s.j)) + least(abs(e.i - s.i), abs(e.j - s.j))) AS d
  FROM elev e CROSS JOIN s GROUP BY e.cid)
SELECT e.cid, d.d::BIGINT AS d FROM elev e JOIN d USING (cid)""")
def r6_chamfer(spark, sf_dir):
    """3-4 chamfer distance to the sea, however far it is."""
    from ..operators.raster import chamfer

    out = chamfer(elev(spark, sf_dir)[0], F.col("h") < 60000)
    return out.select("cid", F.col("d").cast("long").alias("d"))


@query(f"""WITH {ELEV}, s AS (SELECT i, j FROM elev WHERE h > 300000)
SELECT DISTINCT e.cid FROM elev e JOIN s ON abs(e.i - s.i) <= 2 AND abs(e.j - s.j) <= 2""")
def r7_dilate(spark, sf_dir):
    from ..operators.raster import near

    return near(elev(spark, sf_dir)[0], F.col("h") > 300000, 2).select("cid")


@query(f"""WITH {ELEV}, {NBR}, f AS (SELECT cid, sum(CASE WHEN abs(nh - h) > 1000 * CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1 END
  THEN sign(nh - h) * 0.5 * (abs(nh - h) - 1000 * CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1 END) / 2 / 8 ELSE 0 END) AS f FROM nbr GROUP BY cid)
SELECT cid, round(h + f + 0.000001, 4) AS h FROM elev JOIN f USING (cid)""")
def r8_talus_cascade(spark, sf_dir):
    from ..operators.raster import cascade

    return cascade(elev(spark, sf_dir)[0], "h", 0.5, 1000.0).select("cid", F.round(F.col("h") + 0.000001, 4).alias("h"))


@query(f"""WITH {ELEV}, m AS (SELECT i // 2 AS bi, j // 2 AS bj, count(h) AS n, sum(h) AS s FROM elev GROUP BY 1, 2),
l AS (SELECT 1 AS lod, bi, bj, n, s FROM m UNION ALL SELECT 2, bi // 2, bj // 2, sum(n), sum(s) FROM m GROUP BY 2, 3 UNION ALL SELECT 3, bi // 4, bj // 4, sum(n), sum(s) FROM m GROUP BY 2, 3)
SELECT lod, bi, bj, n::BIGINT AS n, round(s / n + 0.000001, 4) AS mean FROM l""")
def r9_pyramid(spark, sf_dir):
    """Levels of detail, each from the one below."""
    from ..operators.aggregate import pyramid

    out = pyramid(elev(spark, sf_dir)[0], "h", 3)
    return out.select("lod", "bi", "bj", "n", F.round(F.col("mean") + 0.000001, 4).alias("mean"))


@query(f"""WITH {ELEV}, {NBR}, o AS (SELECT cid, k, nid, greatest(0, (h - nh) - 1000 * CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1 END) * 0.25 AS o FROM nbr),
s AS (SELECT cid, sum(o) AS total, max(o) AS most FROM o GROUP BY cid),
f AS (SELECT o.cid, nid, o * CASE WHEN total > 0 THEN least(1.0, 2 * most / total) ELSE 0 END AS f FROM o JOIN s USING (cid)),
d AS (SELECT cid, sum(x) AS dh FROM (SELECT cid, -f AS x FROM f UNION ALL SELECT nid, f FROM f) GROUP BY cid)
SELECT cid, round(h + dh, 4) AS h FROM elev JOIN d USING (cid)""")
def r10_thermal(spark, sf_dir):
    """Talus flow that conserves mass: donors scaled, receivers add."""
    from ..operators.raster import thermal

    return thermal(elev(spark, sf_dir)[0], "h", 0.5, 1000.0).select("cid", F.round("h", 4).alias("h"))


@query(f"""WITH {ELEV}, {NBR}, g AS (SELECT cid, any_value(h) AS h, greatest(0, any_value(h) - min(nh) FILTER (WHERE k IN (0, 4))) AS a, greatest(0, any_value(h) - min(nh) FILTER (WHERE k IN (2, 6))) AS b FROM nbr GROUP BY cid)
SELECT cid, round(sqrt(coalesce(a, 0) ** 2 + coalesce(b, 0) ** 2), 4) AS down FROM g""")
def r11_downhill_slope(spark, sf_dir):
    """One-sided slopes, the steeper of both ways on each axis."""
    wide = grid.stencil(elev(spark, sf_dir)[0], ["h"], keep=["cid"])
    one = lambda a, b: F.greatest(F.lit(0.0), F.col("h") - F.coalesce(F.least(f"h_{a}", f"h_{b}"), F.col("h")))
    a, b = one(0, 4), one(2, 6)
    return wide.select("cid", F.round(F.sqrt(a * a + b * b), 4).alias("down"))


@query(f"""WITH {ELEV}, {NBR}, m AS (SELECT cid, h > 100000 AS m FROM elev), k1 AS (SELECT n.cid FROM nbr n JOIN m a ON a.cid = n.cid JOIN m b ON b.cid = n.nid
  WHERE a.m GROUP BY n.cid HAVING count(*) FILTER (WHERE b.m) = 8),
k2 AS (SELECT n.cid FROM nbr n JOIN k1 a ON a.cid = n.cid LEFT JOIN k1 b ON b.cid = n.nid GROUP BY n.cid HAVING count(b.cid) = 8)
SELECT m.cid, 1 + (k1.cid IS NOT NULL)::INT + (k2.cid IS NOT NULL)::INT AS depth FROM m LEFT JOIN k1 USING (cid) LEFT JOIN k2 USING (cid) WHERE m.m""")
def r12_erosion_depth(spark, sf_dir):
    """How many peels (two at most) a cell of the mask outlasts, plus one."""
    from ..operators.raster import peel

    return peel(elev(spark, sf_dir)[0], F.col("h") > 100000, 2).select("cid", "depth")


@query(f"""WITH {ELEV}, {NBR} SELECT cid, k FROM (SELECT a.cid, o.k, (SELECT 1) AS one, b.h AS nh, a.h FROM elev a CROSS JOIN off o LEFT JOIN elev b ON b.i = a.i + o.di AND b.j = a.j + o.dj
WHERE o.k % 2 = 0 AND a.h > 250000) WHERE nh IS NULL OR nh <= 250000""")
def r14_boundary_edges(spark, sf_dir):
    """Directed edges of a mask's outline: a side of a cell with nothing of the mask beyond it."""
    c, _, _ = elev(spark, sf_dir)
    wide = grid.stencil(c, ["h"], keep=["cid"]).where("h > 250000")
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h_{k}").alias("nh")) for k in (0, 2, 4, 6)]))
    return wide.select("cid", side.alias("s")).where("s.nh is null or s.nh <= 250000").select("cid", "s.k")


@query(f"""WITH {ELEV}, g AS (SELECT cid, h, (coalesce(lead(h) OVER (PARTITION BY j ORDER BY i), h) - coalesce(lag(h) OVER (PARTITION BY j ORDER BY i), h)) / 2 AS gi,
  (coalesce(lead(h) OVER (PARTITION BY i ORDER BY j), h) - coalesce(lag(h) OVER (PARTITION BY i ORDER BY j), h)) / 2 AS gj FROM elev)
SELECT cid, round(greatest(0, (707106.7811865476::DOUBLE + (-gi + gj) * 0.5) / sqrt(1e12 + gi * gi + gj * gj)), 6) AS shade FROM g""")
def r15_hillshade(spark, sf_dir):
    """Lambert shading by a sun at 45 degrees in the north-west."""
    wide = grid.stencil(elev(spark, sf_dir)[0], ["h"], keep=["cid"])
    at = lambda k: F.coalesce(F.col(f"h_{k}"), F.col("h"))
    gi, gj = (at(0) - at(4)) / 2, (at(2) - at(6)) / 2
    lit = (707106.7811865476 + (-gi + gj) * 0.5) / F.sqrt(F.lit(1e12) + gi * gi + gj * gj)
    return wide.select("cid", r6(F.greatest(F.lit(0.0), lit), "shade"))


@query(f"""WITH {ELEV}, d AS (SELECT cid, least(i, j, hh - 1 - i, ww - 1 - j) + 1 AS d FROM elev, dim), t AS (SELECT cid, least(greatest((d - 1) / 4.0, 0.0), 1.0) AS t FROM d)
SELECT cid, round(t * t * (3 - 2 * t), 6) AS w FROM t""")
def r16_feather(spark, sf_dir):
    c, h, w = elev(spark, sf_dir)
    d = F.least(F.col("i"), F.col("j"), h - 1 - F.col("i"), w - 1 - F.col("j"))
    return c.select("cid", r6(rules.smoothstep(d / 4.0), "w"))


@query(f"""WITH {ELEV}, b AS (SELECT i // 5 AS bi, j // 5 AS bj, avg(h) - avg(rain) * 1000 AS d FROM elev GROUP BY 1, 2)
SELECT cid, round(h - d, 4) AS h FROM elev JOIN b ON bi = i // 5 AND bj = j // 5""")
def r17_remove_drift(spark, sf_dir):
    """One pass that takes off each block's mean offset from a coarse field."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).withColumns({"bi": F.floor(F.col("i") / 5), "bj": F.floor(F.col("j") / 5)})
    b = c.groupBy("bi", "bj").agg((F.avg("h") - F.avg("rain") * 1000).alias("d"))
    return c.join(b, ["bi", "bj"]).select("cid", F.round(F.col("h") - F.col("d"), 4).alias("h"))


@query(f"""WITH {ELEV}, {NBR} SELECT cid, round(greatest(max(nh), any_value(h)) - least(min(nh), any_value(h)), 6) AS relief FROM nbr GROUP BY cid""")
def r19_relief(spark, sf_dir):
    wide = grid.stencil(elev(spark, sf_dir)[0], ["h"], keep=["cid"])
    every = ["h", *[f"h_{k}" for k in range(8)]]
    return wide.select("cid", r6(F.greatest(*every) - F.least(*every), "relief"))


@query(f"""WITH {ELEV}, g AS (SELECT i // 10 AS bi, j // 10 AS bj, (coalesce(lead(h) OVER (PARTITION BY j ORDER BY i), h) - coalesce(lag(h) OVER (PARTITION BY j ORDER BY i), h)) / 200000 AS gi,
  (coalesce(lead(h) OVER (PARTITION BY i ORDER BY j), h) - coalesce(lag(h) OVER (PARTITION BY i ORDER BY j), h)) / 200000 AS gj FROM elev),
t AS (SELECT bi, bj, sum(gi * gi) AS a, sum(gi * gj) AS b, sum(gj * gj) AS c FROM g GROUP BY 1, 2)
SELECT bi, bj, round(sqrt((a - c) ** 2 + 4 * b * b) / (a + c), 6) AS coherence FROM t""")
def r20_structure_tensor(spark, sf_dir):
    wide = grid.stencil(elev(spark, sf_dir)[0], ["h"], keep=["cid"])
    at = lambda k: F.coalesce(F.col(f"h_{k}"), F.col("h"))
    gi, gj = (at(0) - at(4)) / 200000, (at(2) - at(6)) / 200000
    t = wide.groupBy(F.floor(F.col("i") / 10).alias("bi"), F.floor(F.col("j") / 10).alias("bj")).agg(
        F.sum(gi * gi).alias("a"), F.sum(gi * gj).alias("b"), F.sum(gj * gj).alias("c")
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return t.select("bi", "bj", r6(F.sqrt((a - c) * (a - c) + 4 * b * b) / (a + c), "coherence"))


@query(f"""WITH {SPHERE} SELECT count(*) AS pixels, count(DISTINCT cid) AS cells FROM (SELECT px, py, 1 AS one FROM range(64) a(px), range(32) b(py)) p,
LATERAL (SELECT cos((py + 0.5) / 32 * pi() - pi() / 2) * cos((px + 0.5) / 64 * 2 * pi()) AS a, cos((py + 0.5) / 32 * pi() - pi() / 2) * sin((px + 0.5) / 64 * 2 * pi()) AS b, sin((py + 0.5) / 32 * pi() - pi() / 2) AS c) v
JOIN sph ON abs(face - CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN CASE WHEN a >= 0 THEN 0 ELSE 1 END WHEN abs(b) >= abs(c) THEN CASE WHEN b >= 0 THEN 2 ELSE 3 END ELSE CASE WHEN c >= 0 THEN 4 ELSE 5 END END) = 0
AND i = least(floor((atan((a * rx + b * ry + c * rz) / (a * nx + b * ny + c * nz)) * 2 / pi() + 0.5) * {N}), {N - 1})
AND j = least(floor((atan((a * ux + b * uy + c * uz) / (a * nx + b * ny + c * nz)) * 2 / pi() + 0.5) * {N}), {N - 1})""")
def r21_equirectangular(spark, sf_dir):
    """The sphere's cells under the pixels of an equirectangular map."""
    px = spark.range(64 * 32)
    lat = (F.floor(F.col("id") / 64) + 0.5) / 32 * math.pi - math.pi / 2
    lon = (F.col("id") % 64 + 0.5) / 64 * 2 * math.pi
    p = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    face = geo.face_of(p)
    u, v = geo.project_to_face(face, p)
    px = px.select(face.alias("face"), geo.cell_of(u, N).alias("i"), geo.cell_of(v, N).alias("j"))
    met = px.join(grid.sphere_cells(spark, N), ["face", "i", "j"])
    return met.agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("cid").alias("cells"))


@query(f"""WITH {ELEV} SELECT zone, count(*) AS n, round(avg(h), 4) AS mean, max(h) AS top FROM elev WHERE i BETWEEN 5 AND 20 AND j BETWEEN 5 AND 20 GROUP BY zone""")
def f5_window_scan(spark, sf_dir):
    """A window is a range predicate on the keys (abstraction of S12)."""
    c = elev(spark, sf_dir)[0].where(F.col("i").between(5, 20) & F.col("j").between(5, 20))
    return c.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 4).alias("mean"), F.max("h").alias("top"))

