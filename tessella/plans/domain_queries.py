"""Queries of noise, ice, point choices, windowed jobs and terrain metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import noise
from ..operators import aggregate, basins, grid, ice, jobs, joins, raster, selection
from ..operators.graph import settled
from ..sources import images
from .registry import CLOUD, ELEV, ELEVN, NBR, NBRN, OFF, cloud, elev, query, r6, with_rain

# --- noise ---------------------------------------------------------------------------------------


def _noise_sql(x: str, y: str, wave: float, seed: int) -> str:
    node = lambda p, q: f"(('0x' || substr(md5('{seed}:' || (floor({x} / {wave})::BIGINT + {p}) || ':' || (floor({y} / {wave})::BIGINT + {q})), 1, 8))::UINTEGER / 4294967296.0::DOUBLE)"
    part = lambda c: f"({c} / {wave}::DOUBLE - floor({c} / {wave}::DOUBLE))"
    s, t = (f"({p} * {p} * (3 - 2 * {p}))" for p in (part(x), part(y)))
    terms = [f"{node(p, q)} * {s if p else f'(1 - {s})'} * {t if q else f'(1 - {t})'}" for p in (0, 1) for q in (0, 1)]
    return f"(({' + '.join(terms)}) * 2 - 1)"


def _fbm_sql(wave: float, seed: int, ridged: bool = False) -> str:
    all_ = noise.octaves(wave, 2.0, 0.5)
    terms = [f"{w} * " + (f"(1 - abs({n})) ** 2" if ridged else n) for n, w in ((_noise_sql("i", "j", a, seed + k), w) for k, (a, w) in enumerate(all_))]
    return f"(({' + '.join(terms)}) / {sum(w for _, w in all_)}::DOUBLE)"


@query(f"WITH {ELEV} SELECT cid, round({_noise_sql('i', 'j', 6.0, 11)}, 6) AS noise, round({_fbm_sql(16.0, 20)}, 6) AS fbm FROM elev")
def n3_value_noise(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    return elev(spark, sf_dir)[0].select("cid", r6(noise.value_noise(i, j, 6.0, 11), "noise"), r6(noise.fbm(i, j, 16.0, 20), "fbm"))


@query(f"""WITH {ELEV}, v AS (SELECT cid, {_fbm_sql(16.0, 30, True)} AS v FROM elev), s AS (SELECT avg(v) AS m, max(v) AS hi, min(v) AS lo FROM v)
SELECT cid, round((v - m) / greatest(hi - m, m - lo), 6) AS detail FROM v, s""")
def n4_ridged_detail(spark, sf_dir):
    c = elev(spark, sf_dir)[0].select("cid", noise.fbm(F.col("i"), F.col("j"), 16.0, 30, ridged=True).alias("detail"))
    return noise.normalised(c, "detail").select("cid", r6(F.col("detail"), "detail"))


@query(f"""WITH {CLOUD}, p AS (SELECT a.vec_id, b.label, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM cloud a JOIN cloud b
  ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.09)
SELECT vec_id, round(sum((label + 1) * exp(-(dx * dx + dy * dy + dz * dz) / (2 * 0.01::DOUBLE)) * cos(2 * pi() * 8.0::DOUBLE * dz)), 5) AS ridge FROM p GROUP BY vec_id""")
def n5_oriented_noise(spark, sf_dir):
    """Oriented kernels within a radius, summed: an equi-join on cells and one aggregation."""
    c = cloud(spark, sf_dir)
    a = c.select("vec_id", *[F.col(k).alias(f"a{k}") for k in "xyz"])
    b = c.select("label", *[F.col(k).alias(f"b{k}") for k in "xyz"])
    met = joins.within(a, b, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.3)
    kernel = noise.gabor(F.sqrt("d2"), F.col("bz") - F.col("az"), (F.col("label") + 1).cast("double"), 8.0, 0.1)
    return met.groupBy("vec_id").agg(F.round(F.sum(kernel), 5).alias("ridge"))


@query(f"""WITH {ELEV}, moved AS (SELECT cid, i + 3.0::DOUBLE * {_noise_sql('i', 'j', 8.0, 41)} AS a, j + 3.0::DOUBLE * {_noise_sql('i', 'j', 8.0, 42)} AS b FROM elev)
SELECT cid, round(a, 6) AS i, round(b, 6) AS j FROM moved""")
def n6_warped_cells(spark, sf_dir):
    a, b = noise.warped(F.col("i"), F.col("j"), 3.0, 8.0, 41)
    return elev(spark, sf_dir)[0].select("cid", r6(a, "i"), r6(b, "j"))


# --- points --------------------------------------------------------------------------------------


@query(f"""WITH {ELEV}, l AS (SELECT i, j, cid FROM elev WHERE h > 300000), m AS (SELECT e.i, e.j, min_by(l.cid, {{'d': (e.i - l.i) ** 2 + (e.j - l.j) ** 2, 'c': l.cid}}) AS label
  FROM elev e JOIN l ON l.i BETWEEN e.i - 4 AND e.i + 4 AND l.j BETWEEN e.j - 4 AND e.j + 4 AND (e.i - l.i) ** 2 + (e.j - l.j) ** 2 <= 16 GROUP BY ALL),
n AS (SELECT i, label, count(*) AS n FROM m GROUP BY ALL)
SELECT i, min_by(label, {{'n': -n, 'l': label}}) AS label, max(n)::BIGINT AS n FROM n GROUP BY i""")
def j16_nearest_label(spark, sf_dir):
    """The label nearest to each cell, and the commonest along each row of cells."""
    c = elev(spark, sf_dir)[0]
    near = joins.nearest_label(c, c.where("h > 300000").select("i", "j", F.col("cid").alias("label")), "label", 4)
    counts = near.groupBy("i", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("i", (-F.col("b.l")).alias("label"), F.col("b.n").alias("n"))


def _pairs(spark, sf_dir, radius: float):
    c = cloud(spark, sf_dir)
    a = c.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), *[F.col(k).alias(f"a{k}") for k in "xyz"])
    b = c.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    return joins.within(a, b, ["ax", "ay", "az"], ["bx", "by", "bz"], radius).where("a <> b")


D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"


@query(f"WITH {CLOUD} SELECT a.vec_id AS a, count(*) AS wide, count(*) FILTER ({D2} <= 0.01) AS narrow FROM cloud a JOIN cloud b ON a.vec_id <> b.vec_id AND {D2} <= 0.04 GROUP BY ALL")
def j19_pairs_used_again(spark, sf_dir):
    """Pairs made once for the wider radius serve the narrower one too."""
    wide = settled(_pairs(spark, sf_dir, 0.2).select("a", "b", "d2"))
    few = joins.narrowed(wide, 0.2, 0.1).groupBy("a").agg(F.count(F.lit(1)).alias("narrow"))
    return wide.groupBy("a").agg(F.count(F.lit(1)).alias("wide")).join(few, "a", "left").select("a", "wide", F.coalesce("narrow", F.lit(0)).cast("long").alias("narrow"))


SLOTS = f"""{CLOUD}, r AS (SELECT a.label AS owner, b.vec_id AS slot, b.label AS pb, b.label >= 4 AS floor_, {D2} AS d2,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS r FROM cloud a JOIN cloud b ON a.label < 4 AND a.vec_id <> b.vec_id AND {D2} <= 0.25),
s AS (SELECT slot, owner, bool_or(pb = owner) AS own, min(d2) AS d2 FROM r WHERE r <= 6 AND floor_ GROUP BY ALL)"""


@query(f"""WITH {SLOTS}, w AS (SELECT slot, owner, own, sum(1 + slot % 3) OVER (PARTITION BY owner ORDER BY round(d2, 9), slot) AS run FROM s)
SELECT slot, owner, own FROM w WHERE run <= 40""")
def k7_border_slots(spark, sf_dir):
    """Floor beside land, by plate, nearest first, as far as each plate's budget goes."""
    s = selection.border_slots(cloud(spark, sf_dir), "vec_id", ["x", "y", "z"], "label", F.col("label") < 4, 0.5, 6)
    s = s.withColumns({"cost": 1 + F.col("slot") % 3, "budget": F.lit(40), "near": F.round("d2", 9)})
    return selection.within_budget(s, ["owner"], ["near", "slot"], "cost", "budget").select("slot", "owner", "own")


@query(f"""WITH RECURSIVE {CLOUD}, o AS (SELECT vec_id, x, y, z, row_number() OVER (ORDER BY vec_id) AS r FROM cloud),
w(r, kept) AS (SELECT 0::BIGINT, []::STRUCT(v BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]
  UNION ALL SELECT o.r, CASE WHEN len(list_filter(w.kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 + (k.z - o.z) ** 2 <= 0.2::DOUBLE * 0.2::DOUBLE)) = 0
    THEN list_append(w.kept, {{'v': o.vec_id, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE w.kept END FROM w JOIN o ON o.r = w.r + 1)
SELECT unnest(kept).v AS vec_id FROM w WHERE r = (SELECT max(r) FROM o)""")
def k6_greedy_accept(spark, sf_dir):
    """Points accepted in order of id at a least distance; tests also hold it against the sequential walk."""
    return selection.greedy_accept(cloud(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.2)


@query(None)
def k5_spread_sample(spark, sf_dir):
    return selection.spread_sample(spark, 400, 8, 5).select("id", *[r6(F.col(c), c) for c in "xyz"])


@query(f"""WITH {CLOUD}, d AS (SELECT a.vec_id, min({D2}) AS d2 FROM cloud a JOIN cloud b ON a.label >= 4 AND b.label < 2 AND {D2} <= 0.25 GROUP BY a.vec_id)
SELECT vec_id, CASE WHEN label < 4 THEN 0.0::DOUBLE ELSE round(coalesce(sqrt(d2) / 0.005::DOUBLE, 100.0::DOUBLE), 6) END AS age FROM cloud LEFT JOIN d USING (vec_id)""")
def c2_age_from_ridges(spark, sf_dir):
    """The floor's age by its distance to the nearest ridge, at most 100 steps; land has 0. Beyond 100
    steps' way no ridge matters, so that the search is an equi-join of that radius."""
    c = cloud(spark, sf_dir)
    a = c.where("label >= 4").select("vec_id", *[F.col(k).alias(f"a{k}") for k in "xyz"])
    b = c.where("label < 2").select(*[F.col(k).alias(f"b{k}") for k in "xyz"])
    d = joins.within(a, b, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.5).groupBy("vec_id").agg(F.min("d2").alias("d2"))
    age = F.when(F.col("label") < 4, 0.0).otherwise(F.coalesce(F.sqrt("d2") / 0.005, F.lit(100.0)))
    return c.select("vec_id", "label").join(d, "vec_id", "left").select("vec_id", r6(age, "age"))


@query(f"""WITH {CLOUD}, c AS (SELECT a.label, a.x, a.y, a.z, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt({D2}) AS d, least((a.vec_id % 10) / 5.0::DOUBLE, 1.0) AS g
  FROM cloud a JOIN cloud b ON a.label > b.label AND {D2} <= 0.04),
f AS (SELECT *, g * (0.3 + 0.7 * sqrt(g)) * 0.1::DOUBLE / d AS m FROM c WHERE g > 0 AND d > 0)
SELECT label, count(*) AS contacts, round(sum(m * (y * dz - z * dy)), 6) AS tx, round(sum(m * (z * dx - x * dz)), 6) AS ty, round(sum(m * (x * dy - y * dx)), 6) AS tz FROM f GROUP BY label""")
def m8_slab_torques(spark, sf_dir):
    """Pull of down-going contacts toward the plate above, as torques summed by plate."""
    p = _pairs(spark, sf_dir, 0.2).where("la > lb and d2 > 0").withColumn("g", F.least(F.col("a") % 10 / 5.0, F.lit(1.0))).where("g > 0")
    m = F.col("g") * (0.3 + 0.7 * F.sqrt("g")) * 0.1 / F.sqrt("d2")
    tq = geo.cross([F.col(f"a{k}") for k in "xyz"], [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"])
    out = p.select(F.col("la").alias("label"), *[(m * t).alias(n) for t, n in zip(tq, ("tx", "ty", "tz"))])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("contacts"), *[r6(F.sum(n), n) for n in ("tx", "ty", "tz")])


# --- grids ---------------------------------------------------------------------------------------


@query(f"""WITH {ELEV}, {NBR}, s AS (SELECT i, j FROM elev WHERE rain > 230), o AS (SELECT a.v AS di, b.v AS dj FROM range(-3, 4) a(v), range(-3, 4) b(v)),
b AS (SELECT i + di AS i, j + dj AS j, sum(0.8 * exp(-(di * di + dj * dj) / (2 * 1.5::DOUBLE * 1.5))) AS x FROM s, o GROUP BY ALL),
t AS (SELECT e.cid, coalesce(b.x, 0.0) AS x FROM elev e LEFT JOIN b USING (i, j))
SELECT t.cid, round(least(greatest(t.x + 0.2::DOUBLE * coalesce(sum(u.x - t.x), 0), 0.0), 1.0), 6) AS heat
FROM t LEFT JOIN nbr n ON n.cid = t.cid AND n.k % 2 = 0 LEFT JOIN t u ON u.cid = n.nid GROUP BY t.cid, t.x""")
def i12_heat_step(spark, sf_dir):
    """Blobs of heat at sources, one step of diffusion, kept between 0 and 1."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    o = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    to = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(a * a + b * b).alias("d2")) for a, b in o]))
    blob = c.where("rain > 230").select(to.alias("t")).groupBy("t.i", "t.j").agg(F.sum(0.8 * F.exp(-F.col("t.d2") / (2 * 1.5 * 1.5))).alias("b"))
    hot = c.join(blob, ["i", "j"], "left").select("cid", "i", "j", F.coalesce("b", F.lit(0.0)).alias("heat"))
    out = raster.diffuse(hot, "heat", 0.2, 1)
    return out.select("cid", r6(F.least(F.greatest("heat", F.lit(0.0)), F.lit(1.0)), "heat"))


@query(f"""WITH {ELEV}, {NBR}, f AS (SELECT cid, count(*) FILTER (nh > 200000) AS icy, count(*) AS near FROM nbr GROUP BY cid),
c AS (SELECT e.cid, e.h > 200000 AS ice, e.h <= 200000 AND coalesce(icy, 0) > 0 AS margin, rain AS q, (cid % 10) / 10.0::DOUBLE AS hardness, CASE WHEN icy = 8 THEN 1.0 ELSE 0.5 END AS taper FROM elev e LEFT JOIN f USING (cid)),
d AS (SELECT cid, CASE WHEN ice THEN least(3.0 * sqrt(greatest(q, 0.0) / 50.0::DOUBLE) * (1 - 0.5 * hardness) * taper, 5.0) ELSE 0.0 END AS cut, CASE WHEN margin THEN greatest(q, 0.0) + 1e-6 ELSE 0.0 END AS w FROM c),
s AS (SELECT sum(cut) AS cut_, sum(w) AS all_ FROM d), p AS (SELECT cid, cut, CASE WHEN all_ > 0 THEN w / all_ * cut_ * 0.6 ELSE 0.0 END AS share FROM d, s)
SELECT cid, round(cut, 6) AS cut, round(least(share, 2.0), 6) AS placed, round(share - least(share, 2.0), 6) AS pending FROM p""")
def i9_carve(spark, sf_dir):
    """One glacial cycle: beds cut, spoil on the margin, what it cannot take pending."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).withColumn("ice", (F.col("h") > 200000).cast("int"))
    wide = grid.stencil(c, ["ice"], keep=["cid", "rain"])
    icy = sum(F.coalesce(F.col(f"ice_{k}"), F.lit(0)) for k in range(8))
    cells = wide.select(
        "cid", (F.col("ice") == 1).alias("ice"), ((F.col("ice") == 0) & (icy > 0)).alias("margin"), F.col("rain").alias("q"),
        (F.col("cid") % 10 / 10.0).alias("hardness"), F.when(icy == 8, 1.0).otherwise(0.5).alias("taper"),
    )
    out = ice.carve(cells, 3.0, 5.0, 50.0, 0.6, 2.0)
    return out.select("cid", *[r6(F.col(k), k) for k in ("cut", "placed", "pending")])


@query(None)
def g18_ice_routing(spark, sf_dir):
    """A balance summed down all slopes; tests hold it against a walk from the highest cell down."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    out = ice.spread(c.select("cid", "i", "j", F.col("h").alias("z"), (F.col("rain") - 60).alias("w"), (F.col("h") > 100000).alias("ice")))
    return out.select("cid", r6(F.col("acc"), "acc"))


WINDOWS = f"""{ELEV}, t AS (SELECT range AS t FROM range(60)),
x AS (SELECT e.cid, e.i, e.j, sqrt(e.h) AS h, a.t AS ti, b.t AS tj, least(e.i - a.t * 15 + 1, 20 - e.i + a.t * 15, e.j - b.t * 15 + 1, 20 - e.j + b.t * 15) AS edge
  FROM elev e JOIN t a ON e.i >= a.t * 15 AND e.i < a.t * 15 + 20 JOIN t b ON e.j >= b.t * 15 AND e.j < b.t * 15 + 20)"""


@query(f"""WITH {WINDOWS}, m AS (SELECT ti, tj, avg(h) AS m FROM x GROUP BY ALL), f AS (SELECT *, least(edge / 6.0::DOUBLE, 1.0) AS f FROM x JOIN m USING (ti, tj))
SELECT i, j, round(sum(f * f * (3 - 2 * f) * (h - m)) / sum(f * f * (3 - 2 * f)), 6) AS h FROM f GROUP BY i, j""")
def i14_windowed_jobs(spark, sf_dir):
    """A job in every overlapping window (its own mean of root heights taken off: heights in cents would
    round at ties), cross-faded where windows overlap."""
    def job(rows):
        w = Window.partitionBy("ti", "tj")
        return rows.withColumn("h", F.col("h") - F.avg("h").over(w))

    out = jobs.run_windows(elev(spark, sf_dir)[0].select("i", "j", F.sqrt("h").alias("h")), 20, 15, 5, "h", job)
    return out.select("i", "j", r6(F.col("h"), "h"))


@query(f"WITH {WINDOWS} SELECT ((ti % 2) * 2 + tj % 2)::BIGINT AS pass, count(DISTINCT (ti, tj)) AS tiles, count(*) AS cells FROM x GROUP BY ALL")
def i15_tile_passes(spark, sf_dir):
    """Windows by colour: those of one pass do not overlap."""
    x = jobs.windows(elev(spark, sf_dir)[0].select("i", "j"), 20, 15).withColumn("pass", jobs.colour(F.col("ti"), F.col("tj")))
    tiles = x.groupBy("pass", "ti", "tj").agg(F.count(F.lit(1)).alias("n"))
    return tiles.groupBy("pass").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("cells"))


@query(f"""WITH {ELEV} SELECT i // 10 AS ti, j // 10 AS tj, count(*) AS cells FROM elev GROUP BY ALL HAVING count(*) FILTER (rain > 0 OR i >= 20) < count(*)""")
def i16_pending_tiles(spark, sf_dir):
    """Tiles that a restart has still to do: not all of their cells are written."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).select(F.floor(F.col("i") / 10).alias("ti"), F.floor(F.col("j") / 10).alias("tj"), "i", "rain")
    every = c.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("cells"))
    return jobs.pending(every, c.where("rain > 0 or i >= 20"), ["ti", "tj"], "cells")


RELIEF = f"""{ELEV}, a AS (SELECT i, j, max(h) OVER w AS hi, min(h) OVER w AS lo FROM elev WINDOW w AS (PARTITION BY i ORDER BY j RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r AS (SELECT max(hi) OVER w - min(lo) OVER w AS relief FROM a WINDOW w AS (PARTITION BY j ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query(f"WITH {RELIEF} SELECT round(quantile_cont(relief, 0.5), 4) AS p50, round(quantile_cont(relief, 0.9), 4) AS p90 FROM r")
def q12_local_relief(spark, sf_dir):
    """Percentiles of the local relief, interpolated between two exact order statistics."""
    c = elev(spark, sf_dir)[0].select("i", "j", "h")
    r = settled(grid.focal(c, "h", 2, "max", "hi").join(grid.focal(c, "h", 2, "min", "lo"), ["i", "j"]).select((F.col("hi") - F.col("lo")).alias("relief")))
    return aggregate.interpolated_quantile(r, "relief", 0.5, "p50").crossJoin(aggregate.interpolated_quantile(r, "relief", 0.9, "p90")).select(F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, m AS MATERIALIZED (SELECT (cid + 0)::BIGINT AS cid, (i = 0 OR j = 0) AS way_out FROM elev WHERE rain > 150), e AS MATERIALIZED (SELECT (n.cid + 0)::BIGINT AS a, (n.nid + 0)::BIGINT AS b FROM nbr n WHERE rain > 150 AND nrain > 150),
r(a, b) AS (SELECT cid, cid FROM m UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS cid, min(b) AS label FROM r GROUP BY a), o AS (SELECT DISTINCT label FROM c JOIN m USING (cid) WHERE way_out)
SELECT (SELECT count(*) FROM c) AS channel_cells, (SELECT count(DISTINCT label) FROM c) AS components, round((SELECT count(*) FROM c JOIN o USING (label)) / (SELECT count(*) FROM c)::DOUBLE, 6) AS connected""")
def q12_channel_metrics(spark, sf_dir):
    """Channels above a threshold: their components, and the share that is connected to an outlet."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    lab = raster.mask_components(c, F.col("rain") > 150).join(c.select("cid", ((F.col("i") == 0) | (F.col("j") == 0)).alias("out")), "cid")
    per = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("out"))
    share = F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / F.sum("n")
    return per.agg(F.sum("n").alias("channel_cells"), F.count(F.lit(1)).alias("components"), r6(share, "connected"))


# --- basins, lines and images --------------------------------------------------------------------


def _links(spark, sf_dir):
    c = elev(spark, sf_dir)[0]
    return c, settled(grid.steepest(c).select("cid", "i", "j", "down"))


@query(None)
def g9_partition(spark, sf_dir):
    """Basins split at 40 cells, then those under 6 merged over their longest borders; tests hold both steps
    against walks of the tree."""
    c, links = _links(spark, sf_dir)
    split = settled(basins.split_oversize(links, 40))
    out = split.where("cid = basin").join(links.select("cid", "down"), "cid").select(F.col("basin"), F.col("down").alias("cid"))
    drains = out.join(split.withColumnRenamed("basin", "into"), "cid").select("basin", "into")
    return basins.merge_undersize(split.join(c.select("cid", "i", "j"), "cid"), drains, 6, 40).groupBy("basin").agg(F.count(F.lit(1)).alias("cells"))


@query(None)
def g14_flood_with_slope(spark, sf_dir):
    c, height, width = elev(spark, sf_dir)
    border = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == height - 1) | (F.col("j") == width - 1)
    return basins.flood_with_slope(c.withColumn("seed", border), 0.01, 64)


@query(None)
def r13_thin(spark, sf_dir):
    c = elev(spark, sf_dir)[0]
    wide = grid.focal(c, "h", 2, "avg", "m")
    return raster.thin(c.join(wide, ["i", "j"]), F.col("m") > 150000).select("cid")


@query(f"""WITH {ELEV}, {OFF}, m AS (SELECT i, j FROM elev WHERE h > 150000),
s AS (SELECT count(*) AS sides FROM m CROSS JOIN off o LEFT JOIN m n ON n.i = m.i + o.di AND n.j = m.j + o.dj WHERE k % 2 = 0 AND n.i IS NULL)
SELECT (SELECT sides FROM s)::BIGINT AS sides, (SELECT count(*) FROM m)::DOUBLE AS area""")
def r14_ring_totals(spark, sf_dir):
    """All rings of a mask: their edges are the mask's open sides, their signed areas sum to its cells."""
    per = raster.ring_areas(raster.rings(elev(spark, sf_dir)[0], F.col("h") > 150000))
    return per.agg(F.sum("sides").alias("sides"), F.sum("area").cast("double").alias("area"))


@query(f"WITH {ELEV} SELECT cid, (rain * 100)::INT AS value FROM elev")
def s8_image_round_trip(spark, sf_dir):
    """Tiles of 25 x 25 cells to 16-bit images and back."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    wide = c.agg((F.max("j") + 1).alias("w")).first()["w"]
    tiles = c.select(F.floor(F.col("i") / 25).alias("ti"), F.floor(F.col("j") / 25).alias("tj"), "i", "j", (F.col("rain") * 100).alias("v"))
    back = images.from_images(images.to_images(tiles, ["ti", "tj"], "v"), ["ti", "tj"])
    cid = (F.col("ti") * 25 + F.col("i")) * wide + F.col("tj") * 25 + F.col("j")
    return back.select(cid.alias("cid"), "value").join(c.select("cid"), "cid", "left_semi")
