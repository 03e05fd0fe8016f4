"""Queries of ordered floods, spectra, units, catalogues, job tables and fixture stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import jobs, raster, tileflood
from .analysis_queries import COMP, _scratch
from .registry import ELEV, elev, query, r6, table, with_rain
from .relation_queries import LAT, _lat

TILE = 50


@query(None)
def w2_flood_order(spark, sf_dir):
    """The order in which a flood of each tile reaches its cells (K1: heap keys with ties by sequence), and the
    tree it leaves (G12: receivers as D8 codes, weights down the codes)."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    return tileflood.tile_floods(c, TILE, weight="rain").select("cid", "rank", "receiver", "code", F.round("acc", 4).alias("acc"))


@query(None)
def g19_tile_water(spark, sf_dir):
    """Water that stands in each tile, draining to its border and to the sea below a height."""
    c = elev(spark, sf_dir)[0]
    return tileflood.tile_floods(c, TILE, F.col("h") < 20000).select("cid", "level", "depth", F.col("acc").cast("long").alias("cells"))


@query(None)
def q5_spectral_slope(spark, sf_dir):
    """Slopes of the radial power spectrum of full tiles."""
    return tileflood.spectral_slopes(elev(spark, sf_dir)[0], 25, 20.0, (60.0, 600.0))


@query(f"""WITH {ELEV}, m AS (SELECT avg(rain) AS m, count(*) AS n FROM elev)
SELECT (count(*) * 20.0 / 1000)::DOUBLE AS length_km, round(count(*) * 20.0 / 1000 / (max(n) * 400.0 / 1e6), 6) AS density FROM elev, m WHERE rain > 2 * m""")
def q5_drainage_density(spark, sf_dir):
    """Channels, cells with over twice the mean discharge, as km and km per km2, on cells of 20 m."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    both = c.crossJoin(F.broadcast(c.agg(F.avg("rain").alias("m"))))  # one row
    length = F.sum(F.when(F.col("rain") > 2 * F.col("m"), 20.0).otherwise(0.0)) / 1000
    return both.agg(length.alias("length_km"), r6(length / (F.count(F.lit(1)) * 400.0 / 1e6), "density"))


@query(f"""WITH {ELEV}, b AS (SELECT i // 5 AS bi, j // 5 AS bj, rain, cid, i, j FROM elev WHERE h > 50000)
SELECT bi, bj, arg_max(cid, {{'r': rain, 'i': -i, 'j': -j}}) AS cid, max(rain)::DOUBLE AS rain FROM b GROUP BY 1, 2""")
def g17_block_picks(spark, sf_dir):
    """The land cell with the most water of each block of 5 x 5, the first in row order of equals."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).where("h > 50000")
    best = F.struct("rain", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
    blocks = c.groupBy(F.floor(F.col("i") / 5).alias("bi"), F.floor(F.col("j") / 5).alias("bj"))
    return blocks.agg(F.max_by("cid", best).alias("cid"), F.max("rain").cast("double").alias("rain"))


@query("""SELECT o_orderkey AS id, round(o_totalprice / 1000 / 6371.0, 9) AS radians, round(o_totalprice / 100000 * 10.0 * 0.5 / 6371.0, 9) AS rate,
round(o_totalprice / 1000 / 0.5, 6) AS steps, round(o_totalprice / 20000.0, 8) AS cells FROM orders""")
def x15_units(spark, sf_dir):
    """Kilometres, cm a year, millions of years and metres in a simulation's own units."""
    x = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.round(rules.kilometres(x / 1000, 6371.0), 9).alias("radians"),
        F.round(rules.centimetres_a_year(x / 100000, 6371.0, 0.5), 9).alias("rate"),
        r6(rules.steps_of(x / 1000, 0.5), "steps"),
        F.round(rules.cell_units(x / 200, 100.0), 8).alias("cells"),
    )


@query(f"""WITH {ELEV}, l AS (SELECT cid, 28 - 50 * power(abs({LAT}) / (pi() / 2), 1.5) - 6.5 * h / 100000 AS t, least(90 * power(rain / 100, 1.2), 400) AS p,
  greatest((h % 400) / 10, 0.5) AS s, CASE WHEN cid % 7 = 0 THEN NULL ELSE (h % 100) / 100 END AS summer FROM elev, dim),
yr AS (SELECT *, t + s / 2 AS warm, acos(least(greatest((10 - t) * 2 / s, -1.0), 1.0)) / pi() AS over FROM l),
x AS (SELECT CASE WHEN warm < 0 THEN 1 WHEN warm < 10 THEN 2 WHEN over < 1.0 / 3 AND p < 20 THEN 2 WHEN over < 1.0 / 3 THEN 3
  WHEN t < 20 AND p < 25 THEN 7 WHEN t < 20 AND coalesce(summer < 1.0 / 3, false) AND p < 100 AND t >= 10 THEN 8 WHEN t < 20 AND p < 60 AND (t < 13 OR s > 25) THEN 4
  WHEN t < 20 AND p < 60 THEN 8 WHEN t < 20 AND p < 180 THEN 5 WHEN t < 20 THEN 6 WHEN p < 30 THEN 7 WHEN p < 100 THEN 9
  WHEN p < 220 OR coalesce(summer > 0.75 OR summer < 0.25, false) THEN 10 ELSE 11 END AS biome FROM yr)
SELECT biome, count(*) AS n FROM x GROUP BY 1""")
def x5_seasonal_biomes(spark, sf_dir):
    """Climate classes with the year's swing and, where it is known, the summer's share of the rain."""
    c, h, _ = elev(spark, sf_dir)
    c = with_rain(spark, sf_dir, c)
    t = rules.temperature(F.col("h") / 100, _lat(h))
    p = rules.precip_cm(F.col("rain") / 100)
    summer = F.when(F.col("cid") % 7 != 0, (F.col("h") % 100) / 100)
    return c.groupBy(rules.seasonal_biome(t, p, (F.col("h") % 400) / 10, summer).alias("biome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELEV} SELECT i // {TILE} AS ti, j // {TILE} AS tj, count(*) AS cells, min(h) AS low, max(h) AS high FROM elev GROUP BY 1, 2")
def s20_tile_index(spark, sf_dir):
    """A catalogue of the tiles that a store holds, read from what was written (S19: a level saved and read)."""
    store = _scratch(spark)
    c = elev(spark, sf_dir)[0]
    tile = lambda x: F.floor(F.col(x) / TILE)
    store.save("level", c.select("cid", "h", tile("i").alias("ti"), tile("j").alias("tj")), ["ti", "tj"])
    held = store.load("level").groupBy(F.col("ti").cast("long").alias("ti"), F.col("tj").cast("long").alias("tj"))
    return held.agg(F.count(F.lit(1)).alias("cells"), F.min("h").alias("low"), F.max("h").alias("high"))


@query("SELECT cid, h FROM (SELECT o_orderkey AS cid, o_totalprice AS h FROM orders)")
def s19_saved_level(spark, sf_dir):
    store = _scratch(spark)
    store.save("level", elev(spark, sf_dir)[0].select("cid", "h"))
    return store.load("level", ["cid", "h"])


@query("""WITH live AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0 AND value > 50),
n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 5 <> 0)
SELECT event_id, event_type AS kind, user_id AS world FROM n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.user_id = n.user_id AND l.event_type = n.event_type)""")
def v3_job_queue(spark, sf_dir):
    """Jobs asked for, one of a kind and world at a time: every fifth event is a job there is already."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("world"), F.lit(None).cast("string").alias("title"), "value")
    there = e.where("event_id % 5 = 0").withColumns({"state": F.when(F.col("value") > 50, "running").otherwise("done"), "title": F.col("kind")})
    return jobs.submitted(there, e.where("event_id % 5 <> 0"), "event_id").select("event_id", "kind", "world")


@query("""SELECT l_orderkey AS plan, sum(power(l_quantity * r, 2) * w * l_linenumber) AS work,
sum(power(l_quantity * r, 2) * w * least(l_suppkey % 8, l_linenumber)) AS done, round(sum(power(l_quantity * r, 2) * w * least(l_suppkey % 8, l_linenumber)) / sum(power(l_quantity * r, 2) * w * l_linenumber), 6) AS share
FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 512 ELSE 64 END AS r, CASE WHEN l_partkey % 2 = 0 THEN 1.6 ELSE 1.0 END AS w FROM lineitem) GROUP BY 1""")
def v4_progress(spark, sf_dir):
    """How far plans of levels have come, by work."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan"), F.col("l_quantity").alias("cells"), F.when(F.col("l_partkey") % 2 == 0, 512).otherwise(64).alias("ratio"),
        F.col("l_linenumber").alias("iterations"), (F.col("l_suppkey") % 8).alias("done"),
    )
    return jobs.progress(rows, ["plan"]).select("plan", "work", "done", r6(F.col("share"), "share"))


@query("""WITH c AS (SELECT cid, cid // 64 AS i, cid % 64 AS j FROM range(4096) t(cid)),
h AS (SELECT *, round(1000 * cos(i * pi() / 32) * cos(j * pi() / 32) - 100, 6) AS h FROM c)
SELECT cid, i, j, h, h < 0 AS sea, round(15 - 30 * abs(i - 31.5) / 32 - 0.0065 * greatest(h, 0), 6) AS temperature, CASE WHEN h < 0 THEN 0.0 ELSE round(50 + h / 20, 6) END AS rain, round(greatest(h, 0) / 100, 6) AS sediment FROM h""")
def v6_fixture_stages(spark, sf_dir):
    """A made world of 64 x 64 cells, as the stages before erosion would leave it: a fixture for the others."""
    c = spark.range(4096).select(F.col("id").alias("cid"), F.floor(F.col("id") / 64).alias("i"), (F.col("id") % 64).alias("j"))
    wave = lambda x: F.cos(F.col(x) * F.pi() / 32)
    c = c.withColumn("h", r6(1000 * wave("i") * wave("j") - 100, "h"))
    land = F.greatest("h", F.lit(0.0))
    return c.select(
        "cid", "i", "j", "h", (F.col("h") < 0).alias("sea"), r6(15 - 30 * F.abs(F.col("i") - 31.5) / 32 - 0.0065 * land, "temperature"),
        F.when(F.col("h") < 0, 0.0).otherwise(F.round(50 + F.col("h") / 20, 6)).alias("rain"), r6(land / 100, "sediment"),
    )


@query(f"""WITH RECURSIVE {COMP}, sc AS (SELECT cid, i, j, h > 150000 AS lake, (h - 150000) / 10000.0::DOUBLE AS d FROM elev),
n AS (SELECT *, least(greatest(d, -3.0), 3.0) AS near, d > -12 AS zone FROM sc),
o AS (SELECT x AS di, y AS dj, exp(-(x * x + y * y) / 2.0) AS g FROM range(-3, 4) a(x), range(-3, 4) b(y)),
sm AS (SELECT a.cid, sum(g * b.near) / sum(g) AS e FROM n a CROSS JOIN o JOIN n b ON b.i = a.i + o.di AND b.j = a.j + o.dj WHERE a.zone AND b.zone GROUP BY 1),
thin AS (SELECT label FROM comp JOIN sm USING (cid) GROUP BY 1 HAVING avg((e > 0)::INT) < 0.5),
f AS (SELECT n.cid, n.d, n.near, CASE WHEN comp.label IN (SELECT label FROM thin) THEN n.near ELSE sm.e END AS e FROM n JOIN sm USING (cid) LEFT JOIN comp USING (cid))
SELECT cid, round(e + CASE WHEN e > 0 THEN greatest(d - near, 0.0) ELSE least(d - near, 0.0) END, 6) AS value FROM f
UNION ALL SELECT cid, round(d, 6) FROM n WHERE NOT zone""")
def r18_smooth_shore(spark, sf_dir):
    """Depths about a level with the shores of their lakes smoothed, thin lakes left as they are."""
    c = elev(spark, sf_dir)[0].withColumn("d", (F.col("h") - 150000) / 10000.0)
    return raster.smooth_shore(c, "d", F.col("h") > 150000, 12.0, 3.0, 1.0, 3, 0.5).select("cid", r6(F.col("value"), "value"))
