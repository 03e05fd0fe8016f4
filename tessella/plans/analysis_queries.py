"""Queries of graph operators, iterations, the store and composed analyses."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate, graph, grid, iterate, raster, tiles
from ..sources.store import Store, content_hash, with_missing
from .registry import CLOUD, D8, ELEV, ELEVN, NBR, NBRN, PATHS, cloud, elev, query, r6, table, with_rain


def _scratch(spark) -> Store:
    from ..operators.graph import settled

    settled(spark.range(1))
    return Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")


# --- routing -----------------------------------------------------------------------------------


@query(f"WITH {ELEV}, {NBR}, {D8} SELECT cid, code, down FROM d8")
def g5_flow_directions(spark, sf_dir):
    return grid.steepest(elev(spark, sf_dir)[0]).select("cid", "code", "down")


@query(f"WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, {PATHS} SELECT cid, root, depth::BIGINT AS depth FROM up")
def g2_roots(spark, sf_dir):
    """Sinks by pointer doubling (also G7: depth is a topological rank)."""
    return graph.roots(grid.steepest(elev(spark, sf_dir)[0])).select("cid", "root", "depth")


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, walk(src, cid) AS (SELECT cid, cid FROM d8 UNION ALL SELECT w.src, d.down FROM walk w JOIN d8 d ON d.cid = w.cid WHERE d.down <> d.cid)
SELECT w.cid, round(sum(e.rain), 4) AS acc, count(*) AS cells FROM walk w JOIN elev e ON e.cid = w.src GROUP BY w.cid""")
def g4_accumulation(spark, sf_dir):
    c, _, _ = elev(spark, sf_dir)
    weights = with_rain(spark, sf_dir, c).select("cid", "rain", F.lit(1.0).alias("one"))
    both = graph.accumulate(grid.steepest(c).select("cid", "down"), weights, weight=["rain", "one"])
    return both.select("cid", F.round("acc_rain", 4).alias("acc"), F.col("acc_one").cast("long").alias("cells"))


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, {PATHS} SELECT root, count(*) AS cells, round(sum(rain), 4) AS rain, max(h) AS top, max(depth)::BIGINT AS longest FROM up JOIN elev USING (cid) GROUP BY root""")
def basin_table(spark, sf_dir):
    """The flagship: catchments of a height field, from neighbours to basin records (also A10, G9 labels)."""
    c, _, _ = elev(spark, sf_dir)
    basins = graph.roots(grid.steepest(c))
    met = with_rain(spark, sf_dir, c).join(basins, "cid")
    return met.groupBy("root").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("rain"), 4).alias("rain"), F.max("h").alias("top"), F.max("depth").alias("longest")
    )


@query(None)
def g3_flood(spark, sf_dir):
    """Filled levels of all depressions by the catchments' spill graph (G6); tests hold them against a
    relaxation cell by cell."""
    c, h, w = elev(spark, sf_dir)
    border = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == h - 1) | (F.col("j") == w - 1)
    return tiles.flood(c, border).select("cid", "h", "filled")


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, m AS MATERIALIZED (SELECT (cid + 0)::BIGINT AS cid FROM elev WHERE h > 150000), e AS MATERIALIZED (SELECT (n.cid + 0)::BIGINT AS a, (n.nid + 0)::BIGINT AS b FROM nbr n WHERE h > 150000 AND nh > 150000),
r(a, b) AS (SELECT cid, cid FROM m UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS cid, min(b) AS label FROM r GROUP BY a""")
def g1_components(spark, sf_dir):
    """8-connected components of a mask, numbered by the least cell."""
    return raster.mask_components(elev(spark, sf_dir)[0], F.col("h") > 150000)


COMP = f"""{ELEVN}, {NBRN}, m AS MATERIALIZED (SELECT (cid + 0)::BIGINT AS cid FROM elev WHERE h > 150000), e AS MATERIALIZED (SELECT (n.cid + 0)::BIGINT AS a, (n.nid + 0)::BIGINT AS b FROM nbr n WHERE h > 150000 AND nh > 150000),
r(a, b) AS (SELECT cid, cid FROM m UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), comp AS (SELECT a AS cid, min(b) AS label FROM r GROUP BY a)"""


@query(f"WITH RECURSIVE {COMP} SELECT cid, label FROM comp WHERE label IN (SELECT label FROM comp GROUP BY label HAVING count(*) >= 5)")
def f5_kept_components(spark, sf_dir):
    """Components of at least five cells."""
    lab = graph.settled(raster.mask_components(elev(spark, sf_dir)[0], F.col("h") > 150000))
    big = lab.groupBy("label").count().where("count >= 5").select("label")
    return lab.join(big, "label", "left_semi").select("cid", "label")


@query(f"WITH RECURSIVE {COMP} SELECT cid, label FROM comp WHERE label IN (SELECT label FROM comp JOIN elev USING (cid) GROUP BY label HAVING max(h) > 350000)")
def f6_hysteresis(spark, sf_dir):
    """Components over the low threshold that hold a cell over the high one."""
    c = elev(spark, sf_dir)[0]
    lab = graph.settled(raster.mask_components(c, F.col("h") > 150000))
    high = lab.join(c.select("cid", "h"), "cid").groupBy("label").agg(F.max("h").alias("m")).where("m > 350000").select("label")
    return lab.join(high, "label", "left_semi").select("cid", "label")


@query(f"""WITH RECURSIVE {COMP} SELECT label, count(*) AS cells, avg((rain > 100)::INT) >= 0.25 OR count(*) < 4 AS kept FROM comp JOIN elev USING (cid) GROUP BY label""")
def f7_agree_with_mask(spark, sf_dir):
    """Components that overlap another mask by a quarter, or are small."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    lab = raster.mask_components(c, F.col("h") > 150000).join(c.select("cid", "rain"), "cid")
    n = F.count(F.lit(1))
    return lab.groupBy("label").agg(n.alias("cells"), ((F.avg((F.col("rain") > 100).cast("int")) >= 0.25) | (n < 4)).alias("kept"))


@query(f"""WITH RECURSIVE {COMP} SELECT label, count(*) AS cells, round(sum(rain), 4) AS rain, max(h) AS top, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min_by(cid, {{'h': h, 'c': cid}}) AS outlet
FROM comp JOIN elev USING (cid) GROUP BY label""")
def a10_component_records(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    met = raster.mask_components(c, F.col("h") > 150000).join(c, "cid")
    return met.groupBy("label").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("rain"), 4).alias("rain"), F.max("h").alias("top"),
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"),
        F.min_by("cid", F.struct("h", "cid")).alias("outlet"),
    )


@query(f"""WITH RECURSIVE {COMP}, a AS (SELECT label, count(*) AS n FROM comp GROUP BY label) SELECT label, n FROM a WHERE n >= 0.01 * (SELECT sum(n) FROM a) OR n = (SELECT max(n) FROM a)""")
def a11_large_areas(spark, sf_dir):
    lab = raster.mask_components(elev(spark, sf_dir)[0], F.col("h") > 150000)
    a = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    a = a.withColumns({"_t": F.sum("n").over(w), "_m": F.max("n").over(w)})
    return a.where((F.col("n") >= 0.01 * F.col("_t")) | (F.col("n") == F.col("_m"))).select("label", "n")


@query(f"""WITH {ELEV}, c AS (SELECT i // 5 * 1000 + j // 5 AS lake, cid, h, rain + 1 AS need FROM elev), q AS (SELECT lake, sum(need) / 2 AS inflow FROM c GROUP BY lake),
r AS (SELECT c.lake, h, inflow, sum(need) OVER (PARTITION BY c.lake ORDER BY h, cid) AS cum FROM c JOIN q ON q.lake = c.lake)
SELECT lake, min(h) FILTER (WHERE cum >= inflow) AS level, round(greatest(any_value(inflow) - max(cum), 0), 6) AS outflow FROM r GROUP BY lake""")
def a12_lake_balance(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    c = c.select((F.floor(F.col("i") / 5) * 1000 + F.floor(F.col("j") / 5)).alias("lake"), "cid", "h", (F.col("rain") + 1).alias("need"))
    inflow = c.groupBy("lake").agg((F.sum("need") / 2).alias("inflow"))
    out = aggregate.hypsometric_balance(c, "lake", "h", "need", inflow)
    return out.select("lake", "level", r6(F.col("outflow"), "outflow"))


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, walk(src, cid) AS (SELECT cid, cid FROM d8 UNION ALL SELECT w.src, d.down FROM walk w JOIN d8 d ON d.cid = w.cid WHERE d.down <> d.cid),
acc AS (SELECT w.cid, sum(e.rain) AS a FROM walk w JOIN elev e ON e.cid = w.src GROUP BY w.cid), ch AS (SELECT d.cid, CASE WHEN d.down <> d.cid THEN d.down END AS down FROM d8 d JOIN acc USING (cid) WHERE a > 400),
n AS (SELECT down AS cid, count(*) AS inflows FROM ch WHERE down IS NOT NULL GROUP BY down)
SELECT ch.cid, CASE WHEN ch.down IS NULL THEN 'outlet' WHEN n.inflows >= 2 THEN 'junction' WHEN n.inflows IS NULL THEN 'source' ELSE 'chain' END AS kind FROM ch LEFT JOIN n USING (cid)""")
def g8_channel_nodes(spark, sf_dir):
    """Kinds of the channel network's cells."""
    c, _, _ = elev(spark, sf_dir)
    links = graph.settled(grid.steepest(c).select("cid", "down"))
    acc = graph.accumulate(links, with_rain(spark, sf_dir, c).withColumnRenamed("rain", "w"))
    ch = graph.settled(links.join(acc.where("acc > 400"), "cid").select("cid", F.when(F.col("cid") != F.col("down"), F.col("down")).alias("down")))
    n = ch.where("down is not null").groupBy(F.col("down").alias("cid")).agg(F.count(F.lit(1)).alias("inflows"))
    kind = F.when(F.col("down").isNull(), "outlet").when(F.col("inflows") >= 2, "junction").when(F.col("inflows").isNull(), "source").otherwise("chain")
    return ch.join(n, "cid", "left").select("cid", kind.alias("kind"))


def _orders(most: int) -> str:
    """Tables s2 to s<most>: cells of at least that order, which are those at or below a meeting of two of the
    order before."""
    return ",\n".join(
        f"""j{k} AS (SELECT t.down AS cid FROM s{k - 1} JOIN t USING (cid) GROUP BY 1 HAVING count(*) > 1),
s{k}(cid) AS (SELECT cid FROM j{k} UNION SELECT t.down FROM s{k} JOIN t USING (cid))"""
        for k in range(2, most + 1)
    )


ORDERS = 9


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, t AS MATERIALIZED (SELECT (cid + 0)::BIGINT AS cid, (down + 0)::BIGINT AS down FROM d8 WHERE cid <> down), s1 AS (SELECT cid FROM t),
{_orders(ORDERS)}
SELECT t.cid AS id, (1 + {" + ".join(f"(t.cid IN (SELECT cid FROM s{k}))::INT" for k in range(2, ORDERS + 1))})::INT AS "order" FROM t""")
def g8_strahler(spark, sf_dir):
    """Strahler orders of the forest of steepest descent; tests also hold them against a recursion."""
    links = grid.steepest(elev(spark, sf_dir)[0]).where("cid <> down")
    return graph.strahler(links.select(F.col("cid").alias("id"), F.col("cid").alias("a"), F.col("down").alias("b")))


@query(f"""WITH {ELEV}, {NBR}, s AS (SELECT cid, nid, (h - nh) / CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1 END AS s, rain FROM nbr WHERE h > nh), t AS (SELECT cid, sum(s) AS t FROM s GROUP BY cid)
SELECT nid AS cid, round(sum(rain * s / t), 4) AS got FROM s JOIN t USING (cid) GROUP BY nid""")
def g18_spread(spark, sf_dir):
    """One round of routing to all lower neighbours, in proportion to slope."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    e = grid.edges(c, ["h"], own=["h", "rain"]).where("h > n_h")
    e = e.withColumn("s", (F.col("h") - F.col("n_h")) / grid.d8_length(F.col("k")))
    e = e.withColumn("t", F.sum("s").over(Window.partitionBy("cid")))
    return e.groupBy(F.col("nid").alias("cid")).agg(F.round(F.sum(F.col("rain") * F.col("s") / F.col("t")), 4).alias("got"))


@query(f"""WITH RECURSIVE {CLOUD}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM cloud a JOIN cloud b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.0225),
r(a, b) AS (SELECT vec_id, vec_id FROM cloud UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS vec_id, min(b) AS piece FROM r GROUP BY a)
SELECT label, piece, count(*) AS n FROM c JOIN cloud USING (vec_id) GROUP BY 1, 2""")
def g10_split_groups(spark, sf_dir):
    """The pieces of each label on a radius graph."""
    met = graph.radius_components(cloud(spark, sf_dir), "vec_id", "label", ["x", "y", "z"], 0.15)
    return met.groupBy("label", "piece").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, {PATHS}, b AS (SELECT n.cid, a.root AS ra, b.root AS rb FROM nbr n JOIN up a ON a.cid = n.cid JOIN up b ON b.cid = n.nid WHERE n.k < 4 AND a.root <> b.root)
SELECT least(ra, rb) AS low, greatest(ra, rb) AS high, count(*) AS contacts FROM b GROUP BY 1, 2""")
def q9_partition_audit(spark, sf_dir):
    """Contacts between catchments, the graph that partitions are merged on."""
    c = elev(spark, sf_dir)[0]
    lab = graph.settled(graph.roots(grid.steepest(c)).select("cid", "root"))
    e = grid.edges(c, [], grid.D8[:4])
    met = e.join(lab.withColumnRenamed("root", "ra"), "cid").join(lab.select(F.col("cid").alias("nid"), F.col("root").alias("rb")), "nid").where("ra <> rb")
    return met.groupBy(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")).agg(F.count(F.lit(1)).alias("contacts"))


@query(f"""WITH RECURSIVE {ELEVN}, {NBRN}, {D8}, walk(src, cid) AS (SELECT cid, cid FROM d8 UNION ALL SELECT w.src, d.down FROM walk w JOIN d8 d ON d.cid = w.cid WHERE d.down <> d.cid),
acc AS (SELECT cid, count(*) AS a FROM walk GROUP BY cid), s AS (SELECT d.cid, (e.h - f.h) / CASE WHEN d.code % 2 = 1 THEN 1.4142135623730951 ELSE 1 END AS s FROM d8 d JOIN elev e ON e.cid = d.cid JOIN elev f ON f.cid = d.down WHERE d.code < 8),
b AS (SELECT floor(round(log10(a) / 0.25, 9))::BIGINT AS bin, s FROM acc JOIN s USING (cid))
SELECT bin, count(*) AS n, round(median(s), 4) AS slope FROM b GROUP BY bin HAVING count(*) >= 25""")
def q4_slope_area(spark, sf_dir):
    """Median slope by contributing area, in quarter decades."""
    c, _, _ = elev(spark, sf_dir)
    links = graph.settled(grid.steepest(c))
    acc = graph.accumulate(links, c.withColumn("w", F.lit(1.0)))
    f = c.select(F.col("cid").alias("down"), F.col("h").alias("f"))
    s = links.where("code < 8").join(c.select("cid", "h"), "cid").join(f, "down").select("cid", ((F.col("h") - F.col("f")) / F.when(F.col("code") % 2 == 1, grid.SQRT2).otherwise(1.0)).alias("s"))
    b = acc.join(s, "cid").select(F.floor(F.round(F.log10("acc") / 0.25, 9)).alias("bin"), "s")
    return b.groupBy("bin").agg(F.count("s").alias("n"), F.round(F.percentile("s", 0.5), 4).alias("slope")).where("n >= 25")


@query(f"""WITH {ELEV}, {NBR}, p AS (SELECT count(*) FILTER (WHERE h > 200000 AND nh <= 200000) AS line FROM nbr WHERE k % 2 = 0), a AS (SELECT count(*) AS area FROM elev WHERE h > 200000),
o AS (SELECT cid FROM nbr WHERE h > 200000 GROUP BY cid HAVING count(*) FILTER (WHERE nh > 200000) = 8), d AS (SELECT count(DISTINCT x) AS opened FROM (SELECT cid AS x FROM o UNION ALL SELECT n.nid FROM nbr n JOIN o USING (cid)))
SELECT line, area, round(line / sqrt(area), 6) AS ratio, area - opened AS lost FROM p, a, d""")
def q6_isoline(spark, sf_dir):
    """Length of an isoline over the root of its area, and what a morphological opening loses."""
    c = elev(spark, sf_dir)[0]
    wide = grid.stencil(c, ["h"], keep=["cid"]).where("h > 200000")
    cut = F.lit(0)
    for k in (0, 2, 4, 6):
        cut = cut + F.coalesce((F.col(f"h_{k}") <= 200000).cast("int"), F.lit(0))
    one = wide.agg(F.sum(cut).alias("line"), F.count(F.lit(1)).alias("area"))
    core = raster.peel(c, F.col("h") > 200000, 1).where("depth = 2")
    opened = raster.near(c.join(core.select("cid", "depth"), "cid", "left"), F.col("depth").isNotNull(), 1).agg(F.count(F.lit(1)).alias("opened"))
    out = one.crossJoin(F.broadcast(opened))  # one row each
    return out.select("line", "area", r6(F.col("line") / F.sqrt("area"), "ratio"), (F.col("area") - F.col("opened")).alias("lost"))


@query("""WITH a AS (SELECT l_suppkey, date_trunc('quarter', l_shipdate) AS q, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey AS run, round(max(m) - min(m), 6) AS spread, count(*) AS n, round(regr_slope(m, epoch(q) / 1e7), 4) AS trend FROM a GROUP BY 1""")
def q7_scorecard(spark, sf_dir):
    """Spread and trend of a metric over time for each run."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("q")).agg(F.avg("l_discount").alias("m"))
    return a.groupBy(F.col("l_suppkey").alias("run")).agg(
        r6(F.max("m") - F.min("m"), "spread"), F.count("m").alias("n"), F.round(F.regr_slope("m", F.unix_timestamp("q") / 1e7), 4).alias("trend")
    )


@query(f"""WITH {ELEV}, {NBR}, w2 AS (SELECT cid, CASE WHEN zone = '1-URGENT' THEN h + 50000 ELSE h END AS h2 FROM elev), p1 AS (SELECT cid FROM nbr GROUP BY cid HAVING min(nh) > any_value(h)),
p2 AS (SELECT n.cid FROM nbr n JOIN w2 a ON a.cid = n.cid JOIN w2 b ON b.cid = n.nid GROUP BY n.cid HAVING min(b.h2) > any_value(a.h2))
SELECT CASE WHEN p1.cid IS NULL THEN CASE WHEN e.zone = '1-URGENT' THEN 'dug' ELSE 'dammed' END WHEN p2.cid IS NULL THEN 'gone' ELSE 'kept' END AS kind, count(*) AS n
FROM p1 FULL JOIN p2 USING (cid) JOIN elev e ON e.cid = coalesce(p1.cid, p2.cid) GROUP BY 1""")
def q10_pit_census(spark, sf_dir):
    """Pits before and after a change, by cause."""
    c = elev(spark, sf_dir)[0].withColumn("h2", F.when(F.col("zone") == "1-URGENT", F.col("h") + 50000).otherwise(F.col("h")))
    wide = grid.stencil(c, ["h", "h2"], keep=["cid", "zone"])
    pit = lambda v: F.least(*[f"{v}_{k}" for k in range(8)]) > F.col(v)
    was, now = pit("h"), pit("h2")
    kind = F.when(~was, F.when(F.col("zone") == "1-URGENT", "dug").otherwise("dammed")).when(~now, "gone").otherwise("kept")
    return wide.where(was | now).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, floor(value / 20)::BIGINT AS band, count(*) AS n FROM events GROUP BY 1, 2")
def q11_census(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 20).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# --- iterations --------------------------------------------------------------------------------


@query(f"""WITH {ELEV}, f AS (SELECT i, j, cid, 1 + rain / 100 AS m0, 0.05 + 0.1 * h / (SELECT max(h) FROM elev) AS share FROM elev),
a AS (SELECT cid, m0, share, greatest(i - 0.5, 0.0) AS a, greatest(j - 0.25, 0.0) AS b FROM f),
c AS (SELECT cid, m0, share, floor(a)::BIGINT + s AS i, floor(b)::BIGINT + t AS j, (CASE WHEN s = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE WHEN t = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) AS w FROM a, range(2) s(s), range(2) t(t)),
l AS (SELECT c.cid, c.m0, c.share, c.w, g.cid AS src FROM c JOIN dim ON true JOIN f g ON g.i = least(c.i, hh - 1) AND g.j = least(c.j, ww - 1)),
m1 AS (SELECT l.cid, any_value(l.m0) AS m0, any_value(l.share) AS share, sum(l.w * f.m0) AS v FROM l JOIN f ON f.cid = l.src GROUP BY l.cid), s1 AS (SELECT cid, (v + 0.1 * (m0 - v)) * (1 - share) AS m FROM m1),
m2 AS (SELECT l.cid, any_value(l.m0) AS m0, any_value(l.share) AS share, sum(l.w * s1.m) AS v FROM l JOIN s1 ON s1.cid = l.src GROUP BY l.cid)
SELECT cid, round((v + 0.1 * (m0 - v)) * (1 - share), 6) AS m, round((v + 0.1 * (m0 - v)) * share, 6) AS rain FROM m2""")
def i6_advection(spark, sf_dir):
    """Two semi-Lagrangian sweeps of moisture under a steady wind."""
    c, h, w = elev(spark, sf_dir)
    top = c.agg(F.max("h")).first()[0]
    c = graph.settled(with_rain(spark, sf_dir, c).select("cid", "i", "j", (1 + F.col("rain") / 100).alias("m0"), "h"))
    out = iterate.advect(c, h, w, F.lit(0.5), F.lit(0.25), 1.0, 0.1, 0.05 + 0.1 * F.col("h") / top, 2)
    return out.select("cid", r6(F.col("m"), "m"), r6(F.col("rain"), "rain"))


@query(f"""WITH {ELEV}, d AS (SELECT cid, h, rain AS s, (h % 400) - 200 AS d FROM elev), l AS (SELECT *, least(greatest(-d, 0), s) AS l FROM d)
SELECT cid, round(h - greatest(-d - l, 0), 6) AS h, round(s - l + greatest(d, 0), 6) AS s FROM l""")
def i5_fold_changes(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).withColumn("d", F.col("h") % 400 - 200)
    return iterate.fold_changes(c, "h", "rain", "d").select("cid", r6(F.col("h"), "h"), r6(F.col("rain"), "s"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, value - 60 AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f(user_id, r, level, owed) AS (SELECT DISTINCT user_id, 0::BIGINT, 100.0::DOUBLE, 0.0::DOUBLE FROM e UNION ALL
 SELECT e.user_id, e.r, CASE WHEN d < 0 THEN level - least(-d, greatest(level, 0)) ELSE level + d - least(d, owed) END, CASE WHEN d < 0 THEN owed - d - least(-d, greatest(level, 0)) ELSE owed - least(d, owed) END
 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, round(max_by(level, r), 4) AS level, round(max_by(owed, r), 4) AS owed FROM f GROUP BY user_id""")
def i4_serial_fold(spark, sf_dir):
    """Order-dependent folds with clamps and what is owed, side by side for all groups."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("value") - 60).alias("delta"), F.lit(100.0).alias("start"))
    return iterate.apply_rows(e, ["user_id"], 0.0).select("user_id", F.round("level", 4).alias("level"), F.round("owed", 4).alias("owed"))


@query(f"WITH {ELEV} SELECT cid, round(h + u - (SELECT avg(u) FROM (SELECT least(rain, 50) AS u FROM elev)), 6) AS h FROM (SELECT cid, h, least(rain, 50) AS u FROM elev)")
def i8_uplift(spark, sf_dir):
    """A capped addition without its mean."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).withColumn("u", F.least(F.col("rain"), F.lit(50.0)))
    mean = c.agg(F.avg("u").alias("m"))
    return c.crossJoin(F.broadcast(mean)).select("cid", r6(F.col("h") + F.col("u") - F.col("m"), "h"))


@query(f"""WITH {ELEV}, {NBR}, c AS (SELECT cid, i, j, least(rain / 300, 1) AS x, least(h / 400000, 1) AS k FROM elev), n AS (SELECT a.cid, avg(c.x) AS near FROM nbr a JOIN c ON c.cid = a.nid GROUP BY a.cid)
SELECT cid, round(least(greatest(CASE WHEN x < k THEN x + (0.2 * x + 0.1 * near) * (k - x) ELSE x - 0.5 * (x - k) END, 0), 1) + 0.00000001, 6) AS x FROM c JOIN n USING (cid)""")
def i11_cover(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    c = c.select("cid", "i", "j", F.least(F.col("rain") / 300, F.lit(1.0)).alias("x"), F.least(F.col("h") / 400000, F.lit(1.0)).alias("k"))
    return iterate.grow_cover(c, "x", "k", 0.2, 0.1, 0.5).select("cid", r6(F.col("x") + 0.00000001, "x"))


@query(f"""WITH {CLOUD}, p AS (SELECT label, (vec_id % 7) / 7.0 AS w, x, y, z FROM cloud)
SELECT label, round(sum(w * (1 - x * x)), 6) AS xx, round(sum(w * (1 - y * y)), 6) AS yy, round(sum(w * (1 - z * z)), 6) AS zz, round(-sum(w * x * y), 6) AS xy FROM p GROUP BY label""")
def i13_drag_blocks(spark, sf_dir):
    """The entries of each label's drag matrix, sums of w (I - p p'); the small solve is the caller's."""
    c = cloud(spark, sf_dir).withColumn("w", F.col("vec_id") % 7 / 7.0)
    x, y, z, w = (F.col(k) for k in "xyzw")
    return c.groupBy("label").agg(r6(F.sum(w * (1 - x * x)), "xx"), r6(F.sum(w * (1 - y * y)), "yy"), r6(F.sum(w * (1 - z * z)), "zz"), r6(-F.sum(w * x * y), "xy"))


@query(None)
def c1_clusters(spark, sf_dir):
    """Spherical k-means by Lloyd rounds from the least ids of the labels; tests hold it against numpy."""
    c = cloud(spark, sf_dir)
    seeds = c.groupBy("label").agg(F.min_by(F.struct("x", "y", "z"), "vec_id").alias("p")).orderBy("label").limit(8).collect()
    out, _ = iterate.spherical_kmeans(c, "vec_id", ["x", "y", "z"], [tuple(r["p"]) for r in seeds], 6)
    return out.select("vec_id", "cluster")


# --- the store ---------------------------------------------------------------------------------


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def s1_scan(spark, sf_dir):
    """A scan of three columns with its filter pushed down."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority AS zone, count(*) AS n FROM orders GROUP BY 1")
def s2_partitioned_write(spark, sf_dir):
    """Written by partition and read back."""
    store = _scratch(spark)
    store.save("cells", elev(spark, sf_dir)[0].select("cid", "zone"), ["zone"])
    return store.load("cells").groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT md5('n_name=' || n_name || '|n_nationkey=' || n_nationkey || '|n_regionkey=' || n_regionkey) AS d FROM nation)
SELECT count(*) || '-' || sum(('0x' || substr(d, 1, 8))::UINTEGER) || '-' || sum(('0x' || substr(d, 9, 8))::UINTEGER) AS hash FROM r""")
def s7_content_hash(spark, sf_dir):
    return content_hash(table(spark, sf_dir, "nation"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def s5_nested_records(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {ELEV} SELECT cid, h, 0.0::DOUBLE AS sediment FROM elev")
def s13_missing_columns(spark, sf_dir):
    return with_missing(elev(spark, sf_dir)[0].select("cid", "h"), ["h", "sediment"]).select("cid", "h", "sediment")


@query("SELECT 2 AS iteration, count(*) AS n FROM supplier")
def s14_checkpoints(spark, sf_dir):
    """Four states saved, two kept; the newest at or before the second is found."""
    store, params = _scratch(spark), {"seed": 7}
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    for k in range(1, 4):
        store.checkpoint("state", s.withColumn("it", F.lit(k)), k, params)
    at, df = store.find_checkpoint("state", params, 2)
    return df.groupBy(F.lit(at).alias("iteration")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber AS key, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 1 AND 2 GROUP BY 1")
def s16_frames(spark, sf_dir):
    """Frames appended by key, then cut after one."""
    store, l = _scratch(spark), table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity")
    for k in (1, 2, 3):
        store.add_frame("frames", k, l.where(F.col("l_linenumber") == k).select("l_quantity"))
    store.clear_frames("frames", 2)
    return store.load("frames").groupBy(F.col("key").cast("int").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'a' AS stage, true AS done UNION ALL SELECT 'b', true")
def s6_manifest(spark, sf_dir):
    """A two-stage run: its manifest (also V5)."""
    from .stages import Stage, run_stages

    store = _scratch(spark)
    stages = [
        Stage("a", lambda s, p: {"n": table(spark, sf_dir, "nation")}, ["n"]),
        Stage("b", lambda s, p: {"r": s.load("n").groupBy("n_regionkey").count()}, ["r"]),
    ]
    run_stages(store, stages, {})
    return store.manifest().select("stage", "done")
