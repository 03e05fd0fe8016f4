"""Queries of joins over points, aggregations, windows, rankings and scalar rules."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import aggregate, grid, joins, windows
from ..operators.graph import exclusive_top
from .registry import CLOUD, ELEV, ELEVN, N, NBR, SPHERE, cloud, elev, query, r6, table, with_rain

# --- joins over points -------------------------------------------------------------------------

R = 0.35


def _pairs(spark, sf_dir, radius):
    q = grid.sphere_cells(spark, N).select("cid", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    return joins.within(q, cloud(spark, sf_dir), ["qx", "qy", "qz"], ["x", "y", "z"], radius)


D2 = "(s.x - p.x) ** 2 + (s.y - p.y) ** 2 + (s.z - p.z) ** 2"


@query(f"""WITH {CLOUD}, {SPHERE}, d AS (SELECT s.cid, p.vec_id, {D2} AS d2 FROM sph s JOIN cloud p ON {D2} <= {R * R})
SELECT cid, min_by(vec_id, round(d2, 9) * 1e6 + vec_id * 1e-6) AS vec_id FROM d GROUP BY cid""")
def j3_nearest_point(spark, sf_dir):
    """The nearest point of each cell of the sphere within a radius, ties to the least id."""
    pairs = _pairs(spark, sf_dir, R).withColumn("d2", F.round("d2", 9))
    return joins.nearest(pairs, "cid", "vec_id").select("cid", "vec_id")


@query(f"""WITH {CLOUD}, {SPHERE}, d AS (SELECT s.cid, p.vec_id, p.label, round({D2}, 9) AS d2 FROM sph s JOIN cloud p ON {D2} <= {R * R}),
k AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY d2, vec_id) AS rn FROM d)
SELECT cid, round(sum(exp(-d2 / 0.02) * label) / sum(exp(-d2 / 0.02)), 6) AS value FROM k WHERE rn <= 6 GROUP BY cid""")
def j4_kernel_interpolation(spark, sf_dir):
    """Gaussian-weighted mean of the six nearest points' values."""
    near = joins.nearest(_pairs(spark, sf_dir, R).withColumn("d2", F.round("d2", 9)), "cid", "vec_id", 6)
    out = joins.kernel_mean(near, "cid", "label", F.exp(-F.col("d2") / 0.02), "value")
    return out.select("cid", r6(F.col("value"), "value"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q.q, p.vec_id, round(list_sum(list_transform(range(1, 65), lambda k: (p.embedding[k]::DOUBLE - q.e[k]::DOUBLE) * (p.embedding[k]::DOUBLE - q.e[k]::DOUBLE))), 6) AS d2
  FROM q JOIN embeddings p ON p.vec_id <> q.q),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rn FROM d)
SELECT q, vec_id, rn::INT AS rank FROM k WHERE rn <= 3""")
def j4_nearest_vectors(spark, sf_dir):
    """Three nearest of every twentieth embedding among all, in 64 dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return joins.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).select("q", "vec_id", "rank")


@query(f"""WITH {CLOUD} SELECT a.vec_id AS a, b.vec_id AS b FROM cloud a JOIN cloud b ON a.vec_id < b.vec_id AND a.label <> b.label
WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.01""")
def j5_radius_self_join(spark, sf_dir):
    """Pairs of unlike labels within a radius."""
    c = cloud(spark, sf_dir)
    left = c.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), *[F.col(k).alias(f"a{k}") for k in "xyz"])
    right = c.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    met = joins.within(left, right, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.1)
    return met.where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b")


@query(f"""WITH {CLOUD}, {SPHERE} SELECT s.cid, round(sum(exp(-({D2}) / 0.02)), 6) AS heat FROM sph s JOIN cloud p ON {D2} <= 0.04 GROUP BY s.cid""")
def j6_range_accumulation(spark, sf_dir):
    """Gaussian bumps of the points summed over the cells in their reach."""
    return _pairs(spark, sf_dir, 0.2).groupBy("cid").agg(r6(F.sum(F.exp(-F.col("d2") / 0.02)), "heat"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, o_orderpriority AS zone FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def j7_gather(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("zone"))
    return l.join(o, "k")


@query(f"""WITH {CLOUD}, d AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 9) AS d2
  FROM cloud a JOIN cloud b ON a.vec_id <> b.vec_id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.25),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rn FROM d)
SELECT a, round(sqrt(coalesce(min(d2) FILTER (WHERE la <> lb), max(d2))), 6) AS distance, (min(d2) FILTER (WHERE la <> lb)) IS NULL AS inner_point FROM k WHERE rn <= 5 GROUP BY a""")
def j8_boundary_distance(spark, sf_dir):
    """Distance to the nearest of five neighbours with another label, else to the fifth."""
    c = cloud(spark, sf_dir)
    left = c.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), *[F.col(k).alias(f"a{k}") for k in "xyz"])
    right = c.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    met = joins.within(left, right, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.5).where("a <> b").withColumn("d2", F.round("d2", 9))
    out = joins.boundary_distance(joins.nearest(met, "a", "b", 5), "a", "la", "lb")
    return out.select("a", r6(F.col("distance"), "distance"), "inner_point")


@query(f"""WITH {CLOUD}, d AS (SELECT a.vec_id AS a, b.vec_id AS b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 9) AS d2 FROM cloud a JOIN cloud b ON b.label = 1
  WHERE a.label = 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.25)
SELECT a, min_by(b, {{'d': d2, 'b': b}}) AS b, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY a""")
def j14_nearest_qualifying(spark, sf_dir):
    """For each point of one label the nearest of another."""
    c = cloud(spark, sf_dir)
    left = c.where("label = 0").select(F.col("vec_id").alias("a"), *[F.col(k).alias(f"a{k}") for k in "xyz"])
    right = c.where("label = 1").select(F.col("vec_id").alias("b"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    met = joins.within(left, right, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.5).withColumn("d2", F.round("d2", 9))
    return joins.nearest(met, "a", "b").select("a", "b", r6(F.sqrt("d2"), "distance"))


@query(f"""WITH {ELEV}, {NBR}, b AS (SELECT cid, max_by({{'k': k, 'nid': nid}}, {{'s': (h - nh) / CASE WHEN k % 2 = 1 THEN 1.4142135623730951 ELSE 1.0 END, 'k': -k}}) AS b FROM nbr WHERE h > nh GROUP BY cid),
l AS (SELECT e.cid, e.i, e.rain, b.b.nid AS down FROM elev e JOIN b USING (cid))
SELECT d.cid, round(sum(l.rain), 4) AS inflow, count(*) AS donors FROM l JOIN elev d ON d.cid = l.down WHERE d.i BETWEEN 5 AND 15 AND NOT l.i BETWEEN 5 AND 15 GROUP BY d.cid""")
def j18_window_inflow(spark, sf_dir):
    """What cells outside a window deliver into it."""
    c, _, _ = elev(spark, sf_dir)
    c = with_rain(spark, sf_dir, c)
    d = grid.steepest(c).where("code < 8").select("cid", F.col("i").alias("si"), "down")
    inside = c.where(F.col("i").between(5, 15)).select(F.col("cid").alias("down"))
    met = d.where(~F.col("si").between(5, 15)).join(inside, "down").join(c.select("cid", "rain"), "cid")
    return met.groupBy(F.col("down").alias("cid")).agg(F.round(F.sum("rain"), 4).alias("inflow"), F.count(F.lit(1)).alias("donors"))


@query(f"""WITH {ELEV}, a AS (SELECT cid, h, (20 - i) / 20.0 AS w FROM elev WHERE i < 20), b AS (SELECT cid, h + 1000 AS h, (i - 10) / 20.0 AS w FROM elev WHERE i > 10 AND i < 30)
SELECT coalesce(a.cid, b.cid) AS cid, round(CASE WHEN a.cid IS NULL THEN b.h WHEN b.cid IS NULL THEN a.h ELSE (a.h * a.w + b.h * b.w) / (a.w + b.w) END, 4) AS h FROM a FULL JOIN b ON a.cid = b.cid""")
def j20_seam_blend(spark, sf_dir):
    c = elev(spark, sf_dir)[0]
    a = c.where("i < 20").select("cid", "h", ((20 - F.col("i")) / 20.0).alias("w"))
    b = c.where("i > 10 and i < 30").select("cid", (F.col("h") + 1000).alias("h"), ((F.col("i") - 10) / 20.0).alias("w"))
    return joins.seam_blend(a, b, ["cid"], "h", "w").select("cid", F.round("h", 4).alias("h"))


@query("""SELECT c_custkey, coalesce(o.total, n.total) AS total FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey
LEFT JOIN (SELECT c_nationkey, round(min(c_acctbal), 2) AS total FROM customer GROUP BY 1) n ON c.c_nationkey = n.c_nationkey""")
def j21_fallback_join(spark, sf_dir):
    """A left join, with a neighbourhood's least value where it finds nothing."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    n = c.groupBy("c_nationkey").agg(F.round(F.min("c_acctbal"), 2).alias("b"))
    return c.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("a", "b").alias("total"))


# --- aggregations ------------------------------------------------------------------------------


@query(f"WITH {CLOUD} SELECT label, count(*) AS n, round(sum(x), 6) AS x, round(sum(y), 6) AS y, round(sum(z), 6) AS z FROM cloud GROUP BY label")
def a1_group_statistics(spark, sf_dir):
    return cloud(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.sum(c), c) for c in "xyz"])


@query("""SELECT 'l_quantity' AS "column", count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), min(l_discount), max(l_discount), round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) FROM lineitem""")
def a2_column_profile(spark, sf_dir):
    """One pass over all columns (also Q13)."""
    p = aggregate.profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return p.select("column", "n", "lo", "hi", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@query(f"""WITH {ELEV}, c AS (SELECT zone, h, sum(rain) OVER (PARTITION BY zone ORDER BY h) AS cw, sum(rain) OVER (PARTITION BY zone) AS t FROM elev)
SELECT zone, min(h) FILTER (WHERE cw >= 0.1 * t) AS q10, min(h) FILTER (WHERE cw >= 0.5 * t) AS q50, min(h) FILTER (WHERE cw >= 0.9 * t) AS q90 FROM c GROUP BY zone""")
def a3_weighted_quantiles(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    return aggregate.weighted_quantiles(c, "h", "rain", [0.1, 0.5, 0.9], ["zone"])


@query(f"""WITH {ELEV}, n AS (SELECT count(*) AS n, count(*) - round_even(0.3 * count(*), 0)::BIGINT AS k FROM elev),
l AS (SELECT h AS level FROM (SELECT h, row_number() OVER (ORDER BY h) AS r FROM elev), n WHERE r = k + 1)
SELECT cid, round(h - level, 4) AS h FROM elev, l""")
def a4_hold_land_share(spark, sf_dir):
    """The exact order statistic that leaves three tenths of the cells above it, and the shift by it."""
    out = aggregate.hold_share(elev(spark, sf_dir)[0], "h", 0.3)
    return out.select("cid", F.round("h", 4).alias("h"))


@query(f"""WITH {ELEV}, b AS (SELECT floor(ln(1 + h) / 0.05)::BIGINT AS bin, count(*) AS n FROM elev GROUP BY 1),
t AS (SELECT bin, n, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS tail FROM b), x AS (SELECT *, coalesce(lead(tail) OVER (ORDER BY bin), 0) AS nt, max(tail) OVER () * 0.2 AS t FROM t)
SELECT round(exp((bin + (tail - t) / (tail - nt)) * 0.05) - 1, 4) AS threshold FROM x WHERE tail > t AND nt <= t""")
def a5_log_histogram_threshold(spark, sf_dir):
    h = aggregate.histogram(elev(spark, sf_dir)[0], F.log1p("h"), 0.05)
    return aggregate.tail_threshold(h, 0.05, 0.2).select(F.round(F.expm1("threshold"), 4).alias("threshold"))


@query(f"""WITH {ELEV}, c AS (SELECT i // 5 AS bi, j // 5 AS bj, zone, count(*) AS n FROM elev GROUP BY ALL)
SELECT bi, bj, zone, n FROM (SELECT *, row_number() OVER (PARTITION BY bi, bj ORDER BY n DESC, zone) AS r FROM c) WHERE r = 1""")
def a6_mode(spark, sf_dir):
    c = elev(spark, sf_dir)[0].withColumns({"bi": F.floor(F.col("i") / 5), "bj": F.floor(F.col("j") / 5)})
    return aggregate.mode(c, ["bi", "bj"], "zone")


@query(f"""WITH {ELEV}, c AS (SELECT i // 4 AS bi, j // 4 AS bj, zone, count(*) AS n FROM elev GROUP BY ALL)
SELECT bi, bj, zone, n FROM (SELECT *, row_number() OVER (PARTITION BY bi, bj ORDER BY n DESC, zone DESC) AS r FROM c) WHERE r = 1""")
def a7_pooled_mode(spark, sf_dir):
    """Pooling by mode, ties to the greatest."""
    c = elev(spark, sf_dir)[0].withColumns({"bi": F.floor(F.col("i") / 4), "bj": F.floor(F.col("j") / 4)})
    return aggregate.mode(c, ["bi", "bj"], "zone", "greatest")


@query(f"WITH {ELEV} SELECT i // 4 AS bi, j // 4 AS bj, round(avg(h) + 0.000001, 4) AS mean, max(h) AS top, min(h) AS low FROM elev GROUP BY 1, 2")
def a8_downsample(spark, sf_dir):
    return aggregate.blocks(elev(spark, sf_dir)[0], 4, [F.round(F.avg("h") + 0.000001, 4).alias("mean"), F.max("h").alias("top"), F.min("h").alias("low")])


@query(f"WITH {ELEV} SELECT zone, round(sum(rain) / (SELECT sum(rain) FROM elev), 6) AS share FROM elev GROUP BY zone")
def a9_shares(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    by = c.groupBy("zone").agg(F.sum("rain").alias("s"))
    return by.select("zone", r6(F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0))), "share"))


@query("SELECT round(sum(l_quantity * l_extendedprice), 2) AS mass, round(sum(l_quantity * l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS returned FROM lineitem")
def a13_totals(spark, sf_dir):
    m = F.col("l_quantity") * F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(m), 2).alias("mass"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", m)), 2).alias("returned"))


@query("""SELECT l_shipmode AS key, round(sum(d), 4) AS debit, round(sum(c), 4) AS credit, round(sum(d) - sum(c), 4) AS residual FROM (SELECT l_linestatus AS l_shipmode, l_quantity AS d, l_quantity * (1 - l_tax) AS c FROM lineitem) GROUP BY 1""")
def a14_ledger(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("key"), F.col("l_quantity").alias("d"), (F.col("l_quantity") * (1 - F.col("l_tax"))).alias("c"))
    return aggregate.ledger(l, "key", "d", "c").select("key", *[F.round(c, 4).alias(c) for c in ("debit", "credit", "residual")])


@query(f"""WITH {CLOUD}, p AS (SELECT least(a.label, b.label) AS lo, greatest(a.label, b.label) AS hi, avg(CASE WHEN a.label < b.label THEN a.vec_id ELSE b.vec_id END) AS age_lo, avg(CASE WHEN a.label < b.label THEN b.vec_id ELSE a.vec_id END) AS age_hi
  FROM cloud a JOIN cloud b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.01 GROUP BY 1, 2)
SELECT lo, hi, CASE WHEN age_lo > age_hi THEN lo ELSE hi END AS loser FROM p""")
def a15_pair_polarity(spark, sf_dir):
    """The older side of each pair of labels in contact, ties to the higher label."""
    c = cloud(spark, sf_dir)
    left = c.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), *[F.col(k).alias(f"a{k}") for k in "xyz"])
    right = c.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    met = joins.within(left, right, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.1).where("a < b and la <> lb")
    out = met.groupBy(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).agg(
        F.avg(F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b"))).alias("x"),
        F.avg(F.when(F.col("la") < F.col("lb"), F.col("b")).otherwise(F.col("a"))).alias("y"),
    )
    return out.select("lo", "hi", F.when(F.col("x") > F.col("y"), F.col("lo")).otherwise(F.col("hi")).alias("loser"))


@query(f"WITH {ELEV}, {NBR} SELECT least(zone, nzone) AS a, greatest(zone, nzone) AS b, min(greatest(h, nh)) AS w FROM nbr WHERE zone <> nzone GROUP BY 1, 2")
def a16_reduce_edges(spark, sf_dir):
    """The least weight of each undirected pair."""
    e = grid.edges(elev(spark, sf_dir)[0], ["h", "zone"], own=["h", "zone"]).where("zone <> n_zone")
    return e.groupBy(F.least("zone", "n_zone").alias("a"), F.greatest("zone", "n_zone").alias("b")).agg(F.min(F.greatest("h", "n_h")).alias("w"))


@query("""WITH m AS (SELECT l_suppkey AS run, date_trunc('month', l_shipdate) AS tm, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
u AS (SELECT run, tm, 'quantity' AS metric, quantity AS v FROM m UNION ALL SELECT run, tm, 'discount', discount FROM m)
SELECT metric, strftime(tm, '%Y-%m') AS month, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM u GROUP BY 1, 2""")
def a17_metric_summary(spark, sf_dir):
    """Metrics of all runs at each checkpoint, unpivoted and summarised."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("at")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    u = m.select("at", F.expr("stack(2, 'quantity', quantity, 'discount', discount) as (metric, v)"))
    return u.groupBy("metric", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v"), "mean"), r6(F.min("v"), "lo"), r6(F.max("v"), "hi"))


@query(f"""WITH {ELEV}, r AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS a, rank() OVER (ORDER BY rain) + (count(*) OVER (PARTITION BY rain) - 1) / 2.0 AS b FROM elev)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def a18_spearman(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).select("h", "rain")
    return aggregate.spearman(c, "h", "rain").select(r6(F.col("rho"), "rho"))


@query(f"""WITH {ELEV}, c AS (SELECT h, sum(CASE WHEN zone = '1-URGENT' THEN rain ELSE 0 END) OVER (ORDER BY h) AS cw, sum(CASE WHEN zone = '1-URGENT' THEN rain ELSE 0 END) OVER () AS t FROM elev)
SELECT min(h) FILTER (WHERE cw >= 0.999 * t) AS q100 FROM c""")
def a19_conditional_quantile(spark, sf_dir):
    """A quantile by the weight of one class."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).withColumn("w", F.when(F.col("zone") == "1-URGENT", F.col("rain")).otherwise(0.0))
    return aggregate.weighted_quantiles(c, "h", "w", [0.999])


@query(f"WITH {ELEV} SELECT cid, round(rain / (SELECT avg(rain) FROM elev WHERE h > 100000), 6) AS wetness FROM elev")
def a20_normalise_by_subset(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    mean = c.agg(F.avg(F.when(F.col("h") > 100000, F.col("rain"))).alias("m"))
    return c.crossJoin(F.broadcast(mean)).select("cid", r6(F.col("rain") / F.col("m"), "wetness"))


@query(f"""WITH {ELEV}, b AS (SELECT avg(h) AS m FROM elev GROUP BY i // 5, j // 5) SELECT count(*) AS n, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.5), 4) AS mid, round(quantile_cont(m, 0.9), 4) AS high FROM b""")
def a21_block_percentiles(spark, sf_dir):
    b = aggregate.blocks(elev(spark, sf_dir)[0], 5, [F.avg("h").alias("m")])
    return b.agg(F.count("m").alias("n"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.percentile("m", 0.5), 4).alias("mid"), F.round(F.percentile("m", 0.9), 4).alias("high"))


@query(f"""WITH {ELEV}, b AS (SELECT h, CASE WHEN h < 100000 THEN 'low' WHEN h < 250000 THEN 'mid' ELSE 'high' END AS band, rain FROM elev)
SELECT band, count(*) AS n, round(sum(rain) / (SELECT sum(rain) FROM elev), 6) AS share, round(sum(h * rain) / sum(rain), 4) AS mean, round(median(h), 4) AS mid, max(h) AS top FROM b GROUP BY band""")
def q1_hypsometry(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    band = F.when(F.col("h") < 100000, "low").when(F.col("h") < 250000, "mid").otherwise("high")
    by = c.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("rain").alias("r"), F.sum(F.col("h") * F.col("rain")).alias("hr"), F.percentile("h", 0.5).alias("m"), F.max("h").alias("top"))
    return by.select("band", "n", r6(F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(0))), "share"), F.round(F.col("hr") / F.col("r"), 4).alias("mean"), F.round("m", 4).alias("mid"), "top")


@query(f"""WITH {ELEV} SELECT zone, round((sum(rain) / (SELECT sum(rain) FROM elev)) / (count(*) / (SELECT count(*) FROM elev)::DOUBLE), 6) AS richness FROM elev GROUP BY zone""")
def q2_share_ratio(spark, sf_dir):
    """Share of the mass over share of the area, by zone."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    by = c.groupBy("zone").agg(F.sum("rain").alias("r"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    return by.select("zone", r6((F.col("r") / F.sum("r").over(w)) / (F.col("n") / F.sum("n").over(w)), "richness"))


@query(f"WITH {ELEV} SELECT zone, round(quantile_cont(h, 0.1), 4) AS p10, round(quantile_cont(h, 0.5), 4) AS p50, round(quantile_cont(h, 0.9), 4) AS p90 FROM elev GROUP BY zone")
def q3_class_quantiles(spark, sf_dir):
    return elev(spark, sf_dir)[0].groupBy("zone").agg(*[F.round(F.percentile("h", q / 100), 4).alias(f"p{q}") for q in (10, 50, 90)])


# --- windows -----------------------------------------------------------------------------------


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM events")
def w1_running_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.running_mean(e, ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", r6(F.col("mean"), "mean"))


@query("""WITH c AS (SELECT event_id, value, sum(value) OVER (ORDER BY event_id) AS hi, sum(value) OVER () AS t FROM events WHERE value > 0)
SELECT event_id, (ceil(round(hi / t * 100 - 0.5, 9)) - ceil(round((hi - value) / t * 100 - 0.5, 9)))::BIGINT AS draws FROM c WHERE ceil(round(hi / t * 100 - 0.5, 9)) > ceil(round((hi - value) / t * 100 - 0.5, 9))""")
def w3_systematic_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 0")
    return windows.spawn(e, "value", "event_id", 100)


@query("""WITH e AS (SELECT user_id, ts, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
p AS (SELECT *, coalesce(lag(x) OVER w, x) AS p0, coalesce(lead(x) OVER w, x) AS p2, coalesce(lead(x, 2) OVER w, lead(x) OVER w, x) AS p3, lead(r) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY r))
SELECT user_id, r, s AS step, round(0.5 * (2 * x + (p2 - p0) * (s / 4.0) + (2 * p0 - 5 * x + 4 * p2 - p3) * (s / 4.0) * (s / 4.0) + (3 * x - p0 - 3 * p2 + p3) * (s / 4.0) * (s / 4.0) * (s / 4.0)) + 0.00000001, 6) AS x
FROM p, range(4) t(s) WHERE NOT last OR s = 0""")
def w4_catmull_rom(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("user_id", F.row_number().over(w).alias("r"), F.col("value").alias("x"))
    return windows.catmull_rom(e, ["user_id"], "r", ["x"], 4).select("user_id", "r", "step", r6(F.col("x") + 0.00000001, "x"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM events")
def w5_running_minimum(spark, sf_dir):
    return windows.running_min(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "low")


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 4.0 WHEN p_size >= 25 THEN 2.5 WHEN p_size >= 10 THEN 1.0 END::DOUBLE AS hardness FROM part")
def w6_step_lookup(spark, sf_dir):
    """Beds: the value of the last break at or below."""
    return windows.lookup_steps(table(spark, sf_dir, "part"), "p_size", [(10, 1.0), (25, 2.5), (40, 4.0)], "hardness").select("p_partkey", "hardness")


RING = """ring AS (SELECT o_custkey AS id, o_orderkey AS k, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y FROM orders)"""


def _ring(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"))


@query(f"""WITH {RING}, n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER f) AS nx, coalesce(lead(y) OVER w, first(y) OVER f) AS ny FROM ring
  WINDOW w AS (PARTITION BY id ORDER BY k), f AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, round(sum(x * ny - nx * y) / 2, 6) AS area FROM n GROUP BY id""")
def w8_ring_area(spark, sf_dir):
    return windows.ring_area(_ring(spark, sf_dir), ["id"], "k", "x", "y").select("id", r6(F.col("area"), "area"))


@query(f"""WITH {RING}, n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER f) AS nx, coalesce(lead(y) OVER w, first(y) OVER f) AS ny, coalesce(lag(x) OVER w, last(x) OVER f) AS px, coalesce(lag(y) OVER w, last(y) OVER f) AS py FROM ring
  WINDOW w AS (PARTITION BY id ORDER BY k), f AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, k, x, y FROM n WHERE (x - px) * (ny - y) - (y - py) * (nx - x) <> 0""")
def w7_simplify_ring(spark, sf_dir):
    return windows.corners_only(_ring(spark, sf_dir), ["id"], "k", "x", "y")


@query(f"""WITH {RING}, n AS (SELECT id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM ring WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id, round(coalesce(sum(d), 0), 6) AS length FROM n GROUP BY id""")
def w9_chain_lengths(spark, sf_dir):
    return windows.chain_lengths(_ring(spark, sf_dir), ["id"], "k", "x", "y").select("id", r6(F.col("length"), "length"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
m(user_id, event_id, r, ema) AS (SELECT user_id, event_id, r, value FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, 0.8 * m.ema + 0.2 * e.value FROM m JOIN e ON e.user_id = m.user_id AND e.r = m.r + 1)
SELECT event_id, round(ema, 6) AS ema FROM m""")
def w10_ema(spark, sf_dir):
    out = windows.ema(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", 0.2)
    return out.select("event_id", r6(F.col("ema"), "ema"))


@query("""WITH e AS (SELECT user_id, ts, event_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e WHERE f),
a AS (SELECT user_id, grp, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM g GROUP BY 1, 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, grp) AS run, n, epoch_us(start) AS start, epoch_us(stop) AS stop FROM a""")
def w11_islands(spark, sf_dir):
    out = windows.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)
    return out.select("user_id", F.col("run").cast("long").alias("run"), "n", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("stop").cast("timestamp")).alias("stop"))


@query("""WITH e AS (SELECT c_nationkey AS id, c_custkey AS k, (c_custkey * 37 % 23) AS x, lead(c_custkey * 37 % 23) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nx FROM customer)
SELECT id, k, x FROM e WHERE nx IS NULL OR nx = x UNION ALL
SELECT id, k, x + (CASE WHEN nx > x THEN 1 ELSE -1 END) * s AS x FROM e, range(30) t(s) WHERE nx IS NOT NULL AND nx <> x AND s < abs(nx - x)""")
def w12_densify(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("k"), (F.col("c_custkey") * 37 % 23).alias("x"))
    return windows.densify(c, ["id"], "k", "x")


@query("""WITH b AS (SELECT min(epoch_us(ts)) AS lo FROM events), e AS (SELECT user_id % 100 AS k, epoch_us(ts) AS t, max(event_id) AS event_id FROM events GROUP BY 1, 2),
q AS (SELECT o_custkey % 100 AS k, lo + o_orderkey * 1000003 AS t, o_orderkey FROM orders, b)
SELECT q.o_orderkey, e.event_id FROM q ASOF LEFT JOIN e ON q.k = e.k AND q.t >= e.t""")
def s15_as_of(spark, sf_dir):
    """The newest event at or before a time, for each of many times: one sort, no range join."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("event_id").alias("event_id"))
    lo = e.agg(F.min("ts").alias("lo"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(lo))
    o = o.select((F.col("o_custkey") % 100).alias("k"), (F.col("lo") + F.col("o_orderkey") * 1000003).alias("at"), "o_orderkey")
    return windows.as_of(o, e, ["k"], "at", "ts", ["event_id"]).select("o_orderkey", "event_id")


# --- top-k, numbering, random ------------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def k2_order_limit(spark, sf_dir):
    top = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    return top.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


@query(f"""WITH RECURSIVE {ELEVN}, o AS MATERIALIZED (SELECT cid, i, j, h::DOUBLE AS h, row_number() OVER (ORDER BY h DESC, cid) AS r FROM elev),
walk(r, kept) AS (SELECT 0::BIGINT, []::STRUCT(c BIGINT, i BIGINT, j BIGINT, h DOUBLE)[]
  UNION ALL SELECT o.r, CASE WHEN len(list_filter(walk.kept, lambda k: (k.i - o.i) ** 2 + (k.j - o.j) ** 2 < 100)) = 0
    THEN list_append(walk.kept, {{'c': o.cid, 'i': o.i, 'j': o.j, 'h': o.h}}) ELSE walk.kept END FROM walk JOIN o ON o.r = walk.r + 1 WHERE len(walk.kept) < 12),
l AS (SELECT unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS rank FROM (SELECT kept FROM walk ORDER BY r DESC LIMIT 1))
SELECT rank::INT AS rank, k.c AS cid, k.h AS h FROM l""")
def k3_exclusive_top(spark, sf_dir):
    """The best cells at least ten cells apart: a greedy pass over blocks of a distributed top."""
    kept = exclusive_top(elev(spark, sf_dir)[0], "h", "cid", ("i", "j"), 12, 10.0)
    return spark.createDataFrame([(n + 1, r[1], float(r[0])) for n, r in enumerate(kept)], "rank int, cid long, h double")


@query(f"""WITH {ELEV}, p AS (SELECT cid, least(greatest(least((h - 50000) / 50000, (400000 - h) / 100000), 0.0), 1.0) AS a, least(rain / 200.0, 1.0) AS b FROM elev)
SELECT cid, round(exp((2 * ln(0.001 + a) + ln(0.001 + b)) / 3), 6) AS score FROM p""")
def k4_scores(spark, sf_dir):
    """Weighted geometric means of memberships."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    a = rules.trapezoid(F.col("h"), 50000.0, 100000.0, 300000.0, 400000.0)
    b = F.least(F.col("rain") / 200, F.lit(1.0))
    return c.select("cid", r6(F.exp((2 * F.log(0.001 + a) + F.log(0.001 + b)) / 3), "score"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT *, CASE WHEN n > 5 THEN floor(k * 4 / (n - 1.0)) <> floor((k - 1) * 4 / (n - 1.0)) OR k = 0 ELSE true END AS keep FROM r)
SELECT user_id, event_id FROM t WHERE keep""")
def k8_thin(spark, sf_dir):
    """Five rows of each series, evenly spaced, the first and the last among them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    step = lambda k: F.floor(k * 4 / (F.col("n") - 1.0))
    keep = F.when(F.col("n") > 5, (step(F.col("k")) != step(F.col("k") - 1)) | (F.col("k") == 0)).otherwise(True)
    return e.where(keep).select("user_id", "event_id")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS dense FROM customer")
def g9_dense_ids(spark, sf_dir):
    """Dense renumbering by a small table of the distinct values."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    names = c.select("c_mktsegment").distinct()
    names = names.withColumn("dense", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("c_mktsegment")).cast("long") - 1)
    return c.join(F.broadcast(names), "c_mktsegment").select("c_custkey", "dense")  # the market segments


@query("SELECT o_orderkey, round(('0x' || substr(md5('7:' || o_orderkey), 1, 8))::UINTEGER / 4294967296.0::DOUBLE, 9) AS u FROM orders")
def n1_keyed_uniform(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rules.keyed_uniform(7, F.col("o_orderkey")), 9).alias("u"))


@query("""WITH a AS (SELECT o_orderkey, ((o_orderkey::UHUGEINT + 11400714819323198492::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM orders),
b AS (SELECT o_orderkey, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a),
c AS (SELECT o_orderkey, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM b)
SELECT o_orderkey, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE * 2 - 1 AS noise FROM c""")
def n2_lattice_noise(spark, sf_dir):
    """splitmix64 by position; tests also hold it against integer arithmetic."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.lattice_noise(F.col("o_orderkey"), 7).alias("noise"))


@query("""WITH u AS (SELECT o_orderkey, ('0x' || substr(md5('1:' || o_orderkey), 1, 8))::UINTEGER / 4294967296.0::DOUBLE AS a, ('0x' || substr(md5('2:' || o_orderkey), 1, 8))::UINTEGER / 4294967296.0::DOUBLE AS b FROM orders)
SELECT o_orderkey, round(sqrt(1 - (2 * a - 1) ** 2) * cos(2 * pi() * b), 6) AS x, round(sqrt(1 - (2 * a - 1) ** 2) * sin(2 * pi() * b), 6) AS y, round(2 * a - 1, 6) AS z FROM u""")
def n7_random_directions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    z = 2 * rules.keyed_uniform(1, F.col("o_orderkey")) - 1
    phi = 2 * math.pi * rules.keyed_uniform(2, F.col("o_orderkey"))
    r = F.sqrt(1 - z * z)
    return o.select("o_orderkey", r6(r * F.cos(phi), "x"), r6(r * F.sin(phi), "y"), r6(z, "z"))


# --- scalar rules ------------------------------------------------------------------------------

LAT = "radians(-80 + 160.0 * i / (hh - 1))"


def _lat(h):
    return F.radians(-80 + 160.0 * F.col("i") / (h - 1))


@query(f"""WITH {ELEV}, l AS (SELECT cid, h / 100 AS m, {LAT} AS lat FROM elev, dim),
s AS (SELECT *, acos(least(greatest(-tan(lat) * tan(radians(23.44)), -1.0), 1.0)) AS h0 FROM l)
SELECT cid, round(28 - 50 * power(abs(lat) / (pi() / 2), 1.5) - 6.5 * m / 1000, 6) AS t, round(1361 / pi() * (h0 * sin(lat) * sin(radians(23.44)) + cos(lat) * cos(radians(23.44)) * sin(h0)), 4) AS sun FROM s""")
def x1_temperature(spark, sf_dir):
    c, h, _ = elev(spark, sf_dir)
    return c.select("cid", r6(rules.temperature(F.col("h") / 100, _lat(h)), "t"), F.round(rules.day_mean_sun(_lat(h), math.radians(23.44)), 4).alias("sun"))


@query(f"""WITH {ELEV}, l AS (SELECT cid, degrees({LAT}) AS lat FROM elev, dim), a AS (SELECT *, least(greatest((abs(lat) - 25) / 10, 0.0), 1.0) AS p, least(greatest((abs(lat) - 55) / 10, 0.0), 1.0) AS q FROM l),
z AS (SELECT *, -1 + 2 * p * p * (3 - 2 * p) - 2 * q * q * (3 - 2 * q) AS z FROM a)
SELECT cid, round(z / sqrt(1.09), 6) AS zonal, round(0.3 * z * tanh(lat / 10) / sqrt(1.09), 6) AS meridional FROM z""")
def x2_circulation(spark, sf_dir):
    c, h, _ = elev(spark, sf_dir)
    z, m = rules.zonal_wind(F.degrees(_lat(h)))
    return c.select("cid", r6(z, "zonal"), r6(m, "meridional"))


@query(f"WITH {ELEV}, l AS (SELECT cid, abs(degrees({LAT})) AS a FROM elev, dim) SELECT cid, round(greatest(0.2 + 0.8 * exp(-((a / 12) ** 2)) + 0.4 * exp(-(((a - 50) / 12) ** 2)), 0.2), 6) AS prior FROM l")
def x3_latitude_prior(spark, sf_dir):
    c, h, _ = elev(spark, sf_dir)
    return c.select("cid", r6(rules.latitude_prior(F.degrees(_lat(h))), "prior"))


@query(f"""WITH {ELEV}, l AS (SELECT cid, {LAT} AS lat, 10 + h / 50000 AS t, rain / 100 + 0.1 AS p FROM elev, dim),
e AS (SELECT *, greatest(t + 5, 0) / 33 * (1 - 0.477 * (3 * sin(lat) ** 2 - 1) / 2) / 1.2385 AS pet FROM l), a AS (SELECT *, greatest(2.5 * pet / p, 1e-9) AS a FROM e)
SELECT cid, round(pet, 6) AS pet, round(sqrt(a * tanh(1 / a) * (1 - exp(-a))), 6) AS share FROM a""")
def x4_budyko(spark, sf_dir):
    c, h, _ = elev(spark, sf_dir)
    c = with_rain(spark, sf_dir, c)
    pet = rules.pet(10 + F.col("h") / 50000, _lat(h))
    return c.select("cid", r6(pet, "pet"), r6(rules.budyko(2.5 * pet / (F.col("rain") / 100 + 0.1)), "share"))


@query(f"""WITH {ELEV}, l AS (SELECT cid, 28 - 50 * power(abs({LAT}) / (pi() / 2), 1.5) - 6.5 * h / 100000 AS t, least(90 * power(rain / 100, 1.2), 400) AS p FROM elev, dim)
SELECT CASE WHEN t < -12 THEN 1 WHEN t < -2 THEN 2 WHEN t < 5 AND p < 20 THEN 2 WHEN t < 5 THEN 3 WHEN t < 20 AND p < 25 THEN 7 WHEN t < 20 AND p < 60 AND t < 13 THEN 4 WHEN t < 20 AND p < 60 THEN 8
 WHEN t < 20 AND p < 180 THEN 5 WHEN t < 20 THEN 6 WHEN p < 30 THEN 7 WHEN p < 100 THEN 9 WHEN p < 220 THEN 10 ELSE 11 END AS biome, count(*) AS n FROM l GROUP BY 1""")
def x5_biomes(spark, sf_dir):
    c, h, _ = elev(spark, sf_dir)
    c = with_rain(spark, sf_dir, c)
    t = rules.temperature(F.col("h") / 100, _lat(h))
    p = rules.precip_cm(F.col("rain") / 100)
    return c.groupBy(rules.biome(t, p).alias("biome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ELEV}, s AS (SELECT rain / 100 - 0.3 AS s, (h % 1000) / 1000 AS sl, (h % 777) / 777 AS hd FROM elev)
SELECT CASE WHEN s >= 0.5 AND sl <= 0.3 THEN 'alluvium' WHEN s <= 0 OR (s < 0.1 AND hd > 0.6) THEN 'rock' WHEN s < 0.1 THEN 'thin' ELSE 'soil' END AS soil, count(*) AS n, round(avg(0.7 + 0.3 * least(s / 2, 1)), 6) AS factor FROM s GROUP BY 1""")
def x6_soil(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    s = F.col("rain") / 100 - 0.3
    kind = rules.soil_class(s, (F.col("h") % 1000) / 1000, (F.col("h") % 777) / 777)
    return c.groupBy(kind.alias("soil")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(rules.soil_factor(s)), "factor"))


@query(f"""WITH {ELEV}, r AS (SELECT h > 300000 AS belt, zone = '1-URGENT' AS craton, h < 60000 AS sea, rain / 50 AS s, rain > 250 AS lake FROM elev)
SELECT CASE WHEN sea AND s > 1 THEN 'shelf' WHEN lake THEN 'lake' WHEN s > 2 THEN 'alluvium' WHEN belt THEN 'schist' WHEN craton THEN 'gneiss' WHEN sea THEN 'basalt' ELSE 'granite' END AS rock, count(*) AS n FROM r GROUP BY 1""")
def x7_rock(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    kind = rules.rock(F.col("h") > 300000, F.col("zone") == "1-URGENT", F.col("h") < 60000, F.col("rain") / 50, F.col("rain") > 250)
    return c.groupBy(kind.alias("rock")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(2.9 + 0.4 * (1 - exp(-vec_id / 60.0)), 6) AS density FROM embeddings")
def x8_density(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(rules.density_age(F.col("vec_id"), 2.9, 3.3), "density"))


@query(f"WITH t AS (SELECT vec_id, least(vec_id / 500.0, 1.0) AS t FROM embeddings) SELECT vec_id, round((1 - t) ** 4 * (4 * t + 1), 6) AS w FROM t")
def x9_wendland(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(rules.wendland(F.col("vec_id"), 500.0), "w"))


@query(f"WITH {ELEV} SELECT cid, round(greatest(1.0, 4 * power(rain / 50, 0.5)), 6) AS width FROM elev")
def x10_reach_width(spark, sf_dir):
    return with_rain(spark, sf_dir, elev(spark, sf_dir)[0]).select("cid", r6(rules.reach_width(F.col("rain"), 50.0), "width"))


@query(f"""WITH {ELEV}, m AS (SELECT min(h) AS lo, max(h) AS hi FROM elev) SELECT cid, floor((h - lo) / (hi - lo) * 65535 + 0.5)::INT AS code,
floor(least(greatest(ln(1 + rain) / 12, 0.0), 1.0) * 255 + 0.5)::INT AS byte FROM elev, m""")
def x11_codecs(spark, sf_dir):
    """16-bit and log byte codes."""
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    m = c.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return c.crossJoin(F.broadcast(m)).select("cid", rules.quantise16(F.col("h"), F.col("lo"), F.col("hi")).alias("code"), rules.encode_log(F.col("rain")).alias("byte"))


@query(f"""WITH {ELEV}, t AS (SELECT cid, least(greatest(1 - rain / 50 / 8, 0.0), 1.0) AS a, least(greatest(h / 20000 / 20, 0.0), 1.0) AS b, least(greatest(1 - (h % 100) / 100 / 0.4, 0.0), 1.0) AS c FROM elev)
SELECT cid, round(a * a * (3 - 2 * a) * b * b * (3 - 2 * b) * c * c * (3 - 2 * c), 6) AS capacity FROM t""")
def x12_capacity(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    return c.select("cid", r6(rules.lake_capacity(F.col("rain") / 50, F.col("h") / 20000, (F.col("h") % 100) / 100), "capacity"))


@query(f"WITH {ELEV}, c AS (SELECT cid, 20 * (1 - exp(-h / 100000)) AS cut, rain / 20 AS s FROM elev) SELECT cid, round(least(cut, s), 6) AS loose, round(cut - least(cut, s), 6) AS rock FROM c")
def x13_scour(spark, sf_dir):
    c = with_rain(spark, sf_dir, elev(spark, sf_dir)[0])
    loose, solid = rules.scour(F.col("h"), 100000.0, 20.0, F.col("rain") / 20)
    return c.select("cid", r6(loose, "loose"), r6(solid, "rock"))
