"""Grids: dense cells keyed (i, j), and their neighbour joins.

Neighbour values come by scattering: each cell sends its value to the cells it is a neighbour of and
one aggregation by target puts them side by side. That is one shuffle with map-side combining, and
no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo

#: Neighbour codes 0 to 7 as (di, dj).
D8 = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
SQRT2 = 2**0.5


def d8_length(k: Column) -> Column:
    return F.when(k % 2 == 1, F.lit(SQRT2)).otherwise(F.lit(1.0))


def scatter(cells: DataFrame, values: Sequence[str], offsets: Sequence[tuple[int, int]], i: str = "i", j: str = "j") -> DataFrame:
    """(i, j, k, values): the values that cell (i, j) has at its offset number k; k -1 is its own."""
    every = [(-1, 0, 0), *((k, di, dj) for k, (di, dj) in enumerate(offsets))]
    to = F.explode(
        F.array(*[F.struct((F.col(i) - di).alias("i"), (F.col(j) - dj).alias("j"), F.lit(k).alias("k")) for k, di, dj in every])
    )
    return cells.select(to.alias("_t"), *values).select("_t.i", "_t.j", "_t.k", *values)


def stencil(cells: DataFrame, values: Sequence[str], offsets: Sequence[tuple[int, int]] = D8, keep: Sequence[str] = ()) -> DataFrame:
    """Cells with v_0 .. v_n, the values at each offset (null outside the grid), beside their own."""
    kept = [*dict.fromkeys([*keep, *values])]
    sent = scatter(cells, kept, offsets)
    own = [F.max(F.when(F.col("k") == -1, F.col(c))).alias(c) for c in kept]
    near = [F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}_{k}") for v in values for k in range(len(offsets))]
    here = F.max((F.col("k") == -1).cast("int")).alias("_here")
    return sent.groupBy("i", "j").agg(*own, *near, here).where("_here = 1").drop("_here")


def focal(cells: DataFrame, value: str, radius: int, how: str, name: str) -> DataFrame:
    """(i, j, name): sum, min, max, avg or count over the square window of a radius, clamped at the
    border. Separable, two passes of running windows: rows of a column, then columns of a row."""
    fn = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.sum, "count": F.count}[how]
    w1 = Window.partitionBy("i").orderBy("j").rangeBetween(-radius, radius)
    w2 = Window.partitionBy("j").orderBy("i").rangeBetween(-radius, radius)
    second = F.sum if how in ("sum", "avg", "count") else fn
    out = cells.select("i", "j", fn(value).over(w1).alias("_a"), F.count(F.lit(1)).over(w1).alias("_n"))
    out = out.select("i", "j", second("_a").over(w2).alias(name), F.sum("_n").over(w2).alias("_n"))
    return out.select("i", "j", (F.col(name) / F.col("_n") if how == "avg" else F.col(name)).alias(name))


def edges(cells: DataFrame, values: Sequence[str], offsets: Sequence[tuple[int, int]] = D8, own: Sequence[str] = ()) -> DataFrame:
    """One row for each cell and neighbour: cid, own columns, k, nid, n_<value>. An equi-join on the
    neighbour's key."""
    near = F.explode(F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(offsets)]))
    left = cells.select("cid", *[c for c in own if c != "cid"], near.alias("_t"))
    left = left.select("cid", *[c for c in own if c != "cid"], F.col("_t.i").alias("ni"), F.col("_t.j").alias("nj"), F.col("_t.k").alias("k"))
    right = cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("cid").alias("nid"), *[F.col(v).alias(f"n_{v}") for v in values])
    return left.join(right, ["ni", "nj"]).drop("ni", "nj")


def steepest(cells: DataFrame, height: str = "h") -> DataFrame:
    """(cid, i, j, code, down): the steepest strictly lower neighbour, the lowest code of equals; code
    255 and down = cid without one."""
    wide = stencil(cells, [height], keep=["cid"])
    slope = [
        F.struct(((F.col(height) - F.col(f"{height}_{k}")) / (SQRT2 if k % 2 else 1.0)).alias("s"), F.lit(-k).alias("k")) for k in range(8)
    ]
    lower = F.filter(F.array(*slope), lambda x: x["s"] > 0)
    best = F.array_max(lower)
    code = F.when(F.size(lower) > 0, -best["k"]).otherwise(F.lit(255))
    out = wide.select("cid", "i", "j", code.alias("code"))
    di = F.element_at(F.array(*[F.lit(d[0]) for d in D8]), F.col("code") + 1)
    dj = F.element_at(F.array(*[F.lit(d[1]) for d in D8]), F.col("code") + 1)
    target = cells.select(F.col("cid").alias("down"), F.col("i").alias("_ti"), F.col("j").alias("_tj"))
    ti = F.col("i") + F.when(F.col("code") < 8, di).otherwise(0)
    tj = F.col("j") + F.when(F.col("code") < 8, dj).otherwise(0)
    return out.withColumns({"_ti": ti, "_tj": tj}).join(target, ["_ti", "_tj"]).select("cid", "i", "j", "code", "down")


def sphere_cells(spark: SparkSession, n: int) -> DataFrame:
    """cid, face, i, j, u, v and the unit vector x, y, z of a cube-sphere of n cells per edge."""
    cells = spark.range(6 * n * n).withColumnRenamed("id", "cid")
    face = F.floor(F.col("cid") / (n * n)).cast("int")
    cells = cells.select("cid", face.alias("face"), (F.floor(F.col("cid") / n) % n).cast("long").alias("i"), (F.col("cid") % n).alias("j"))
    cells = cells.withColumns({"u": (F.col("i") + 0.5) / n, "v": (F.col("j") + 0.5) / n})
    x, y, z = geo.to_sphere(F.col("face"), F.col("u"), F.col("v"))
    return cells.withColumns({"x": x, "y": y, "z": z})


def owner(face: Column, i: Column, j: Column, n: int) -> tuple[Column, Column, Column]:
    """(face, i, j) of the cell that lies at (i, j) of a face's plane, also beyond its edges."""
    p = geo.to_sphere(face, (i + 0.5) / n, (j + 0.5) / n)
    at = geo.face_of(p)
    u, v = geo.project_to_face(at, p)
    return at, geo.cell_of(u, n), geo.cell_of(v, n)


def sphere_neighbours(cells: DataFrame, n: int) -> DataFrame:
    """(cid, k, nid): neighbours across cube edges too, by way of the sphere; corners repeat a cell."""
    near = F.explode(F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(D8)]))
    out = cells.select("cid", "face", near.alias("t"))
    f, i, j = owner(F.col("face"), F.col("t.i"), F.col("t.j"), n)
    out = out.select("cid", "t.k", f.alias("f"), i.alias("a"), j.alias("b"))
    return out.select("cid", "k", ((F.col("f") * n + F.col("a")) * n + F.col("b")).cast("long").alias("nid"))


def upsample(cells: DataFrame, r: int) -> DataFrame:
    """Every cell as r by r cells of a grid r times finer."""
    part = F.explode(F.sequence(F.lit(0), F.lit(r * r - 1)))
    out = cells.withColumn("_s", part)
    return out.withColumns({"i": F.col("i") * r + F.floor(F.col("_s") / r), "j": F.col("j") * r + F.col("_s") % r}).drop("_s")


def corners(points: DataFrame, x: str, y: str, height: int, width: int) -> DataFrame:
    """Points with the four cells around them (clamped) and bilinear weights, a row for each."""
    i0, j0 = F.floor(x), F.floor(y)
    s, t = F.col(x) - i0, F.col(y) - j0
    four = F.explode(
        F.array(
            *[
                F.struct(
                    F.least(F.greatest(i0 + a, F.lit(0)), F.lit(height - 1)).cast("long").alias("i"),
                    F.least(F.greatest(j0 + b, F.lit(0)), F.lit(width - 1)).cast("long").alias("j"),
                    ((s if a else 1 - s) * (t if b else 1 - t)).alias("w"),
                )
                for a in (0, 1)
                for b in (0, 1)
            ]
        )
    )
    return points.select("*", four.alias("_c")).select(*points.columns, "_c.i", "_c.j", "_c.w")


def _lagrange(t: Column) -> list[Column]:
    """Cubic weights on the nodes -1, 0, 1, 2."""
    return [
        -t * (t - 1) * (t - 2) / 6,
        (t + 1) * (t - 1) * (t - 2) / 2,
        -(t + 1) * t * (t - 2) / 2,
        (t + 1) * t * (t - 1) / 6,
    ]


def cubic_nodes(points: DataFrame, x: str, y: str, height: int, width: int) -> DataFrame:
    """As corners, with the sixteen cells and weights of cubic Lagrange interpolation."""
    i0, j0 = F.floor(x), F.floor(y)
    a, b = _lagrange(F.col(x) - i0), _lagrange(F.col(y) - j0)
    nodes = F.explode(
        F.array(
            *[
                F.struct(
                    F.least(F.greatest(i0 + p - 1, F.lit(0)), F.lit(height - 1)).cast("long").alias("i"),
                    F.least(F.greatest(j0 + q - 1, F.lit(0)), F.lit(width - 1)).cast("long").alias("j"),
                    (a[p] * b[q]).alias("w"),
                )
                for p in range(4)
                for q in range(4)
            ]
        )
    )
    return points.select("*", nodes.alias("_c")).select(*points.columns, "_c.i", "_c.j", "_c.w")


def sample(points: DataFrame, cells: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """Weighted sums of a column over the cells that corners or cubic_nodes gave. The nodes are up to sixteen
    times their points, which a plan's sizes do not tell: neither side may go through the driver."""
    met = points.hint("merge").join(cells.select("i", "j", value), ["i", "j"])
    return met.groupBy(*key).agg(F.sum(F.col("w") * F.col(value)).alias(value))
