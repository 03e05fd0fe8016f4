"""Ordered operators over series, chains and rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import running


def running_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, half: int, name: str = "mean") -> DataFrame:
    """Mean over the clamped frame of `half` rows on both sides."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(name, F.avg(value).over(w))


def running_min(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "low") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(value).over(w))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of rows whose flag holds: by, run, n and the first and last order values."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_f", flag).withColumn("_turn", (F.coalesce(F.lag("_f").over(w), F.lit(False)) != F.col("_f")).cast("int"))
    marked = marked.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.where("_f").groupBy(*by, "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop")
    )
    rank = Window.partitionBy(*by).orderBy("_run")
    return out.withColumn("run", F.row_number().over(rank)).drop("_run")


def ema(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str = "ema") -> DataFrame:
    """m = (1 - alpha) m + alpha x along each series, from the first value: a fold over the series'
    ordered values, each series one array."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_s"))
    empty = F.expr("cast(array() as array<double>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, x[value]).otherwise((1 - alpha) * last + alpha * x[value])))

    out = rows.withColumn("_m", F.aggregate("_s", empty, step))
    pairs = F.arrays_zip("_s", "_m")
    return out.select(*by, F.explode(pairs).alias("_p")).select(*by, *[F.col(f"_p._s.{c}").alias(c) for c in [*order, value]], F.col("_p._m").alias(name))


def catmull_rom(points: DataFrame, by: Sequence[str], order: str, xs: Sequence[str], steps: int) -> DataFrame:
    """Points of a spline through the rows of each chain: by, order, step and the coordinates; end
    points stand in for their missing neighbours; the last row comes once."""
    w = Window.partitionBy(*by).orderBy(order)
    out = points
    for c in xs:
        out = out.withColumns(
            {
                f"_{c}0": F.coalesce(F.lag(c).over(w), F.col(c)),
                f"_{c}2": F.coalesce(F.lead(c).over(w), F.col(c)),
                f"_{c}3": F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w), F.col(c)),
            }
        )
    out = out.withColumn("_last", F.lead(order).over(w).isNull())
    out = out.withColumn("step", F.explode(F.when(F.col("_last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    t = F.col("step") / float(steps)
    made = []
    for c in xs:
        p0, p1, p2, p3 = F.col(f"_{c}0"), F.col(c), F.col(f"_{c}2"), F.col(f"_{c}3")
        made.append(
            (0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)).alias(c)
        )
    return out.select(*by, order, "step", *made)


def ring_area(ring: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Signed area of each closed ring."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (x, y))
    out = ring.withColumns({"_x": nx, "_y": ny})
    return out.groupBy(*by).agg((F.sum(F.col(x) * F.col("_y") - F.col("_x") * F.col(y)) / 2).alias("area"))


def corners_only(ring: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """The ring without points that lie on the line of their neighbours (cyclic)."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ring
    for c in (x, y):
        out = out.withColumns(
            {f"_p{c}": F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), f"_n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole))}
        )
    turn = (F.col(x) - F.col(f"_p{x}")) * (F.col(f"_n{y}") - F.col(y)) - (F.col(y) - F.col(f"_p{y}")) * (F.col(f"_n{x}") - F.col(x))
    return out.where(turn != 0).select(*ring.columns)


def chain_lengths(chain: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Summed step lengths along each chain."""
    w = Window.partitionBy(*by).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return chain.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def densify(chain: DataFrame, by: Sequence[str], order: str, x: str) -> DataFrame:
    """Every whole value between a row's x and the next row's, both ways; the last row as it is."""
    w = Window.partitionBy(*by).orderBy(order)
    out = chain.withColumn("_n", F.lead(x).over(w))
    sign = F.signum(F.col("_n") - F.col(x)).cast("long")
    steps = F.when(F.col("_n").isNull() | (sign == 0), F.array(F.col(x))).otherwise(F.sequence(F.col(x), F.col("_n") - sign, sign))
    return out.select(*by, order, F.explode(steps).alias(x))


def lookup_steps(df: DataFrame, x: str, steps: Sequence[tuple[float, float]], name: str) -> DataFrame:
    """The value of the last step at or below x; null below the first."""
    out = F.lit(None).cast("double")
    for at, value in sorted(steps):
        out = F.when(F.col(x) >= at, F.lit(value)).otherwise(out)
    return df.withColumn(name, out)


def spawn(df: DataFrame, weight: str, key: str, n: int) -> DataFrame:
    """How many of n evenly spaced draws of the cumulative weight fall on each row (in order of key):
    key (a number, unique) and draws, rows without a draw left out. Systematic sampling, with no random
    state; running sums in two levels."""
    out = running(df, key, F.col(weight), ())
    out = out.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("_t"))))  # one row
    cut = lambda c: F.ceil(F.round(c / F.col("_t") * n - 0.5, 9))
    return out.select(key, (cut(F.col("_cw")) - cut(F.col("_cw") - F.col(weight))).cast("long").alias("draws")).where("draws > 0")


def as_of(queries: DataFrame, states: DataFrame, by: Sequence[str], at: str, stamp: str, values: Sequence[str]) -> DataFrame:
    """Each query with the newest state at or before it: one sort of both together, no range join."""
    q = queries.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_q"), *[F.lit(None).alias(v) for v in values], *[c for c in queries.columns if c not in (*by, at)])
    s = states.select(*by, F.col(stamp).alias("_t"), F.lit(0).alias("_q"), *values)
    every = q.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumns({**{v: F.last(v, ignorenulls=True).over(w) for v in values}})
    return out.where("_q = 1").withColumnRenamed("_t", at).drop("_q")
