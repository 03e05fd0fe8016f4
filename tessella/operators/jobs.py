"""Jobs over overlapping windows of a grid: dealing out, colouring, blending, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import smoothstep


def windows(cells: DataFrame, size: int, step: int) -> DataFrame:
    """Cells once for each window (ti, tj) that holds them, with edge, their distance in cells to the
    window's outside (1 at its border). Windows start at multiples of step and are size wide."""
    def starts(c: str) -> Column:
        last = F.floor(F.col(c) / step)
        first = F.greatest(F.floor((F.col(c) - size) / step) + 1, F.lit(0))
        return F.explode(F.sequence(first.cast("long"), last.cast("long")))

    out = cells.select("*", starts("i").alias("ti")).select("*", starts("j").alias("tj"))
    a, b = F.col("i") - F.col("ti") * step, F.col("j") - F.col("tj") * step
    return out.withColumn("edge", F.least(a + 1, size - a, b + 1, size - b))


def blended(rows: DataFrame, value: str, feather: int) -> DataFrame:
    """(i, j, value): what several windows gave for a cell, weighted by smoothstep(edge / (feather + 1))."""
    w = smoothstep(F.col("edge") / float(feather + 1))
    return rows.withColumn("_w", w).groupBy("i", "j").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def run_windows(cells: DataFrame, size: int, step: int, feather: int, value: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A job on every window and the blend of what they give. The job takes all windows' rows and keeps
    (ti, tj, i, j, edge, value): grouped expressions, or applyInPandas by ("ti", "tj")."""
    return blended(job(windows(cells, size, step)), value, feather)


def colour(ti: Column, tj: Column) -> Column:
    """0 to 3 by parities: windows of one colour do not overlap if size is at most twice the step."""
    return (ti % 2) * 2 + tj % 2


def pending(jobs: DataFrame, written: DataFrame, by: list[str], cells: str) -> DataFrame:
    """Jobs whose cells are not all among the written rows: what a restart still has to do."""
    done = written.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return jobs.join(done, by, "left").where(F.coalesce("_n", F.lit(0)) < F.col(cells)).drop("_n")


#: States of a job that is not over.
LIVE = ("queued", "running")


def submitted(jobs: DataFrame, asked: DataFrame, order: str) -> DataFrame:
    """The asked jobs (kind, world, title and others) that are queued: the first, by `order`, of each kind, world
    and title (the kind where it is null), unless jobs holds a live one. jobs: kind, world, title, state."""
    keys = ["kind", "world", "title"]
    first = Window.partitionBy(*keys).orderBy(order)
    new = asked.withColumn("title", F.coalesce("title", "kind")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    live = jobs.where(F.col("state").isin(*LIVE)).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [new[k].eqNullSafe(live[f"_{k}"]) for k in keys]
    return new.join(live, same[0] & same[1] & same[2], "left_anti").withColumn("state", F.lit("queued"))


def progress(levels: DataFrame, by: list[str]) -> DataFrame:
    """by, work, done and share of each plan's levels: cells, ratio, iterations and the iterations done. A level's
    work is its cells times its iterations; a fine one (a ratio of 512 and more) weighs 1.6 times."""
    side = F.col("cells") * F.col("ratio")
    each = (side * side * F.when(F.col("ratio") >= 512, 1.6).otherwise(1.0)).cast("double")
    out = levels.groupBy(*by).agg(F.sum(each * F.col("iterations")).alias("work"), F.sum(each * F.least("done", "iterations")).alias("done"))
    return out.withColumn("share", F.when(F.col("work") > 0, F.col("done") / F.col("work")).otherwise(F.lit(1.0)))
