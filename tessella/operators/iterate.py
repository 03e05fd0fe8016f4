"""Stateful iteration: a driver loop over declarative steps, with durable states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled
from .grid import D8, corners, scatter


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, change: Column | None = None, old: str = "", tol: float = 0.0, every: int = 3) -> tuple[DataFrame, int]:
    """Apply step up to `rounds` times, materialising every few rounds; with a change expression over
    the new state (which has the old one in column `old`), stop once its greatest is at most tol."""
    for r in range(rounds):
        state = step(state, r)
        if (r + 1) % every == 0 or r + 1 == rounds:
            state = settled(state)
            if change is not None and (state.agg(F.max(change).alias("c")).first()["c"] or 0.0) <= tol:
                return state, r + 1
    return state, rounds


def advect(cells: DataFrame, height: int, width: int, di: Column, dj: Column, dt: float, supply: float, rain: Column, rounds: int) -> DataFrame:
    """Semi-Lagrangian sweeps of moisture m: what arrives is sampled upwind, topped up toward m0, and a
    share falls as rain. cells: cid, i, j, m0. The sources and weights do not change, so they are an edge
    table that is made once."""
    p = cells.select("cid", "m0", rain.alias("share"), (F.col("i") - di * dt).alias("a"), (F.col("j") - dj * dt).alias("b"))
    clamp = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n - 1)))
    p = p.withColumns({"a": clamp("a", height), "b": clamp("b", width)})
    at = corners(p, "a", "b", height, width)
    links = settled(at.join(cells.select("i", "j", F.col("cid").alias("src")), ["i", "j"]).select("cid", "src", "w"))
    fixed = settled(p.select("cid", "m0", "share"))

    def step(state: DataFrame, _: int) -> DataFrame:
        moved = links.join(state.select(F.col("cid").alias("src"), "m"), "src").groupBy("cid").agg(F.sum(F.col("w") * F.col("m")).alias("v"))
        full = moved.join(fixed, "cid").withColumn("v", F.col("v") + supply * (F.col("m0") - F.col("v")))
        return full.select("cid", (F.col("v") * (1 - F.col("share"))).alias("m"), (F.col("v") * F.col("share")).alias("rain"))

    state, _ = iterate(cells.select("cid", F.col("m0").alias("m"), F.lit(0.0).alias("rain")), step, rounds)
    return state


def apply_rows(changes: DataFrame, by: list[str], least: float) -> DataFrame:
    """Serial folds, one for each group: change rows in order of seq, where a taking row takes no more than
    is left above `least` and what it could not take is owed by the giving rows that follow. Order is part
    of the result, so each group is one ordered fold; groups run side by side. changes: by, seq, delta,
    start. Returns by, level, owed."""
    rows = changes.groupBy(*by).agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("s"))
    zero = F.struct(F.col("start").alias("level"), F.lit(0.0).alias("owed"))

    def step(acc: Column, x: Column) -> Column:
        d = x["delta"]
        take = F.least(-d, F.greatest(acc["level"] - least, F.lit(0.0)))
        pay = F.least(F.greatest(d, F.lit(0.0)), acc["owed"])
        return F.when(
            d < 0, F.struct((acc["level"] - take).alias("level"), (acc["owed"] - d - take).alias("owed"))
        ).otherwise(F.struct((acc["level"] + d - pay).alias("level"), (acc["owed"] - pay).alias("owed")))

    return rows.select(*by, F.aggregate("s", zero, step).alias("r")).select(*by, "r.level", "r.owed")


def fold_changes(df: DataFrame, height: str, sediment: str, delta: str) -> DataFrame:
    """Net change: losses take sediment first, then rock; gains are sediment."""
    loose = F.least(F.greatest(-F.col(delta), F.lit(0.0)), F.col(sediment))
    rock = F.greatest(-F.col(delta) - loose, F.lit(0.0))
    return df.withColumns({"_l": loose, "_r": rock}).withColumns(
        {sediment: F.col(sediment) - F.col("_l") + F.greatest(F.col(delta), F.lit(0.0)), height: F.col(height) - F.col("_r")}
    ).drop("_l", "_r")


def grow_cover(cells: DataFrame, cover: str, capacity: str, grow: float, spread: float, kill: float) -> DataFrame:
    """One step of a cellular cover: growth and spread below capacity, dying above it."""
    near = scatter(cells, [cover], D8).where("k >= 0").groupBy("i", "j").agg(F.avg(cover).alias("_near"))
    out = cells.join(near, ["i", "j"], "left")
    x, k = F.col(cover), F.col(capacity)
    up = x + (grow * x + spread * F.coalesce("_near", F.lit(0.0))) * (k - x)
    return out.withColumn(cover, F.least(F.greatest(F.when(x < k, up).otherwise(x - kill * (x - k)), F.lit(0.0)), F.lit(1.0))).drop("_near")


def spherical_kmeans(points: DataFrame, key: str, xyz: list[str], centres: list[tuple], rounds: int) -> tuple[DataFrame, list[tuple]]:
    """Lloyd rounds on the unit sphere from given centres (their number is fixed): points with cluster."""
    def nearest(centres):
        each = [F.struct((2 - 2 * sum(F.col(c) * float(v) for c, v in zip(xyz, p))).alias("d"), F.lit(n).alias("n")) for n, p in enumerate(centres)]
        return F.array_min(F.array(*each))["n"]

    for _ in range(rounds):
        rows = points.groupBy(nearest(centres).alias("n")).agg(*[F.sum(c).alias(c) for c in xyz]).collect()  # one for each centre
        new = {r["n"]: [r[c] for c in xyz] for r in rows}
        centres = [tuple(v / (sum(u * u for u in new[n]) ** 0.5 or 1.0) for v in new[n]) if n in new else c for n, c in enumerate(centres)]
    return points.withColumn("cluster", nearest(centres)), centres
