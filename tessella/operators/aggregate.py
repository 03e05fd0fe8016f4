"""Aggregations: exact and weighted quantiles, modes, histograms, pyramids, ledgers, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of value that a running sum over all rows is done in, so that no task sorts all rows.
BUCKETS = 256


def running(df: DataFrame, value: str, weight: Column, by: Sequence[str]) -> DataFrame:
    """df with _cw, the running weight in order of value within `by` (equal values in one step), in
    two levels: sums of value buckets, then a window within each."""
    part = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if by else df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = df.join(F.broadcast(part), [*by]) if by else df.crossJoin(F.broadcast(part))  # one row, or one for each group
    span = F.col("_hi") - F.col("_lo")
    bucket = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / span * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
    out = out.withColumns({"_b": bucket, "_w": weight}).drop("_lo", "_hi")
    sums = out.groupBy(*by, "_b").agg(F.sum("_w").alias("_s"))
    ahead = Window.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    out = out.join(F.broadcast(sums), [*by, "_b"])
    w = Window.partitionBy(*by, "_b").orderBy(value)
    return out.withColumn("_cw", F.col("_ahead") + F.sum("_w").over(w)).drop("_b", "_ahead")


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The least value with cumulative weight >= q of the total, for each q and group."""
    run = running(df.where(F.col(value).isNotNull()), value, F.col(weight), by)
    total = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(weight).alias("_t"))
    met = run.join(F.broadcast(total), [*by]) if by else run.crossJoin(F.broadcast(total))
    outs = [F.min(F.when(F.col("_cw") >= q * F.col("_t"), F.col(value))).alias(f"q{round(q * 100)}") for q in qs]
    return met.groupBy(*by).agg(*outs)


def order_statistic(df: DataFrame, value: str, rank: int) -> DataFrame:
    """The value with `rank` smaller ones before it (ties counted), exactly."""
    run = running(df, value, F.lit(1), ())
    return run.where(F.col("_cw") >= rank + 1).agg(F.min(value).alias(value))


def interpolated_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the quantile of a column, linear between the two order statistics beside q (n - 1)."""
    n = df.count()
    at = q * (n - 1) if n else 0.0
    low = int(at)
    a = order_statistic(df, value, low).withColumnRenamed(value, "_a")
    b = order_statistic(df, value, min(low + 1, max(n - 1, 0))).withColumnRenamed(value, "_b")
    return a.crossJoin(F.broadcast(b)).select((F.col("_a") + (at - low) * (F.col("_b") - F.col("_a"))).alias(name))


def hold_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """df with `value` shifted so that about `share` of the rows are at or above zero: the level is the
    order statistic rows - round(share rows), rounding half to even."""
    n = df.count()
    above = round(share * n)
    if above <= 0 or above >= n:
        at = df.agg((F.max(value) + 1).alias("_level") if above <= 0 else F.min(value).alias("_level"))
    else:
        at = order_statistic(df, value, n - above).withColumnRenamed(value, "_level")
    return df.crossJoin(F.broadcast(at)).withColumn(value, F.col(value) - F.col("_level")).drop("_level")


def mode(df: DataFrame, by: Sequence[str], value: str, ties: str = "least") -> DataFrame:
    """The most frequent value of each group and its count; ties to the least or the greatest."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if ties == "least":
        best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value)))
    else:
        best = F.max(F.struct(F.col("n").alias("m"), F.col(value)))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{value}").alias(value), F.abs("_b.m").alias("n"))


def histogram(df: DataFrame, x: Column, width: float) -> DataFrame:
    """bin, n and tail (rows in this bin or above)."""
    h = df.groupBy(F.floor(x / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("bin").desc())  # one row for each bin
    return h.withColumn("tail", F.sum("n").over(w))


def tail_threshold(hist: DataFrame, width: float, share: float) -> DataFrame:
    """The x above which a share of the rows lies, by linear interpolation in the bin that crosses it."""
    total = F.max("tail").over(Window.partitionBy(F.lit(0)))
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    out = hist.withColumns({"t": share * total, "next_tail": F.coalesce(F.lead("tail").over(w), F.lit(0))})
    out = out.where((F.col("tail") > F.col("t")) & (F.col("next_tail") <= F.col("t")))
    part = (F.col("tail") - F.col("t")) / (F.col("tail") - F.col("next_tail"))
    return out.select(((F.col("bin") + part) * width).alias("threshold"))


def blocks(cells: DataFrame, k: int, aggs: Sequence[Column], i: str = "i", j: str = "j") -> DataFrame:
    """k by k blocks of a grid, aggregated."""
    return cells.groupBy(F.floor(F.col(i) / k).alias("bi"), F.floor(F.col(j) / k).alias("bj")).agg(*aggs)


def pyramid(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """lod, bi, bj, n, mean: each level from sums of the one below, so that the cells are read once."""
    level = cells.groupBy(F.floor(F.col("i") / 2).alias("bi"), F.floor(F.col("j") / 2).alias("bj")).agg(
        F.count(value).alias("n"), F.sum(value).alias("s")
    )
    out = level.withColumn("lod", F.lit(1))
    for lod in range(2, levels + 1):
        level = level.groupBy(F.floor(F.col("bi") / 2).alias("bi"), F.floor(F.col("bj") / 2).alias("bj")).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s")
        )
        out = out.unionByName(level.withColumn("lod", F.lit(lod)))
    return out.select("lod", "bi", "bj", "n", (F.col("s") / F.col("n")).alias("mean"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties at their average rank."""
    def ranked(c: str) -> DataFrame:
        by = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        run = running(by, c, F.col("_n"), ())
        return run.select(c, (F.col("_cw") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))

    met = df.join(ranked(a), a).join(ranked(b), b)
    return met.agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, lo, hi, mean, std (population), without nulls and NaN; one pass, then unpivoted."""
    ok = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    row = df.agg(*[f(ok[c]).alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{n}").alias(n) for n in ("n", "lo", "hi", "mean", "std")]) for c in columns]))
    return row.select(each.alias("x")).select("x.*")


def ledger(entries: DataFrame, key: str, debit: str, credit: str) -> DataFrame:
    """Double-entry totals by process, and what does not balance."""
    out = entries.groupBy(key).agg(F.sum(debit).alias("debit"), F.sum(credit).alias("credit"))
    return out.withColumn("residual", F.col("debit") - F.col("credit"))


def hypsometric_balance(cells: DataFrame, lake: str, z: str, need: str, inflow: DataFrame) -> DataFrame:
    """The level at which each lake's demand meets its inflow: cells by height, running demand, the
    height of the first cell that covers the inflow; beyond the last it overflows at the spill."""
    w = Window.partitionBy(lake).orderBy(z, "cid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("_cum", F.sum(need).over(w)).join(inflow, lake)
    out = run.groupBy(lake).agg(
        F.min(F.when(F.col("_cum") >= F.col("inflow"), F.col(z))).alias("level"),
        F.max(z).alias("top"),
        F.min(z).alias("floor"),
        F.max("_cum").alias("total"),
        F.first("inflow").alias("inflow"),
    )
    level = F.when(F.col("inflow") <= 0, F.col("floor")).otherwise(F.coalesce("level", "top"))
    return out.select(lake, level.alias("level"), F.greatest(F.col("inflow") - F.col("total"), F.lit(0.0)).alias("outflow"))
