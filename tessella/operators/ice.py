"""Ice: balance summed down a surface, the shape of a sheet, and what a glacial cycle cuts and leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled
from .grid import SQRT2, edges


def spread(cells: DataFrame, most: int = 10_000, every: int = 4) -> DataFrame:
    """(cid, acc): a balance summed down a surface. cells: cid, i, j, z, w, ice.

    A cell holds max(0, inflow + w). Ice passes all of it to its lower neighbours by their slopes; bare
    ground keeps it. Slopes lead down, so repeated sweeps over the fixed table of shares end exactly
    after as many sweeps as the longest way down has steps.
    """
    down = edges(cells, ["z"], own=["z", "ice"]).where(F.col("ice") & (F.col("z") > F.col("n_z")))
    down = down.withColumn("s", (F.col("z") - F.col("n_z")) / F.when(F.col("k") % 2 == 1, SQRT2).otherwise(1.0))
    total = down.groupBy("cid").agg(F.sum("s").alias("t"))
    shares = settled(down.join(total, "cid").select("cid", "nid", (F.col("s") / F.col("t")).alias("share")))
    own = settled(cells.select("cid", F.col("w").cast("double").alias("w")))
    state = own.select("cid", "w", F.greatest("w", F.lit(0.0)).alias("acc"))
    for r in range(1, most + 1):
        sent = shares.join(state.select("cid", "acc"), "cid").groupBy(F.col("nid").alias("cid")).agg(F.sum(F.col("acc") * F.col("share")).alias("_in"))
        held = F.greatest(F.col("w") + F.coalesce("_in", F.lit(0.0)), F.lit(0.0))
        new = state.join(sent, "cid", "left").select("cid", "w", held.alias("acc"), F.col("acc").alias("old"))
        if r % every == 0:
            new = settled(new)
            # sums of doubles have no fixed order: the last digits may differ from sweep to sweep
            if new.where(F.abs(F.col("acc") - F.col("old")) > 1e-9 * (1 + F.abs("acc"))).isEmpty():
                return new.select("cid", "acc")
        state = new.drop("old")
    raise RuntimeError("the balance did not settle")


def sheet(d: Column, bed: Column, h0: float) -> tuple[Column, Column]:
    """(surface, thickness) of plastic ice at a distance d from its margin: sqrt(2 h0 d) above the smoothed
    ground, bare where the ground is higher."""
    top = F.greatest(bed, F.sqrt(2 * h0 * F.greatest(d, F.lit(0.0))))
    return top, top - bed


def carve(cells: DataFrame, rate: float, most: float, saturation: float, left: float, deposit: float) -> DataFrame:
    """(cid, cut, placed, pending): one glacial cycle. cells: cid, ice, margin (flags), q, hardness, taper.

    Ice lowers its bed by rate sqrt(q / saturation) (1 - hardness / 2) taper, at most `most`. The share
    `left` of all that was cut goes to the margin by its q, at most `deposit` a cell; the rest is pending.
    """
    cut = F.when(F.col("ice"), F.least(rate * F.sqrt(F.greatest("q", F.lit(0.0)) / saturation) * (1 - 0.5 * F.col("hardness")) * F.col("taper"), F.lit(most)))
    weight = F.when(F.col("margin"), F.greatest("q", F.lit(0.0)) + 1e-6)
    out = cells.select("cid", F.coalesce(cut, F.lit(0.0)).alias("cut"), F.coalesce(weight, F.lit(0.0)).alias("_w"))
    sums = out.agg(F.sum("cut").alias("_cut"), F.sum("_w").alias("_all"))  # one row
    share = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all") * F.col("_cut") * left).otherwise(0.0)
    placed = F.least(share, F.lit(deposit))
    return out.crossJoin(F.broadcast(sums)).select("cid", "cut", placed.alias("placed"), (share - placed).alias("pending"))
