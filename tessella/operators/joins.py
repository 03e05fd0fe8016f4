"""Spatial joins over point clouds: nearest, k nearest, within a radius, with kernels.

Points go to cells of a grid as wide as the radius; the query side looks into its own cell and those
beside it, so that every join is an equi-join. Where no radius bounds the search (k nearest in many
dimensions), the smaller side is a stated query set that is sent to all rows, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query set that one pass sends to all rows.
BLOCK = 4096
#: Rows that meet a block at once, pairs whose distances are summed at once, and the bound of a null distance.
ROWS, PAIRS, FAR = 1024, 1 << 18, 1e300


def distance2(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + (F.col(x) - F.col(y)) * (F.col(x) - F.col(y))
    return out


def within(left: DataFrame, right: DataFrame, a: Sequence[str], b: Sequence[str], radius: float) -> DataFrame:
    """All pairs at a distance of at most radius, with d2. Column names of the sides must differ."""
    cell = [F.floor(F.col(c) / radius) for c in a]
    near = F.explode(
        F.array(
            *[
                F.struct(*[(c + o).alias(f"_c{n}") for n, (c, o) in enumerate(zip(cell, offset))])
                for offset in itertools.product((-1, 0, 1), repeat=len(a))
            ]
        )
    )
    q = left.select("*", near.alias("_n")).select(*left.columns, *[F.col(f"_n._c{n}") for n in range(len(a))])
    p = right.select("*", *[F.floor(F.col(c) / radius).alias(f"_c{n}") for n, c in enumerate(b)])
    keys = [f"_c{n}" for n in range(len(a))]
    met = q.join(p, keys).drop(*keys).withColumn("d2", distance2(a, b))
    return met.where(F.col("d2") <= radius * radius)


def nearest(pairs: DataFrame, key: str, other: str, k: int = 1) -> DataFrame:
    """The k nearest of each key among pairs with d2, ties by the least id; rank from 1."""
    if k == 1:
        best = pairs.groupBy(key).agg(F.min(F.struct("d2", other)).alias("_b"))
        return best.select(key, F.col(f"_b.{other}").alias(other), F.col("_b.d2").alias("d2"), F.lit(1).alias("rank"))
    w = Window.partitionBy(key).orderBy("d2", other)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; those that are null, hold a null or have another width are NaN."""
    out = np.full((len(column), width), np.nan)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    out[good] = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out[np.isnan(out).any(1)] = np.nan
    return out


def _least(q: np.ndarray, d2: np.ndarray, key: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Indices of the rows that can be among a query's k nearest once distances are rounded: of one distance the
    k least keys, and no distance beyond the k-th by more than the margin."""
    if not len(q):
        return np.zeros(0, np.int64)
    order = np.lexsort((key, d2, q))
    a, b = q[order], d2[order]
    at = np.arange(len(a))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    order = order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]
    a, b = q[order], d2[order]
    edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    size = np.diff(edge)
    return order[b <= np.repeat(b[edge[:-1] + np.minimum(k, size) - 1], size) + margin]


def nearest_vectors(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """The k nearest points of each query vector (not itself), q, key, d2, rank; distances rounded, ties
    by key. Keys are whole numbers; those that are null are left out. A vector that is null, holds a null or has
    another length than the first query has a null distance, which comes last.

    The query set is sent to all rows in blocks of bounded size. A product of matrices bounds the distances; those
    that can be among the k best of a task are then summed element by element, in order, and all else goes there,
    so what is shuffled is about k rows for each query and task."""
    spark = points.sparkSession
    queries = queries.where(F.col(key).isNotNull())
    rows = points.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    margin = 2 * 10.0**-digits
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        got = part.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).toArrow()
        lengths = got.column("v").combine_chunks().value_lengths().drop_null() if got.num_rows else []
        width = lengths[0].as_py() if len(lengths) else 0
        sent = spark.sparkContext.broadcast((got.column("q").to_numpy(), _matrix(got.column("v"), width) if got.num_rows else np.zeros((0, 0)), width))

        def run(batches, sent=sent):
            ids, made, width = sent.value
            m = len(ids)
            blank = np.isnan(made).any(1) if width else np.ones(m, bool)
            own = np.where(np.isnan(made), 0.0, made)
            q2 = (own * own).sum(1)
            best = np.full((k, m), np.inf)
            held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for batch in batches:
                for lo in range(0, batch.num_rows if m else 0, ROWS):
                    part = batch.slice(lo, ROWS)
                    p = part.column(0).to_numpy()
                    x = _matrix(part.column(1), width)
                    null = np.isnan(x).any(1) if width else np.ones(len(p), bool)
                    x = np.where(np.isnan(x), 0.0, x)
                    x2 = (x * x).sum(1)
                    d = x2[:, None] + q2 - 2 * (x @ own.T)
                    np.maximum(d, 0, out=d)
                    d[null] = d[:, blank] = FAR
                    for r in np.flatnonzero(np.isin(p, ids)):
                        d[r, ids == p[r]] = np.inf
                    best = np.partition(np.concatenate([best, np.partition(d, min(k, len(p)) - 1, axis=0)[:k]]), k - 1, axis=0)[:k]
                    slack = margin + 1e-12 * (q2 + x2.max())
                    r, c = np.nonzero((d <= best[k - 1] + slack) & (d < np.inf))
                    for a in range(0, len(r), PAIRS):
                        rr, cc = r[a : a + PAIRS], c[a : a + PAIRS]
                        exact = np.zeros(len(rr))
                        for e in range(width):
                            gap = x[rr, e] - own[cc, e]
                            exact += gap * gap
                        exact[null[rr] | blank[cc]] = np.inf
                        held.append((cc, exact, p[rr]))
                        if sum(len(h[0]) for h in held) > PAIRS:
                            held = [_kept(held)]
            cc, exact, p = _kept(held)
            far = np.isinf(exact)
            yield pa.RecordBatch.from_arrays([pa.array(ids[cc]), pa.array(p), pa.array(np.where(far, 0.0, exact), mask=far)], names=["q", key, "d2"])

        def _kept(held):
            all_ = [np.concatenate(c) for c in zip(*held)]
            keep = _least(*all_, k, margin)
            return tuple(c[keep] for c in all_)

        met = rows.mapInArrow(run, f"q long, `{key}` long, d2 double").withColumn("d2", F.round("d2", digits))
        out = met if out is None else out.unionByName(met)
    w = Window.partitionBy("q").orderBy(F.col("d2").asc_nulls_last(), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kernel_mean(pairs: DataFrame, key: str, value: str, kernel: Column, name: str) -> DataFrame:
    """Normalised kernel-weighted means of neighbours' values."""
    out = pairs.withColumn("_w", kernel).groupBy(key).agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col(value)).alias("_v"))
    return out.where("_s > 0").select(key, (F.col("_v") / F.col("_s")).alias(name))


def boundary_distance(ranked: DataFrame, key: str, own: str, theirs: str) -> DataFrame:
    """The distance to the nearest neighbour with another label, else that to the last one looked at."""
    other = F.min(F.when(F.col(own) != F.col(theirs), F.col("d2")))
    return ranked.groupBy(key).agg(F.sqrt(F.coalesce(other, F.max("d2"))).alias("distance"), (other.isNull()).alias("inner_point"))


def label_contacts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Contacts between unlike labels from neighbour edges (each contact from one of its sides, codes 0 to
    3): weight 2 along an edge, 1 across a corner."""
    half = edges.where((F.col("k") < 4) & (F.col(a) != F.col(b)))
    weight = F.when(F.col("k") % 2 == 0, 2).otherwise(1)
    return half.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.sum(weight).alias("weight"))


def seam_blend(own: DataFrame, other: DataFrame, key: Sequence[str], value: str, weight: str) -> DataFrame:
    """Two solutions of the same cells, blended by weight where both are, else the one there is."""
    a = own.select(*key, F.col(value).alias("_a"), F.col(weight).alias("_wa"))
    b = other.select(*key, F.col(value).alias("_b"), F.col(weight).alias("_wb"))
    met = a.join(b, [*key], "full_outer")
    both = (F.col("_a") * F.col("_wa") + F.col("_b") * F.col("_wb")) / (F.col("_wa") + F.col("_wb"))
    return met.select(*key, F.coalesce(F.when(F.col("_wa") + F.col("_wb") > 0, both), F.col("_a"), F.col("_b")).alias(value))


def nearest_label(cells: DataFrame, labelled: DataFrame, label: str, radius: int) -> DataFrame:
    """(i, j, label, d2): for cells within a radius of a labelled one, the nearest's label (the least of
    equals). Labelled cells send themselves over a disc; one aggregation with map-side combining."""
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    to = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(a * a + b * b).alias("d2")) for a, b in disc]))
    sent = labelled.select(to.alias("_t"), F.col(label).alias("_l")).select("_t.i", "_t.j", "_t.d2", "_l")
    best = sent.groupBy("i", "j").agg(F.min(F.struct("d2", "_l")).alias("_b"))
    return cells.select("i", "j").join(best, ["i", "j"]).select("i", "j", F.col("_b._l").alias(label), F.col("_b.d2").alias("d2"))


def narrowed(pairs: DataFrame, made_for: float, radius: float) -> DataFrame:
    """Pairs (with d2) found for one radius, used again for a smaller one; a larger one is refused."""
    if radius > made_for:
        raise ValueError("the pairs do not reach that far")
    return pairs.where(F.col("d2") <= radius * radius)
