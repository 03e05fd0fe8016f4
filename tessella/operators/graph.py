"""Graph operators: components, pointer doubling, flood levels by the spill graph, accumulation."""

from __future__ import annotations

import heapq
import itertools
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DRAIN = -1


def settled(df: DataFrame) -> DataFrame:
    """df materialised in the session's checkpoint folder: spark.checkpoint.dir, or one of our own in local mode
    where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
    return unsized(df.checkpoint(eager=True))


def unsized(df: DataFrame) -> DataFrame:
    """A checkpointed df without the size that its plan was guessed to have. A checkpoint keeps that guess, a join
    multiplies those of its sides, and in a loop the number itself grows until it fills the driver. Partitioning and order stay."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    none = spark._jvm.scala.Option.empty()
    bare = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, spark._jsparkSession, none, none
    )
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def roots(links: DataFrame, node: str = "cid", down: str = "down", most: int = 64) -> DataFrame:
    """(node, root, depth) of a functional graph whose roots point to themselves: pointer doubling, so
    as many joins as the depth has bits."""
    state = settled(links.select(F.col(node).alias("n"), F.col(down).alias("p"), (F.col(node) != F.col(down)).cast("long").alias("d")))
    for _ in range(most):
        up = state.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("d").alias("pd"))
        nxt = settled(state.join(up, "p").select("n", "p", "pp", (F.col("d") + F.col("pd")).alias("d")))
        moved = not nxt.where("p <> pp").isEmpty()
        state = nxt.select("n", F.col("pp").alias("p"), "d")
        if not moved:
            return state.select(F.col("n").alias(node), F.col("p").alias("root"), F.col("d").alias("depth"))
    raise ValueError("the graph has a cycle")


def accumulate(links: DataFrame, weights: DataFrame, node: str = "cid", down: str = "down", weight: str | Sequence[str] = "w", most: int = 64) -> DataFrame:
    """acc = own weight + all weight from upstream, by doubling: each round adds what reaches a node over
    paths of 2^r to 2^(r+1) - 1 steps. Of several weights each is added up, as acc_<weight>, in one go. Nodes
    whose way has ended take no part in the join of a round."""
    names = [weight] if isinstance(weight, str) else list(weight)
    sums = ["acc"] if isinstance(weight, str) else [f"acc_{w}" for w in names]
    jump = links.select(F.col(node).alias("n"), F.when(F.col(node) != F.col(down), F.col(down)).alias("p"))
    own = weights.select(F.col(node).alias("n"), *[F.col(w).cast("double").alias(a) for w, a in zip(names, sums)])
    state = settled(jump.join(own, "n"))
    for _ in range(most):
        live = state.where(F.col("p").isNotNull())
        if live.isEmpty():
            return state.select(F.col("n").alias(node), *sums)
        sent = live.groupBy(F.col("p").alias("n")).agg(*[F.sum(a).alias(f"_{a}") for a in sums])
        up = state.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        moved = live.join(up, "p").select("n", F.col("pp").alias("p"), *sums)
        moved = moved.unionByName(state.where(F.col("p").isNull()))
        state = settled(moved.join(sent, "n", "left").select("n", "p", *[(F.col(a) + F.coalesce(f"_{a}", F.lit(0.0))).alias(a) for a in sums]))
    raise ValueError("the graph has a cycle")


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """(cid, label): the least node of each component of nodes. edges: a, b. Least labels spread by
    neighbours and then by labels' own labels (pointer jumping)."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = settled(nodes.select("cid", F.col("cid").alias("label")))
    for _ in range(most):
        near = both.join(state.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("m"))
        low = state.join(near, "cid", "left").select("cid", "label", F.least("label", F.coalesce("m", F.col("label"))).alias("l"))
        hop = state.select(F.col("cid").alias("l"), F.col("label").alias("ll"))
        nxt = settled(low.join(hop, "l").select("cid", "label", F.least("l", "ll").alias("new")))
        if nxt.where("label <> new").isEmpty():
            return state
        state = nxt.select("cid", F.col("new").alias("label"))
    raise RuntimeError("components did not settle")


#: Cells of a block, a side, that one task searches; edges reach over two cells.
BLOCK = 8


def radius_components(points: DataFrame, key: str, group: str, xyz: Sequence[str], radius: float) -> DataFrame:
    """(key, group, piece): the least key of each component of points of one group that lie within a radius of
    each other. Points without a group are on their own. Pairs are never listed: cells are so small that all a
    group has in one is one piece, and of two cells in reach one link is enough. Blocks of cells, with the cells
    around them, are searched side by side; equal points count once there."""
    side = radius / len(xyz) ** 0.5 * (1 - 1e-9)
    cells = [f"_c{n}" for n in range(len(xyz))]
    at = points.select(F.col(key).alias("cid"), F.col(group).alias("_g"), *[F.col(c).cast("double").alias(f"_x{n}") for n, c in enumerate(xyz)])
    at = at.withColumns({c: F.floor(F.col(f"_x{n}") / side) for n, c in enumerate(cells)})
    rep = at.where("_g is not null").groupBy("_g", *cells).agg(F.min("cid").alias("rep"))
    named = settled(at.join(rep, ["_g", *cells], "left").withColumn("rep", F.coalesce("rep", "cid")))
    spots = named.where("_g is not null").select("_g", *cells, "rep", *[f"_x{n}" for n in range(len(xyz))]).distinct()
    for c in cells:
        ends = F.array_distinct(F.array(*[F.floor((F.col(c) + d) / BLOCK) for d in (-2, 2)]))
        spots = spots.withColumn(f"_b{c}", F.explode(ends))
    blocks = [f"_b{c}" for c in cells]
    edges = settled(spots.groupBy("_g", *blocks).applyInArrow(lambda t: _cell_links(t, cells, blocks, radius), "a long, b long").distinct())
    label = components(edges, named.select(F.col("rep").alias("cid")).distinct()).select(F.col("cid").alias("rep"), F.col("label").alias("piece"))
    return named.join(label, "rep").select(F.col("cid").alias(key), F.col("_g").alias(group), "piece")


def _cell_links(table: pa.Table, cells: list[str], blocks: list[str], radius: float) -> pa.Table:
    """Links (a, b) between the names of cells in reach that hold points within the radius, a's cell in the block."""
    place = np.stack([table.column(c).to_numpy() for c in cells], 1)
    x = np.stack([table.column(f"_x{n}").to_numpy() for n in range(len(cells))], 1)
    rep = table.column("rep").to_numpy()
    order = np.lexsort(place.T)
    place, x, rep = place[order], x[order], rep[order]
    edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True])))
    own = {tuple(place[a].tolist()): (a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())}
    home = tuple(table.column(b)[0].as_py() for b in blocks)
    zero = (0,) * len(cells)
    near = [o for o in itertools.product(range(-2, 3), repeat=len(cells)) if o > zero]
    u, v = [], []
    for cell, (a, b) in own.items():
        if tuple(c // BLOCK for c in cell) != home:
            continue
        for o in near:
            other = own.get(tuple(c + d for c, d in zip(cell, o)))
            if other and _touch(x[a:b], x[other[0] : other[1]], radius * radius):
                u.append(rep[a])
                v.append(rep[other[0]])
    return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})


def _touch(p: np.ndarray, q: np.ndarray, most: float) -> bool:
    """Whether a point of p and one of q have a squared distance of at most `most`."""
    step = max(1, (1 << 18) // len(q))
    for n in range(0, len(p), step):
        d2 = 0.0
        for k in range(p.shape[1]):
            gap = p[n : n + step, None, k] - q[None, :, k]
            d2 = d2 + gap * gap
        if (d2 <= most).any():
            return True
    return False


def spill_levels(pairs: list[tuple], drains: set) -> dict:
    """Minimax path level of every label to a drain, by a heap over the basin graph."""
    near: dict = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((w, b))
        near.setdefault(b, []).append((w, a))
    level = {d: float("-inf") for d in drains}
    heap = [(float("-inf"), d) for d in sorted(drains)]
    heapq.heapify(heap)
    while heap:
        at, node = heapq.heappop(heap)
        if at > level.get(node, float("inf")):
            continue
        for w, other in near.get(node, ()):
            to = max(at, w)
            if to < level.get(other, float("inf")):
                level[other] = to
                heapq.heappush(heap, (to, other))
    return level


def spill_levels_in_rounds(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(root, level): the same minimax levels for graphs of any size. pairs: a, b, w, with DRAIN for the way out.

    Each label leaves by its lowest pair, or stays within a pair that is the lowest of both ends; what is
    tied together so becomes one label, and a label's level is the highest pair that it left by. Labels
    at least halve in a round; those tied to DRAIN are done. Labels without a way to it have no row.
    """
    pairs = settled(pairs.select("a", "b", "w"))
    state = pairs.select(F.col("a").alias("root")).unionByName(pairs.select(F.col("b").alias("root"))).distinct().where(F.col("root") != DRAIN)
    state = settled(state.select("root", F.col("root").alias("now"), F.lit(None).cast("double").alias("level")))
    done = []
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != DRAIN)
        lowest = F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("x")
        leaves = settled(both.groupBy("a").agg(lowest).select("a", F.col("x.b").alias("to"), F.col("x.w").alias("w")))
        if leaves.isEmpty():
            break
        back = leaves.select(F.col("a").alias("to"), F.col("to").alias("back"))
        first = F.col("back").eqNullSafe(F.col("a")) & (F.col("a") < F.col("to"))
        links = leaves.join(back, "to", "left").select(F.col("a").alias("cid"), F.when(first, F.col("a")).otherwise(F.col("to")).alias("down"))
        links = links.unionByName(pairs.sparkSession.range(1).select(F.lit(DRAIN).cast("long").alias("cid"), F.lit(DRAIN).cast("long").alias("down")))
        tied = settled(roots(links).select(F.col("cid").alias("now"), F.col("root").alias("then")))
        met = state.join(leaves.select(F.col("a").alias("now"), "w"), "now").join(tied, "now")
        state = settled(met.select("root", F.col("then").alias("now"), F.greatest("level", F.col("w").cast("double")).alias("level")))
        done.append(state.where(F.col("now") == DRAIN).select("root", "level"))
        state = state.where(F.col("now") != DRAIN)
        one, two = (tied.select(F.col("now").alias(c), F.col("then").alias(f"to_{c}")) for c in "ab")
        pairs = pairs.join(one, "a").join(two, "b").where("to_a <> to_b")
        pairs = settled(pairs.groupBy(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).agg(F.min("w").alias("w")))
    out = state.select("root", "level").limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def strahler(edges: DataFrame, most: int = 200) -> DataFrame:
    """(id, order) of reaches: edges id, a (from node), b (to node). 1 without inflow, else the highest
    order that flows in, one more if it occurs twice. Rounds from the sources down; reaches on cycles get 1."""
    todo = settled(edges.select("id", "a", "b"))
    done = None
    for _ in range(most):
        if todo.isEmpty():
            break
        waits = todo.select(F.col("b").alias("a")).distinct()
        ready = todo.join(waits, "a", "left_anti")
        if ready.isEmpty():  # only cycles are left
            done = todo.select("id", "b", F.lit(1).alias("order")) if done is None else done.unionByName(todo.select("id", "b", F.lit(1).alias("order")))
            break
        if done is None:
            now = ready.select("id", "b", F.lit(1).alias("order"))
        else:
            top = done.groupBy(F.col("b").alias("a")).agg(F.max("order").alias("m"))
            same = done.select(F.col("b").alias("a"), "order").join(top, "a").where("order = m").groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"))
            now = ready.join(same, "a", "left").select("id", "b", F.coalesce(F.col("m") + (F.col("c") > 1).cast("int"), F.lit(1)).alias("order"))
        done = settled(now if done is None else done.unionByName(now))
        todo = settled(todo.join(now.select("id"), "id", "left_anti"))
    return done.select("id", "order")


def topological_rank(links: DataFrame, node: str = "cid", down: str = "down") -> DataFrame:
    """(node, rank): steps to the root; ascending rank has every receiver before its donors."""
    return roots(links, node, down).select(node, F.col("depth").alias("rank"))


def exclusive_top(candidates: DataFrame, score: str, key: str, at: Sequence[str], k: int, least_distance: float, block: int = 500) -> list[tuple]:
    """Greedy top k of the candidates as (score, key, point), best first (the least key of equals), with all
    accepted at least so far apart. Candidates are read from the best down, a block at a time, until k
    stand or none is left."""
    kept: list[tuple] = []
    rest = candidates.select(F.col(score).alias("s"), F.col(key).alias("k"), *[F.col(c).alias(f"p{n}") for n, c in enumerate(at)]).where("s is not null")
    while len(kept) < k:
        rows = rest.orderBy(F.desc("s"), "k").limit(block).collect()
        for s, key_, *p in rows:
            if all(sum((a - b) ** 2 for a, b in zip(p, o[2])) >= least_distance**2 for o in kept):
                kept.append((s, key_, tuple(p)))
                if len(kept) == k:
                    break
        if len(rows) < block:
            break
        s, last = rows[-1][:2]
        rest = rest.where((F.col("s") < F.lit(s)) | ((F.col("s") == F.lit(s)) & (F.col("k") > F.lit(last))))
    return kept


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with dense, the rank of `by` from 0."""
    return df.withColumn("dense", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(by)) - 1)
