"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh by a repeating list and share a budget of
words; a target stops at `max_epochs` times its source's words and the excess goes to the others by
weight (water-filling, solved in closed form over the table of sources).

Order: each source's weight is a schedule over training time t in [0, 1], a line through given knots (t, w).
Its integral, scaled to the source's target, is its cumulative demand. A document's words lie in its
source's queue (ordered by a hash of id and text) as the interval [a, b); copy c takes the interval
[c S + a, c S + b), S being the source's words, as far as the target T reaches. The copy's training
position is the time at which the integrated demand arrives at its start: the inverse of the
integral, solved within the piece between two knots. Documents are then range-sorted by position.

The queues' running sums go in two steps, sums by hash bucket and then sums within a bucket, so
that a source with a third of all rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_names, positional

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: The sources' weight schedules as knots (t, w), repeating in code-point order: later, even, earlier.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
#: Rows of a source that one task sums in order, about.
BUCKET_ROWS = 20_000


def n_words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size, rank, weight, target). sizes: source, size. The windows run over one row
    for each source. Sources without words have target 0."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    one = Window.partitionBy(F.lit(1))
    named = by.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", given).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    named = named.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = one.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    named = named.withColumn("level", level)
    # up to the level a source's cap binds; the first one that is not capped has the highest level of
    # the rest, and sets theirs
    named = named.withColumn("free", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(one))
    target = F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(
        F.col("free") * F.col("weight")
    )
    return named.select("source", "source_size", "source_rows", "rank", "weight", target.alias("target"))


def queue_key(id_: Column, text: Column) -> Column:
    """A row's place in its source's queue: rows without an id, or with one id, are spread by their texts."""
    of_text = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), of_text).cast("binary"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    i, t = docs[id_col], docs[text_col]
    return docs.select(i.alias("doc_id"), docs[source_col].alias("source"), n_words(t).alias("size"), queue_key(i, t).alias("key"))


def integrated(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(begin, before, weight, rise) of a schedule's pieces: when a piece begins, the share of the whole integral
    before it, and its first weight and slope over the whole integral. Pieces without weight are left out."""
    times, weights = zip(*((float(t), float(w)) for t, w in knots))
    if times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a schedule's times rise from 0 to 1, and its weights are at least 0 and not all 0")
    pieces = list(zip(times, times[1:], weights, weights[1:]))
    areas = [(v - u) * (a + b) / 2 for u, v, a, b in pieces]
    whole, before, out = sum(areas), 0.0, []
    for (u, v, a, b), area in zip(pieces, areas):
        if area > 0:
            out.append((u, before / whole, a / whole, (b - a) / (v - u) / whole))
        before += area
    return out


def demand_inverse(offset: Column, target: Column, schedule: Column) -> Column:
    """t in [0, 1] at which the integral of the schedule (an array of `integrated` pieces), scaled to `target`
    words, is `offset`; where it rests at that for a while, the end of the rest."""
    share = F.least(F.greatest(F.when(target > 0, offset / target).otherwise(F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    piece = F.element_at(F.filter(schedule, lambda p: p["before"] <= share), -1)
    need = share - piece["before"]
    root = F.sqrt(F.greatest(piece["weight"] * piece["weight"] + 2 * piece["rise"] * need, F.lit(0.0)))
    return F.least(piece["begin"] + F.when(need > 0, 2 * need / (piece["weight"] + root)).otherwise(F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """What the mix takes of every row of docs.

    Returns doc_id, source, size, source_size, target, taken (words over all copies), start (the
    row's place in its source's queue) and positions (training time of each copy's first word, in
    [0, 1]; empty if nothing is taken). Of each source floor(target) words are taken in all; the
    copy at which the target ends is cut there; key is the row's place in the queue. Null and empty texts
    have size 0 and are not taken. Null sources are one source, the last. Rows with equal ids are ordered
    by their texts, and rows equal in id, text and source are interchangeable. Reruns agree. Empty tables give empty results;
    other columns are ignored.
    """
    rows = durable(sized(docs, id_col, text_col, source_col))
    sources = source_targets(rows, weights, share, max_epochs)
    many = rows.count()
    buckets = max(16, -(-many // BUCKET_ROWS))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    queue = rows.withColumn("bucket", F.floor(spread * buckets))
    part = ["source", "bucket"]
    sums = queue.groupBy(*part).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*part).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = queue.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # both sides have at most a row for each source and bucket; small sides are broadcast by measured size
    s, t = sums.alias("s"), sources.alias("t")
    q = placed.alias("q")
    q = q.join(s, F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
    q = q.join(t, F.col("q.source").eqNullSafe(F.col("t.source")))
    q = q.select(
        "q.doc_id",
        "q.source",
        "q.size",
        "q.key",
        "t.source_size",
        "t.target",
        "t.rank",
        (F.col("s.ahead") + F.col("q.inner")).alias("start"),
    )
    whole = F.floor("target")
    names = ("begin", "before", "weight", "rise")
    made = [F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, p)]) for p in integrated(s)]) for s in schedules]
    schedule = F.element_at(F.array(*made), (F.col("rank") % len(schedules) + 1).cast("int"))
    begins = [F.col("start") + F.col("source_size") * c for c in range(max_epochs)]
    parts = [F.greatest(F.least(F.col("size"), whole - b), F.lit(0)).cast("long") for b in begins]
    copies = F.array(
        *[
            F.struct(p.alias("words"), demand_inverse(b.cast("double"), F.col("target"), schedule).alias("position"))
            for p, b in zip(parts, begins)
        ]
    )
    taken = parts[0]
    for p in parts[1:]:
        taken = taken + p
    return q.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "start",
        "key",
        F.filter(copies, lambda c: c["words"] > 0).alias("copies"),
    ).withColumn("positions", F.transform("copies", lambda c: c["position"]))


def in_order(plan: DataFrame) -> DataFrame:
    """The rows of `mix`, range-sorted by the position of their first copy (ties by id); rows not taken come last."""
    return plan.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as they are trained on: a row for each copy taken, with all columns of docs and copy_words,
    position, range-sorted by position (ties by id). Where docs has a column of such a name, the added one
    has an underscore after it. Rows are met by their place in the queue: unlike texts under one id
    are rows of their own, and rows equal in id, text and source are interchangeable."""
    plain, i, t, s = positional(docs, id_col, text_col, source_col)
    plan = durable(mix(plain, i, t, s).select(F.col("key").alias("place"), F.col("source").alias("from"), "copies"))
    rows = plain.withColumn("key", queue_key(plain[i], plain[t]))
    meets = rows[s].eqNullSafe(plan["from"]) & (rows["key"] == plan["place"])
    if not plan.groupBy("place", "from").count().where("count > 1").isEmpty():  # equal rows: the first meets the first
        plan = plan.withColumn("k", F.row_number().over(Window.partitionBy("place", "from").orderBy(F.size("copies").desc())))
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", s).orderBy("key")))
        meets = meets & (rows["nth"] == plan["k"])
    met = rows.join(plan.where(F.size("copies") > 0), meets)
    out = met.select(*[rows[c] for c in plain.columns], F.explode("copies").alias("copy"))
    out = out.select(*plain.columns, F.col("copy.words").alias("copy_words"), F.col("copy.position").alias("position"))
    return out.orderBy("position", i).toDF(*docs.columns, *free_names(docs.columns, "copy_words", "position"))


#: DuckDB's text of the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, ss * 2 AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(ss) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS free FROM l),
t AS (SELECT source, ss, rank, CASE WHEN free IS NULL OR ratio <= level THEN cap ELSE free * weight END AS target FROM f),
q AS (SELECT d.doc_id, d.size, t.ss::BIGINT AS source_size, t.target, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][(t.rank % 3 + 1)::INT] AS slope,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, least(greatest(CASE WHEN target > 0 THEN start::DOUBLE / target ELSE 0.0 END, 0.0), 1.0) AS part FROM q)
SELECT doc_id, size::BIGINT AS size, source_size, target, start,
  (greatest(least(size, floor(target) - start), 0) + greatest(least(size, floor(target) - start - source_size), 0))::BIGINT AS taken,
  CASE WHEN least(size, floor(target) - start) > 0 THEN round(CASE WHEN slope = 0 THEN part
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * part) - (1 - slope)) / (2 * slope) END, 9) END AS position
FROM p
"""
