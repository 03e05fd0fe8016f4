"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of `length` bytes that starts at two places is found, and all bytes such strings cover
are removed. The work is dealt out by super-windows: the windows of `length` bytes that follow each
other and share their least hash of a `GRAM`-byte gram. Equal windows have the same least hash, so
they meet in one group; each window is in exactly one super-window, so that no place meets itself.

1. Groups whose gram occurs once hold no repeat and go (an aggregation over hashes).
2. Equal super-windows become one, with a weight; only one of them is cut from its text.
3. Each group's suffixes are sorted to a bounded depth, which gives the Burrows-Wheeler transform.
   Breadth-first backward extension from the empty string's interval derives the common prefixes
   of neighbouring suffixes in the order of their values and stops at `length`: boundaries without a
   value by then have a common prefix of at least `length`.
4. Marked windows go back to all super-windows that are equal, and their bytes are removed.

A group with very many unlike super-windows (a common line with unlike surroundings) is cut into
finer super-windows by nearly whole windows before it is dealt out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, durable, mix, signed, text_chunks

LENGTH = 200
GRAM = 32
#: Unlike super-windows in a group beyond which it is dealt out by longer grams.
CROWD = 4000
#: Bytes of super-windows that one transform takes (whole groups).
BATCH_BYTES = 1 << 20
#: Documents whose keys may be sent to every task (16 bytes each); beyond, texts meet them by a join.
BROADCAST_DOCS = 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as long as any chunk so far."""

    up = down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            cls.up, cls.down = (np.full(size, U64(b)) for b in (BASE, INVERSE))
            for t in (cls.up, cls.down):
                t[0] = 1
                np.multiply.accumulate(t, out=t)
        return cls.up[:n], cls.down[:n]


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over a[i : i + width], for every i with a whole window."""
    n = len(a)
    pad = np.full(-n % width, a[-1], a.dtype)
    block = np.concatenate([a, pad]).reshape(-1, width)
    head = best.accumulate(block, axis=1).ravel()
    tail = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(tail[: n - width + 1], head[width - 1 : n])


def super_windows(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, least hash, anchors, content hash) of every super-window, windows
    counted within the row. anchors: how often the least gram stands in the super-window."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.astype(U64), none, none.astype(U64)
    width = length - gram + 1
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) | U64(1)
    least = _sliding(h, width, np.minimum)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return none, none, none, none.astype(U64), none, none.astype(U64)
    ahead = np.cumsum(counts) - counts
    valid = np.repeat(offsets[:-1] - ahead, counts) + np.arange(total)
    value = least[valid]
    turn = np.ones(total, bool)
    turn[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1] + 1)
    at = np.flatnonzero(turn)
    lo, hi, v = valid[at], valid[np.append(at[1:], total) - 1], value[at]
    row = np.searchsorted(offsets, lo, "right") - 1
    # a gram is an anchor if it is the least of some window, that is, of the window with the greatest least
    held = np.zeros(n - gram + 1 + width - 1, U64)
    held[width - 1 + valid] = value
    anchor = np.flatnonzero(_sliding(held, width, np.maximum) == h)
    names = np.unique(v)
    order = np.argsort(np.searchsorted(names, v) * (n + 1) + lo)
    keys = (np.searchsorted(names, v) * (n + 1) + lo)[order]
    own = order[np.searchsorted(keys, np.searchsorted(names, h[anchor]) * (n + 1) + anchor, "right") - 1]
    anchors = np.bincount(own, minlength=len(lo))
    content = mix(mix((sums[hi + length] - sums[lo]) * down[lo]) ^ (hi - lo).astype(U64))
    return row, lo - offsets[row], hi - offsets[row], v, anchors, content


def _bwt(symbols: np.ndarray, depth: int):
    """(suffix array sorted by at least `depth` symbols, transform, last-to-first map)."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = start
    done = 7
    while done < depth:
        alone = new & np.append(new[1:], True)
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        of = sa[active]
        nxt = rank[np.minimum(of + done, n)] + 1
        key = (rank[of] << 32) | nxt
        order = np.argsort(key, kind="stable")
        sa[active] = of[order]
        key = key[order]
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[active] = fresh
        start = np.maximum.accumulate(np.where(fresh, active, 0))
        rank[sa[active]] = start
        done *= 2
    last = symbols[sa - 1]
    to = np.empty(n, np.int64)
    to[np.argsort(last, kind="stable")] = np.arange(n)
    return sa, last, to


def bounded_prefixes(symbols: np.ndarray, bound: int):
    """(suffix array, common prefixes): entry i is the common prefix of suffixes i - 1 and i if that is
    under the bound, else the bound. symbols: 1 to 256, with 0 after each string."""
    n = len(symbols)
    sa, last, to = _bwt(symbols, bound)
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    turn = np.ones(n, bool)
    turn[1:] = last[1:] != last[:-1]
    begin = np.flatnonzero(turn)  # runs of the transform
    end = np.append(begin[1:], n)
    run = np.cumsum(turn) - 1
    lo, hi = np.array([0]), np.array([n])
    for value in range(bound):
        # the pieces of runs in each interval, then the first and last piece of each symbol in it
        a, pieces = run[lo], run[hi - 1] - run[lo] + 1
        of = np.repeat(np.arange(len(lo)), pieces)
        r = np.repeat(a - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(of))
        first, past = np.maximum(begin[r], lo[of]), np.minimum(end[r], hi[of])
        key = of * 512 + last[first]
        order = np.argsort(key, kind="stable")
        key, first, past = key[order], first[order], past[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        close = np.append(np.flatnonzero(new)[1:], len(key)) - 1
        lb, rb = to[first[new]], to[past[close] - 1] + 1
        fresh = lcp[rb] < 0
        if value:  # a separator ends a string: nothing is read across it
            fresh &= key[new] % 512 != 0
        else:
            fresh |= (key[new] % 512 == 0) & (rb < n)
        lo, hi = lb[fresh], rb[fresh]
        lcp[hi] = np.where(hi < n, value, lcp[hi])
        if not len(lo):
            break
    lcp[lcp < 0] = bound
    return sa, lcp


def repeated_windows(texts: list[bytes], weights: np.ndarray, length: int = LENGTH):
    """For each text the windows (first, last) of `length` bytes that occur again: in another of the
    texts, at another place of the same, or in a copy (weight over 1). texts: without repeats."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    data[starts + sizes] = 0
    sa, lcp = bounded_prefixes(data, length)
    again = np.zeros(len(data), bool)
    same = lcp[1:-1] >= length
    again[sa[1:][same]] = True
    again[sa[:-1][same]] = True
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(data)) - starts[text]
    hit = (again | (weights[text] > 1)) & (place <= sizes[text] - length)
    at = np.flatnonzero(hit)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text[at]) != 0))
    a, b = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return text[a], place[a], place[b]


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _runs(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            for i, _, offsets, data in text_chunks(batch.column(2)):
                row, lo, hi, v, anchors, content = super_windows(offsets, data, length)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[i + row]),
                            pa.array(k2[i + row]),
                            pa.array(signed(v)),
                            pa.array(signed(content)),
                            pa.array(lo, pa.int32()),
                            pa.array(hi, pa.int32()),
                            pa.array(anchors, pa.int32()),
                        ],
                        names=["k1", "k2", "value", "content", "lo", "hi", "anchors"],
                    )

    return rows.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 long, value long, content long, lo int, hi int, anchors int"
    )


def _cut(rows: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """The bytes of the super-windows that `need` names, finer ones for crowded groups."""
    met = rows.join(need, ["k1", "k2"]).select("text", "wanted")
    schema = "deal long, value long, content long, skip long, weight long, bytes binary"
    names = ["deal", "value", "content", "skip", "weight", "bytes"]

    def run(batches):
        for batch in batches:
            texts, wanted = batch.column(0).cast(pa.binary()), batch.column(1)
            out, size = [], 0
            for t, asked in zip(texts, wanted):
                text = t.as_py()
                for w in asked.as_py():
                    piece = text[w["lo"] : w["hi"] + length]
                    if w["crowded"]:
                        fine = super_windows(np.array([0, len(piece)]), np.frombuffer(piece, np.uint8), length, length - 8)
                        for lo, hi, v in zip(fine[1].tolist(), fine[2].tolist(), signed(fine[3]).tolist()):
                            out.append((v, w["value"], w["content"], lo, w["weight"], piece[lo : hi + length]))
                    else:
                        out.append((w["value"], w["value"], w["content"], 0, w["weight"], piece))
                    size += len(piece)
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)

    return met.mapInArrow(run, schema)


CHUNK = 4 << 20


def _expand(groups, length: int):
    """Marked windows of whole groups of cut super-windows, as (value, content, first, last) arrays."""
    seen: dict[bytes, int] = {}
    weights: list[int] = []
    of = np.empty(len(groups), np.int64)
    for i, g in enumerate(groups):
        j = seen.setdefault(g[5], len(seen))
        if j == len(weights):
            weights.append(0)
        weights[j] += g[4]
        of[i] = j
    text, first, last = repeated_windows(list(seen), np.array(weights), length)
    order = np.argsort(of, kind="stable")
    lo, hi = np.searchsorted(of[order], text, "left"), np.searchsorted(of[order], text, "right")
    n = hi - lo
    row = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    skip = np.array([groups[i][3] for i in row], np.int64)
    return (
        np.array([groups[i][1] for i in row], np.int64),
        np.array([groups[i][2] for i in row], np.int64),
        np.repeat(first, n) + skip,
        np.repeat(last, n) + skip,
    )


def _expanded(cut: DataFrame, parts: int, length: int) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for g in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH_BYTES and g[0] != held[-1][0]:
                    yield of(held)
                    held, size = [], 0
                held.append(g)
                size += len(g[5])
        if held:
            yield of(held)

    def of(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in _expand(held, length)], names=["value", "content", "first", "last"]
        )

    dealt = cut.repartition(parts, "deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(run, "value long, content long, first long, last long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (never null) and a key of both. Equal rows share a key and one result."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("doc_id", F.length("text"))})


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): the byte spans, not yet merged, that repeated strings of `length` bytes cover in
    each keyed row that has any."""
    runs = _runs(rows, length)
    dup = runs.groupBy("value").agg(F.sum("anchors").alias("n")).where("n > 1").select("value")
    cand = durable(runs.join(dup, "value").select("value", "content", "k1", "k2", "lo", "hi"))
    like = durable(
        cand.groupBy("value", "content").agg(
            F.count(F.lit(1)).alias("weight"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("r")
        )
    )
    crowd = like.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("value", F.lit(True).alias("crowded"))
    asked = like.join(crowd, "value", "left").select(
        "r.k1",
        "r.k2",
        F.struct("value", "content", "weight", "r.lo", "r.hi", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("w"),
    )
    need = durable(asked.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")))
    # most documents have nothing to cut: leave them out before texts are shuffled, if that table is small
    some = need.select("k1", "k2")
    texts = rows.select("k1", "k2", "text")
    if need.count() <= BROADCAST_DOCS:
        texts = texts.join(F.broadcast(some), ["k1", "k2"], "left_semi")
    cut = _cut(texts, need, length)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = _expanded(cut, parts, length)
    back = cand.join(marked, ["value", "content"]).select(
        "k1", "k2", F.struct((F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + length).alias("b")).alias("s")
    )
    return back.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal covered runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def removed_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte
    ranges removed). Strings are judged on the input; each copy loses the bytes.

    Null and empty texts have no bytes; texts shorter than `length` are whole. Repeated rows (equal in id
    and text) repeat each other. Null ids stay null. Empty tables give empty results.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length)
    met = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                text = text.as_py()
                gone = merged(spans or [])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"a": a, "b": b} for a, b in gone]))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array(c, pa.int64()) for c in columns[:3]),
                        pa.array(columns[3], pa.string()),
                        pa.array(columns[4], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return met.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    )
