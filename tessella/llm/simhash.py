"""SimHash near-duplicates through a binary-trie self-join.

Distinct fingerprints are dealt out by blocks: with budget + 1 blocks, two fingerprints that differ
in at most `budget` bits agree in one whole block, so each block's groups are tries whose upper
levels are that block. In each trie, pairs of nodes are walked together; a pair carries the bits in
which its two prefixes differ and goes as soon as they exceed the budget. Links found are joined in
a union-find at once and only spanning edges leave a task, so a group of many copies costs its
size, not its square; node pairs that already lie in one component are not walked further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, durable, hex64, mix, positional, powers, shingles, signed, text_chunks, whole_groups, words
from .components import connected_components

BITS = 64
#: Node pairs that one step of a walk expands.
FRONTIER = 1 << 17
#: What the near-duplicate stage takes as copies: the words of a shingle and the least exact Jaccard.
LIKE_WORDS, LIKENESS = 5, 0.8
#: Its candidates: greatest Hamming distance, and bands of so many least hashes each (a pair shares one).
LIKE_BITS, BANDS, BAND_ROWS = 20, 20, 4


def text_fingerprints(texts: list[bytes], shingle_words: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of texts: A-Z lowered, words between 0x20 and 0x09-0x0D, XXH64 of space-joined
    shingles; a bit is 1 if set in over half the hashes. No words: zero."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        parts = text.translate(LOWER).split()
        if len(parts) <= shingle_words:
            one = [digest(b" ".join(parts), seed)] if parts else []
        else:
            joined = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            one = [
                digest(joined[a:b], seed)
                for a, b in zip(starts[: len(parts) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist())
            ]
        hashes += one
        sizes.append(len(one))
    out = np.zeros(len(texts), U64)
    sizes = np.array(sizes, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(np.array(hashes, U64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.cumsum(sizes[some]) - sizes[some]
        counts = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        kept = np.packbits(2 * counts > sizes[some][:, None], axis=1)
        out[some] = kept.view(">u8").ravel().astype(U64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (long, the 64 bits as a signed number) of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            out = [np.zeros(0, np.int64)]
            for _, _, offsets, data in text_chunks(column):
                raw = data.tobytes()
                out.append(
                    signed(
                        text_fingerprints(
                            [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], shingle_words
                        )
                    )
                )
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in place; label points to the least member once all is done."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_components(keys: np.ndarray, budget: int, depth: int) -> np.ndarray:
    """The least index of each key's component, over links of keys that agree in their first `depth`
    bits and differ in at most `budget` bits. keys: sorted distinct unsigned 64-bit numbers."""
    n = len(keys)
    label = np.arange(n)
    top = keys >> U64(BITS - depth) if depth else np.zeros(n, U64)
    edge = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONTIER:
            stack.append((d, *(x[FRONTIER:] for x in (alo, ahi, blo, bhi, diff))))
            alo, ahi, blo, bhi, diff = (x[:FRONTIER] for x in (alo, ahi, blo, bhi, diff))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            _union(label, a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if len(alo) > 4096:  # pairs within one component link nothing new
            turns = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            new = (turns[alo] != turns[ahi - 1]) | (turns[blo] != turns[bhi - 1]) | (label[alo] != label[blo])
            alo, ahi, blo, bhi, diff = (x[new] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or d >= BITS:
            continue
        bit = U64(BITS - 1 - d)

        def split(lo, hi):
            at = (keys[lo] >> bit | U64(1)) << bit
            return np.clip(np.searchsorted(keys, at), lo, hi)

        am, bm, same = split(alo, ahi), split(blo, bhi), (alo == blo) & (ahi == bhi)
        parts = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1)]
        other = ~same
        parts.append((am[other], ahi[other], blo[other], bm[other], diff[other] + 1))
        nxt = [np.concatenate(x) for x in zip(*parts)]
        alo, ahi, blo, bhi, diff = nxt
        lives = (ahi > alo) & (bhi > blo) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1) & (bhi - blo == 1))
        if lives.any():
            stack.append((d + 1, *(x[lives] for x in nxt)))
    return label


def linked_fingerprints(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Spanning edges (u, v) of the graph that links fingerprints within `budget` bits.

    distinct: column fp, without repeats. The result has no more rows than distinct has, for each
    block; its components are those of all links.
    """
    blocks = budget + 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft("fp", cuts[i]), BITS - cuts[i + 1] + cuts[i]) for i in range(blocks)]
    dealt = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), p.alias("value")) for i, p in enumerate(part)])).alias("x")
    ).select("fp", "x.block", "x.value")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for block, _, fp in whole_groups(batches, 2, "block", "value", "fp"):
            for i in np.unique(block).tolist():
                own = fp[block == i].view(U64)
                turn = U64(cuts[i])
                turned = own if not cuts[i] else (own << turn) | (own >> U64(BITS - cuts[i]))
                order = np.argsort(turned)
                keys, own = turned[order], own[order]
                label = trie_components(keys, budget, cuts[i + 1] - cuts[i])
                at = np.flatnonzero(label != np.arange(len(label)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own[at])), pa.array(signed(own[label[at]]))], names=["u", "v"])

    dealt = dealt.select("block", "value", "fp").repartition(parts, "block", "value").sortWithinPartitions("block", "value")
    return dealt.mapInArrow(run, "u long, v long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, shingle_words: int = 3
) -> DataFrame:
    """Near-duplicate classes of documents: one row for each row of docs.

    Returns doc_id, fp (long), component_id (least doc_id of the class). Rows with equal
    fingerprints are one node. Null and empty texts have fingerprint zero and are linked like any
    other; rows with a null id keep it and never name a class unless no member has an id; repeated
    ids count as rows of their own. Empty tables give empty results; other columns are ignored.
    """
    marked = durable(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(linked_fingerprints(nodes.select("fp"), budget))
    classes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _shingle_sets(column: pa.Array):
    """For each run of texts: (first row, texts in it, owner, hash), the distinct LIKE_WORDS-word shingles of
    every text, ordered by text, then hash. Texts of fewer words have one shingle, all of them."""
    for i, j, offsets, data in text_chunks(column):
        _, _, row, hashes = words(offsets, data)
        at, h = shingles(row, hashes, LIKE_WORDS)
        own = row[at]
        counts = np.bincount(row, minlength=j - i)
        short = np.flatnonzero((counts > 0) & (counts < LIKE_WORDS))
        if len(short):
            table = powers(0xD6E8FEB86659FD93, LIKE_WORDS + 1)[1:]
            begin = np.cumsum(counts) - counts
            whole = [mix((hashes[begin[r] : begin[r] + counts[r]] * table[: counts[r]]).sum(keepdims=True) + U64(counts[r]))[0] for r in short]
            own, h = np.concatenate([own, short]), np.concatenate([h, np.array(whole, U64)])
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
        yield i, j - i, own[new], h[new]


def _set_keys(n: int, own: np.ndarray, h: np.ndarray):
    """(key, texts with shingles, start of each): the key is one number for a text's whole set, zero for none."""
    key = np.zeros(n, U64)
    some, begin = np.unique(own, return_index=True)
    if len(some):
        key[some] = mix(np.add.reduceat(mix(h), begin) + np.diff(np.append(begin, len(h))).astype(U64))
    return key, some, begin


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, fp, bands of every row: the SimHash of the text's set of shingles, and a number for each
    band of least hashes."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    turns = powers(0x9E3779B97F4A7C15, BANDS * BAND_ROWS + 1)[1:] | U64(1)

    def run(batches):
        for batch in batches:
            for i, n, own, h in _shingle_sets(batch.column(1)):
                key, some, begin = _set_keys(n, own, h)
                fp, bands = np.zeros(n, U64), [None] * n
                if len(some):
                    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
                    sizes = np.diff(np.append(begin, len(h)))
                    fp[some] = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(U64)
                    made = np.zeros((len(some), BANDS), U64)
                    for b in range(BANDS):
                        for t in turns[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
                            made[:, b] = mix(made[:, b] + np.minimum.reduceat(h * t, begin))
                        made[:, b] = mix(made[:, b] + U64(b))
                    for r, line in zip(some.tolist(), signed(made.ravel()).reshape(made.shape)):
                        bands[r] = line
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(signed(key)), pa.array(signed(fp)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "fp", "bands"],
                )

    return rows.mapInArrow(run, "doc_id long, key long, fp long, bands array<long>")


def _candidate_links(nodes: DataFrame) -> DataFrame:
    """Spanning edges (u, v) of the graph of keys that share a band and differ in at most LIKE_BITS bits."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = nodes.select(F.explode("bands").alias("band"), "key", "fp").repartition(parts, "band").sortWithinPartitions("band")

    def run(batches):
        for got in whole_groups(batches, 1, "band", "key", "fp"):
            yield linked(*got)

    def linked(band, key, fp):
        fp = fp.view(U64)
        edge = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
        many = np.flatnonzero(np.diff(edge) > 1)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge[many].tolist(), edge[many + 1].tolist()):
            left, queue = np.arange(lo, hi), []
            while len(left):
                if not queue:
                    queue, left = [left[0]], left[1:]
                at = queue.pop()
                near = np.bitwise_count(fp[left] ^ fp[at]) <= LIKE_BITS
                if near.any():
                    u.append(key[left[near]])
                    v.append(np.full(int(near.sum()), key[at]))
                    queue += left[near].tolist()
                    left = left[~near]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _trie_links(nodes: DataFrame) -> DataFrame:
    """Spanning edges (u, v) of the graph of keys whose SimHashes are equal or linked by the trie self-join."""
    named = durable(nodes.groupBy("fp").agg(F.min("key").alias("head")))
    equal = nodes.join(named, "fp").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    ends = [named.select(F.col("fp").alias(c), F.col("head").alias(f"_{c}")) for c in "uv"]
    near = linked_fingerprints(named.select("fp")).join(ends[0], "u").join(ends[1], "v")
    return equal.unionByName(near.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def like_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The least index of each set's component, over links of sets whose Jaccard is at least LIKENESS.
    sets: distinct hashes each. A set meets those not yet reached, through an index of their hashes."""
    n = len(sets)
    label, sizes = np.full(n, -1), np.array([len(s) for s in sets])
    left = np.arange(n)
    built, queue = None, []
    while len(left):
        if not queue:
            root, left = left[0], left[1:]
            label[root], queue = root, [root]
        if not len(left):
            break
        if built is None or 2 * len(left) < built:
            built = len(left)
            hashes = np.concatenate([sets[i] for i in left])
            owner = np.repeat(left, sizes[left])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
        at = queue.pop()
        a, b = np.searchsorted(hashes, sets[at], "left"), np.searchsorted(hashes, sets[at], "right")
        many = b - a
        where = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[where], minlength=n)[left]
        near = both * (1 + LIKENESS) >= LIKENESS * (sizes[at] + sizes[left]) - 1e-9
        if near.any():
            label[left[near]] = label[at]
            queue += left[near].tolist()
            left = left[~near]
    return label


def like_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, root) of the classes: keys of shingle sets, linked where their
    exact Jaccard is at least LIKENESS. Candidates come from the trie self-join of the sets' SimHashes; as that
    radius leaves out most pairs near LIKENESS, sets that share a band of least hashes and lie within LIKE_BITS are
    candidates too. Every candidate class is then linked by its sets themselves."""
    marked = durable(_marked(docs, id_col, text_col))
    nodes = marked.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("bands is not null")
    nodes = durable(nodes)
    found = durable(connected_components(_trie_links(nodes.select("key", "fp")).unionByName(_candidate_links(nodes))))
    holders = marked.join(found.select(F.col("node").alias("key")), "key", "left_semi").select("doc_id").distinct()
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.join(holders.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def sets(batches):
        for batch in batches:
            for _, n, own, h in _shingle_sets(batch.column(0)):
                key, some, begin = _set_keys(n, own, h)
                end = np.append(begin[1:], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key[some])), pa.array([h[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())], pa.binary())],
                    names=["key", "hashes"],
                )

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    members = texts.mapInArrow(sets, "key long, hashes binary").join(found.withColumnRenamed("node", "key"), "key")
    dealt = members.repartition(parts, "root").sortWithinPartitions("root", "key")

    def link(batches):
        root, keys, held = None, [], []

        def flush():
            names = [keys[i] for i in like_sets(held).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64())], names=["key", "root"])

        for batch in batches:
            for k, h, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if r != root:
                    if keys:
                        yield flush()
                    root, keys, held = r, [], []
                if not keys or keys[-1] != k:
                    keys.append(k)
                    held.append(np.frombuffer(h.as_py(), U64))
        if keys:
            yield flush()

    return marked.select("doc_id", "key"), durable(dealt.select("key", "hashes", "root").mapInArrow(link, "key long, root long"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each class of like_classes the row with the least id stays (rows
    without an id come last), of rows with one id and one set any one. Unlike texts under one id are rows of
    their own. Texts are shuffled once, to leave out the rows that go (not at all while those are few enough
    to be broadcast)."""
    marked, classes = like_classes(docs, id_col, text_col)
    rows = marked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).join(classes, "key", "left")
    rows = durable(rows.select("doc_id", "key", "n", F.coalesce("root", "key").alias("root")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("f"))
    going = rows.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("key") == F.col("f.key"))))
    going = going.select(F.col("doc_id").alias("_id"), F.col("key").alias("_going"))
    plain, i = positional(docs, id_col)
    keyed = plain.mapInArrow(_with_key(docs, text_col), T.StructType([*plain.schema.fields, T.StructField("key", T.LongType())]))
    kept = keyed.join(going, (F.col("key") == F.col("_going")) & keyed[i].cast("long").eqNullSafe(F.col("_id")), "left_anti")
    if not rows.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([i, "key"])
    return kept.select(*plain.columns).toDF(*docs.columns)


def _with_key(docs: DataFrame, text_col: str):
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            own = [np.zeros(0, U64)]
            own += [_set_keys(n, owner, h)[0] for _, n, owner, h in _shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(np.concatenate(own)))], names=[*batch.schema.names, "key"])

    return run


def hex_result(classes: DataFrame) -> DataFrame:
    return classes.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
