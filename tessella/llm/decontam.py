"""Benchmark decontamination by SimHash of item-sized windows.

For every item of m words, windows of m words of every document are fingerprinted over their 5-word
shingles and looked up in a multi-index: with radius + 1 blocks of the 64 bits, any fingerprint
within the radius agrees with the item's in one whole block. Candidates within the radius are
verified by their exact weighted-shingle similarity, sum of the least over sum of the greatest
multiplicities, on the words themselves.

Windows that could not reach the similarity whatever their fingerprint are passed over without loss: a
window with similarity s to an item of n shingles shares at least 2 s n / (1 + s) of them, and a
window's shared shingles are counted from one lookup of the document's shingles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SIGNS, U64, shingles, text_chunks, words

K = 5
SIMILARITY = 0.8
#: Bits; the expected distance at similarity 0.8 is under 10 with a deviation under 3.
RADIUS = 16
#: Items that one pass over the documents looks for, and their characters: more go in more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Windows fingerprinted at once.
WINDOWS = 1024


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes (any number of rows, equally long)."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(*hashes.shape, 8), axis=-1)
    return np.packbits(2 * bits.sum(axis=-2, dtype=np.int32) > hashes.shape[-1], axis=-1).view(">u8").reshape(hashes.shape[:-1]).astype(U64)


@dataclass
class Size:
    """The items of m words: their vocabulary of shingles, fingerprints and multi-index."""

    m: int
    k: int
    items: list = field(default_factory=list)
    hashes: list = field(default_factory=list)

    def close(self, radius: int) -> None:
        table = np.stack(self.hashes)
        self.vocabulary = np.unique(table)
        self.prints = simhash(table)
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            shift, mask = U64(64 - b), U64((1 << (b - a)) - 1)
            value = (self.prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.blocks.append((shift, mask, value[order], order))

    def within(self, prints: np.ndarray, radius: int):
        """(window, item, distance) of all fingerprints within the radius."""
        pairs = []
        for shift, mask, value, order in self.blocks:
            asked = (prints >> shift) & mask
            lo, hi = np.searchsorted(value, asked, "left"), np.searchsorted(value, asked, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            item = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs.append(window * len(self.items) + item)
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.items), pair % len(self.items)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        near = distance <= radius
        return window[near], item[near], distance[near]


def _words_of(data: bytes, starts, ends) -> list[bytes]:
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _shingle_counts(parts: list[bytes], k: int) -> Counter:
    return Counter(tuple(parts[i : i + k]) for i in range(len(parts) - k + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets."""
    least = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return least / max(sum(a.values()) + sum(b.values()) - least, 1)


class Index:
    """Items ready to be looked for. Items without words are never found."""

    def __init__(self, items: list[tuple[int, str]], k: int = K, radius: int = RADIUS, least: float = SIMILARITY):
        self.k, self.radius, self.least = k, radius, least
        self.sizes: dict[int, Size] = {}
        self.counts = {}
        for item, text in items:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, rows, hashes = words(np.array([0, len(data)]), data, SIGNS)
            if not len(starts):
                continue
            m = len(starts)
            size = self.sizes.setdefault(m, Size(m, min(k, m)))
            size.items.append(item)
            size.hashes.append(shingles(rows, hashes, size.k)[1])
            self.counts[item] = _shingle_counts(_words_of(raw.translate(LOWER), starts, ends), size.k)
        by_k = defaultdict(list)
        for size in self.sizes.values():
            size.close(radius)
            by_k[size.k].append(size)
        self.by_k = dict(by_k)
        self.all = {n: np.unique(np.concatenate([s.vocabulary for s in x])) for n, x in by_k.items()}
        self.sieve = {}
        for n, v in self.all.items():
            self.sieve[n] = np.zeros(1 << 20, bool)
            self.sieve[n][(v & U64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, offsets: np.ndarray, data: np.ndarray):
        """{(row, item): (similarity, distance, first word, words)}, the best window of each pair."""
        best: dict = {}
        starts, ends, rows, hashes = words(offsets, data, SIGNS)
        if not len(starts):
            return best
        low = None
        n_rows = len(offsets) - 1
        first = np.searchsorted(rows, np.arange(n_rows + 1))
        for k, sizes in self.by_k.items():
            at, sh = shingles(rows, hashes, k)
            maybe = np.flatnonzero(self.sieve[k][(sh & U64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[np.isin(sh[maybe], self.all[k])]
            if not len(maybe):
                continue
            full = np.zeros(len(hashes), U64)
            full[at] = sh
            hit_at, hit_hash = at[maybe], sh[maybe]
            for size in sizes:
                hits = hit_at[np.isin(hit_hash, size.vocabulary)]
                if not len(hits):
                    continue
                n = size.m - k + 1
                need = int(np.ceil(2 * self.least * n / (1 + self.least) - 1e-9))
                length = first[1:] - first[:-1]
                begin = np.unique((hits[:, None] - np.arange(n)[None, :]).ravel())
                row = rows[hits[np.minimum(np.searchsorted(hits, begin), len(hits) - 1)]]
                begin = np.clip(begin, first[row], np.maximum(first[row + 1] - size.m, first[row]))
                begin, at_ = np.unique(begin, return_index=True)
                row = row[at_]
                span = np.minimum(length[row], size.m) - k + 1  # a shorter document is one window
                count = np.searchsorted(hits, begin + span) - np.searchsorted(hits, begin)
                # a window of fewer shingles than the item's needs a smaller part of the two
                needed = np.where(span < n, np.ceil(self.least * (span + n) / (1 + self.least) - 1e-9), need)
                ok = count >= needed
                begin, span = begin[ok], span[ok]
                for width in np.unique(span):
                    of = begin[span == width]
                    for c in range(0, len(of), WINDOWS):
                        own = of[c : c + WINDOWS]
                        prints = simhash(full[own[:, None] + np.arange(width)[None, :]])
                        window, item, distance = size.within(prints, self.radius)
                        order = np.lexsort((own[window], distance))
                        for w, i, d in zip(window[order].tolist(), item[order].tolist(), distance[order].tolist()):
                            b = int(own[w])
                            key = (int(rows[b]), size.items[i])
                            if key in best and best[key][0] == 1.0:
                                continue
                            if low is None:
                                low = data.tobytes().translate(LOWER)
                            e = b + int(width) + k - 1
                            got = similarity(_shingle_counts(_words_of(low, starts[b:e], ends[b:e]), k), self.counts[size.items[i]])
                            if got >= self.least and (key not in best or got > best[key][0]):
                                best[key] = (got, d, b - int(first[key[0]]), e - b)
        return best


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of bounded size, each block read on its own."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text"))
    rows = rows.where(F.col("item").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["c"] or 0) // BLOCK_CHARS))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in part.orderBy("item").collect()]


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of every document
    that holds an item at a similarity of at least `least`, one row for each document row and item.

    Letters A-Z count as a-z; words are parted by spaces and ASCII signs. Items of fewer than 5 words
    are one shingle. A document shorter than the item is one window. Null and empty texts hold
    nothing; null items are left out, equal items are found each; rows with a null id are reported
    with it. Empty tables give empty results.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark):
        index = Index(items, least=least)

        def run(batches, index=index):
            for batch in batches:
                ids = batch.column(0)
                for i, _, offsets, data in text_chunks(batch.column(1)):
                    found = sorted(index.find(offsets, data).items())
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array([i + key[0] for key, _ in found])),
                                pa.array([key[1] for key, _ in found], pa.int64()),
                                pa.array([x[2] for _, x in found], pa.int64()),
                                pa.array([x[3] for _, x in found], pa.int64()),
                                pa.array([x[1] for _, x in found], pa.int32()),
                                pa.array([x[0] for _, x in found], pa.float64()),
                            ],
                            names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                        )

        one = rows.mapInArrow(run, SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows are judged where they lie, unshuffled."""
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark):
        index = Index(items, least=least)

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, offsets, data in text_chunks(batch.column(at).cast(pa.string())):
                    for row, _ in index.find(offsets, data):
                        keep[i + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
