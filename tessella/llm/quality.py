"""Quality classifier: document evidence combined with host and path posteriors.

A document's evidence is the log of its Bayes factor for being fit to train on: a logistic model
over format features and the counts of telling words and word beginnings, with one head for quality and one for
toxicity. Sites are two-level, host and path. Each level's share of fit documents is a
Beta posterior whose prior is centred on the level above (path on host, host on the whole corpus) and
whose strength comes from the spread between sites by the method of moments (empirical Bayes), so
that sparse sites shrink toward the global prior. Sites' sums come from one grouped aggregation with
map-side combining over all documents; a document's own share is taken out of them again for its own
prior. Posterior log odds = prior log odds of the path + evidence.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SIGNS, SPACE, U64, durable, free_names, mix, positional, text_chunks, words

#: Most labelled documents that the classifier is fitted on, chosen by a hash of their ids.
MAX_TRAINING_ROWS = 6000
#: Buckets of hashed words, then as many of hashed word beginnings, and the bytes of a beginning.
WORD_BUCKETS, BEGINNING = 1 << 16, 6
BUCKETS = 2 * WORD_BUCKETS
#: Most words that a head uses, and the least score in standard errors that makes one telling.
MAX_WORDS, LEAST_Z = 384, 4.0
THRESHOLD = 0.5
RESULTS = ("host_share", "path_share", "evidence", "posterior", "keep")
#: Most sites whose table is sent to every task; beyond, documents meet it by a salted join.
BROADCAST_SITES = 50_000
SALTS = 32

_KIND = np.full(256, 5, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[c for c in range(128) if not chr(c).isalnum()]] = 3
_KIND[np.flatnonzero(SPACE)] = 4
_LINES = np.zeros(256, bool)
_LINES[10] = True
N_FORMAT = 13


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = hashes + mix(rows.astype(U64) + U64(1))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(rows[at], minlength=n).astype(float)


def features(offsets: np.ndarray, data: np.ndarray):
    """(format features, rows, buckets, values): a row of numbers for each text, and the distinct
    buckets of each text with the logs of their counts, as aligned arrays."""
    n = len(offsets) - 1
    kind = _KIND[data]
    size = np.diff(offsets).astype(float)
    counts = [_sums(kind == k, offsets) for k in range(6)]
    starts, ends, rows, hashes, begins = words(offsets, data, SIGNS, BEGINNING)
    n_words = np.bincount(rows, minlength=n).astype(float)
    _, _, line_rows, line_hashes = words(offsets, data, _LINES)
    n_lines = np.bincount(line_rows, minlength=n).astype(float)
    letters = counts[0] + counts[1] + counts[5] + 1
    one = np.maximum(size, 1)
    follows = np.append(kind, 4)[ends] == 3 if len(rows) else np.zeros(0, bool)
    marked = np.bincount(rows[follows], minlength=n)
    table = np.stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            *(c / one for c in counts),
            counts[1] / letters,
            _distinct(rows, hashes, n) / np.maximum(n_words, 1),
            1 - _distinct(line_rows, line_hashes, n) / np.maximum(n_lines, 1),
            marked / np.maximum(n_words, 1),
            size / np.maximum(n_words, 1) / 10,
        ],
        axis=1,
    )
    half = U64(WORD_BUCKETS)
    bucket = np.concatenate([hashes % half, begins % half + half]).astype(np.int64)
    pair, count = np.unique(np.tile(rows, 2) * BUCKETS + bucket, return_counts=True)
    return table, pair // BUCKETS, pair % BUCKETS, np.log1p(count)


@dataclass
class Head:
    """A logistic model: centre, scale and weights of the format features, words' buckets and weights."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    buckets: np.ndarray
    word_weights: np.ndarray
    bias: float

    def logit(self, table, rows, buckets, values) -> np.ndarray:
        out = np.clip((table - self.centre) / self.scale, -8, 8) @ self.weights + self.bias
        if len(self.buckets):
            by = np.zeros(BUCKETS)
            by[self.buckets] = self.word_weights
            out += np.bincount(rows, by[buckets] * values, minlength=len(table))
        return out


def fit_head(table, rows, buckets, values, y: np.ndarray, ridge: float = 1.0) -> Head:
    """Select telling words by their log odds in standard errors, then fit by Newton's method."""
    n, pos = len(y), float(y.sum())
    if n == 0 or pos == 0 or pos == n:
        rate = (pos + 1) / (n + 2)
        zero = np.zeros(N_FORMAT)
        return Head(zero, zero + 1, zero, np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    centre, scale = table.mean(0), table.std(0) + 1e-6
    inside = np.bincount(buckets, y[rows], minlength=BUCKETS)
    outside = np.bincount(buckets, minlength=BUCKETS) - inside
    odds = np.log((inside + 0.5) / (pos - inside + 0.5)) - np.log((outside + 0.5) / (n - pos - outside + 0.5))
    error = np.sqrt(1 / (inside + 0.5) + 1 / (pos - inside + 0.5) + 1 / (outside + 0.5) + 1 / (n - pos - outside + 0.5))
    z = np.abs(odds) / error
    z[inside + outside < 5] = 0
    chosen = np.argsort(-z, kind="stable")[:MAX_WORDS]
    chosen = np.sort(chosen[z[chosen] >= LEAST_Z])
    x = np.zeros((n, N_FORMAT + len(chosen) + 1))
    x[:, :N_FORMAT] = np.clip((table - centre) / scale, -8, 8)
    at = np.full(BUCKETS, -1)
    at[chosen] = np.arange(len(chosen))
    has = at[buckets] >= 0
    x[rows[has], N_FORMAT + at[buckets[has]]] = values[has]
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Head(centre, scale, w[:N_FORMAT], chosen, w[N_FORMAT:-1], float(w[-1]))


@dataclass
class Model:
    quality: Head
    toxic: Head
    base: float  # log odds of a fit document among the labelled

    def probability(self, offsets, data) -> np.ndarray:
        f = features(offsets, data)
        good, bad = (1 / (1 + np.exp(-np.clip(h.logit(*f), -30, 30))) for h in (self.quality, self.toxic))
        return np.clip(good * (1 - bad), 1e-6, 1 - 1e-6)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS
) -> Model:
    """Fit on at most about max_rows labelled documents (all of them if there are no more), chosen by
    a hash of the id. Labels with a null id, quality or toxic are left out; of repeated ids one row
    counts. Without labels every document gets even odds."""
    given = labels.select(
        labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("_q"), labels["toxic"].cast("int").alias("_t")
    ).dropna().dropDuplicates(["_id"])
    many = given.count()
    share = min(1.0, max_rows / max(many, 1))
    chosen = given.where(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    met = rows.join(F.broadcast(chosen), "_id").select("_id", "_q", "_t", "_text")  # at most about max_rows ids

    def run(batches):
        for batch in batches:
            for i, j, offsets, data in text_chunks(batch.column(3)):
                table, at, buckets, values = features(offsets, data)
                cuts = np.searchsorted(at, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        batch.column(1)[i:j],
                        batch.column(2)[i:j],
                        pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), N_FORMAT).cast(pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(buckets, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.float32())),
                    ],
                    names=["id", "q", "t", "table", "buckets", "values"],
                )

    # one task fits, so that the driver gets the models and not the table of at most about max_rows rows
    made = met.mapInArrow(run, "id long, q int, t int, table array<double>, buckets array<int>, values array<float>").repartition(1)
    got = made.mapInArrow(_fitted, "model binary").collect()
    if not got:
        return _fit_table(None)
    good, bad, base = pickle.loads(bytes(got[0]["model"]))
    return Model(Head(**good), Head(**bad), base)


def _fitted(batches):
    got = list(batches)
    model = _fit_table(pa.Table.from_batches(got) if got else None)
    parts = pickle.dumps((vars(model.quality), vars(model.toxic), model.base))
    yield pa.RecordBatch.from_arrays([pa.array([parts], pa.binary())], names=["model"])


def _fit_table(got: pa.Table | None) -> Model:
    """The models of a training table, whatever the order of its rows; even odds without rows."""
    n = got.num_rows if got is not None else 0
    if not n:
        none = np.zeros(0, np.int64)
        return Model(*(fit_head(np.zeros((0, N_FORMAT)), none, none, np.zeros(0), np.zeros(0)) for _ in "qt"), 0.0)
    got = got.sort_by("id")
    lists = got.column("buckets").combine_chunks()
    table = got.column("table").combine_chunks().flatten().to_numpy().reshape(n, N_FORMAT)
    rows_of = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    buckets = lists.flatten().to_numpy().astype(np.int64)
    values = got.column("values").combine_chunks().flatten().to_numpy().astype(float)
    q, t = ((got.column(c).to_numpy() == 1).astype(float) for c in ("q", "t"))
    fit_rows = q * (1 - t)
    base = (fit_rows.sum() + 1) / (n + 2)
    return Model(*(fit_head(table, rows_of, buckets, values, y) for y in (q, t)), float(np.log(base / (1 - base))))


def with_probability(docs: DataFrame, model: Model, text_col: str = "text", name: str = "p") -> DataFrame:
    """docs with the classifier's probability that a document is fit, in a column of that name, or with
    underscores after it where docs has one."""
    (name,) = free_names(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, offsets, data in text_chunks(batch.column(at).cast(pa.string())):
                out.append(model.probability(offsets, data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _strength(between: float, mean: float, within: float, sites: float, rows: float) -> float:
    """Pseudo-counts of a level's prior by the method of moments: the fewer, the more its sites differ."""
    spread = max(between - within * max(sites - 1, 0) / max(rows, 1), 1e-9)
    return float(min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6))


@dataclass
class Priors:
    """What the whole corpus says: documents, the sum of their probabilities, and the strength of its prior
    on hosts and of a host's prior on its paths, in documents."""

    n: float
    s: float
    on_hosts: float
    on_paths: float

    def shares(self, p: Column) -> tuple[Column, Column]:
        """(host_share, path_share) for a document of probability p, from the others alone: each sum (n, s of
        the path, hn, hs of the host) is taken without p, so that no document speaks twice."""
        mean = (F.lit(self.s + 0.5) - p) / F.lit(max(self.n, 1.0))
        mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
        own = lambda s, n, k, prior: (F.lit(k) * prior + s - p) / (F.lit(k) + n - 1)
        host = own(F.col("hs"), F.col("hn"), self.on_hosts, mean)
        return host, own(F.col("s"), F.col("n"), self.on_paths, host)


def site_sums(scored: DataFrame, host: Column, path: Column, p: str = "p") -> tuple[DataFrame, Priors]:
    """((host, path, n, s, hn, hs), priors) from all scored documents; null sites are sites."""
    by = scored.groupBy(host.alias("host"), path.alias("path")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("s2")
    )
    by = durable(by)  # a row for each site; all that follows reads it, not the texts
    hosts = by.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("s2").alias("hs2"))
    whole = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hs2").alias("s2"), F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("m2"),
    ).first()
    n = whole["n"] or 1.0
    mean = min(max((whole["s"] or 0.5) / n, 1e-6), 1 - 1e-6)
    within = max((whole["s2"] or 0.0) / n - mean * mean, 0.0)
    k1 = _strength(max((whole["m2"] or 0.0) / n - mean * mean, 0.0), mean, within, whole["sites"], n)
    both = by.join(hosts.select("h", "hn", "hs"), by["host"].eqNullSafe(F.col("h"))).drop("h", "s2")
    share = (F.lit(k1 * mean) + F.col("hs")) / (F.lit(k1) + F.col("hn"))
    spread = both.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - share, 2)).alias("b"), F.count(F.lit(1)).alias("sites")).first()
    k2 = _strength((spread["b"] or 0.0) / n, mean, within, spread["sites"], n)
    return both, Priors(n, whole["s"] or 0.0, k1, k2)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
    max_rows: int = MAX_TRAINING_ROWS,
    broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """docs with the columns host_share, path_share, evidence, posterior and keep (posterior of being
    fit, at least `threshold`), for every row, repeated ones included. Where docs has a column of such a
    name, the added one has an underscore after it.

    A document is fit if its quality is 1 and it is not toxic. The path of a document is its host
    together with path_col. Its prior comes from the other documents of its path, host and corpus; a
    document alone on its site has the level above. Null texts are empty ones; null hosts and paths are
    sites of their own. Empty tables give empty results. Texts are read twice, once for the sites' sums
    and once for the result, and never shuffled unless there are more sites than `broadcast_sites`.
    """
    added = free_names(docs.columns, *RESULTS)
    return _judged(docs, labels, id_col, text_col, host_col, path_col, threshold, max_rows, broadcast_sites).toDF(*docs.columns, *added)


def keep_fit(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that classify keeps, as they are; `how` as there."""
    names = dict(id_col="doc_id", text_col="text", host_col="source", path_col="lang", threshold=THRESHOLD)
    names |= dict(max_rows=MAX_TRAINING_ROWS, broadcast_sites=BROADCAST_SITES) | how
    return _judged(docs, labels, **names).where("keep").drop(*RESULTS).toDF(*docs.columns)


def _judged(docs, labels, id_col, text_col, host_col, path_col, threshold, max_rows, broadcast_sites) -> DataFrame:
    """docs by place, and RESULTS."""
    model = fit(docs, labels, id_col, text_col, max_rows)
    plain, i, t, h, l = positional(docs, id_col, text_col, host_col, path_col)  # noqa: E741
    seen = with_probability(plain.select(plain[h].alias("h"), plain[l].alias("l"), plain[t].alias("t")), model, "t")
    sites, priors = site_sums(seen, F.col("h"), F.col("l"))
    sites = durable(sites)
    scored = with_probability(plain, model, t)
    same = scored[h].eqNullSafe(F.col("host")) & scored[l].eqNullSafe(F.col("path"))
    if sites.count() <= broadcast_sites:
        met = scored.join(F.broadcast(sites), same, "left")
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = scored.withColumn("own", F.pmod(F.xxhash64(i, t), F.lit(SALTS)).cast("int"))
        met = scored.join(salted, same & (F.col("own") == F.col("salt")), "left")
    host, path = priors.shares(F.col("p"))
    evidence = _logit(F.col("p")) - F.lit(model.base)
    odds = _logit(path) + evidence
    values = (host, path, evidence, 1 / (1 + F.exp(-odds)), odds >= float(np.log(threshold / (1 - threshold))))
    return met.select(*plain.columns, *[v.alias(name) for v, name in zip(values, RESULTS)])
