"""What the corpus operators share: durable tables, and vectorised access to Arrow text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set: one of our own in local mode (tests), and an
    error on a cluster, whose machines share no folder that we could choose."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder: a lost executor costs a reread, not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the executions inside go when each ends; for jobs that read no shuffle twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder, and its path: columnar and compressed, for large
    intermediates; the caller drops it."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def positional(docs: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """docs with its columns named c0, c1, ... by place, and the new names of the given ones (by exact name,
    the first of its kind): whatever a caller's columns are called, none meets a working column."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, *[f"c{docs.columns.index(n)}" for n in names]


def free_names(taken: list[str], *names: str) -> list[str]:
    """Each name, with underscores after it until no column in `taken` is called so, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (first row, end row, offsets, bytes) of runs of rows with at most max_bytes of UTF-8
    (one row at least, whole texts always). Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


#: Bytes to lower-case: A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes that part words: the space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: As SPACE, with the other ASCII signs that are neither letters nor digits.
SIGNS = SPACE.copy()
SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)


def words(offsets: np.ndarray, data: np.ndarray, apart: np.ndarray = SPACE, prefix: int = 0):
    """(start, end, row, hash) of every word of a chunk; words never cross rows, A-Z count as a-z.
    With a prefix: also the hash of each word's first bytes, so many at most."""
    n = len(data)
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.astype(U64), *[none.astype(U64)] * bool(prefix))
    if not n:
        return empty
    low = _LOWER[data]
    inside = ~apart[low]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(ends) + 1
    # the sum of byte * base ** place over a word is a difference of running sums, turned back to place 0
    table, back = _places(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * table[:n], out=total[1:])
    begin, turn = total[starts], back[starts]
    hashes = mix((total[ends] - begin) * turn + (ends - starts).astype(U64))
    out = starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes
    if prefix:
        out = *out, mix((total[np.minimum(ends, starts + prefix)] - begin) * turn)
    return out


_BASE = 0x9E3779B97F4A7C15
_KEPT: list[tuple[np.ndarray, np.ndarray]] = []


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, for n places; kept for a chunk's size."""
    if n > CHUNK_BYTES:
        return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    if not _KEPT:
        _KEPT.append((powers(_BASE, CHUNK_BYTES), powers(pow(_BASE, -1, 1 << 64), CHUNK_BYTES)))
    return _KEPT[0]


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int):
    """(first word, hash) of all runs of k words within a row, from the hashes of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    table = powers(0xD6E8FEB86659FD93, k + 1)[1:]
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * table[j]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, mix(total[at])


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U64).view(np.int64)


def whole_groups(batches, keys: int, *names: str):
    """Runs of complete groups of a partition that is sorted by its first `keys` columns, as lists of numpy
    arrays: a batch at a time, the last group held back until its end is seen."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            got = [np.concatenate([a, b]) for a, b in zip(held, got)]
        new = np.zeros(len(got[0]), bool)
        for c in got[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield [c[:cut] for c in got]
        held = [c[cut:] for c in got]
    if held is not None:
        yield held


def let(value: Column, body) -> Column:
    """body(value), the value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def hex64(column):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
