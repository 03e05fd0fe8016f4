"""A store of named tables and stage results on any path that Spark reads and writes.

The manifest is itself a table: one row for each stage with its done flag, parameter hash, content hash
and outputs. Writing is append-only; the newest row of a stage counts.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "stage string, done boolean, params string, content string, outputs array<string>, seq long, info map<string,string>"


def content_hash(df: DataFrame) -> DataFrame:
    """One row, hash: equal for equal rows in any order (repeated rows count). Each row's md5 over its
    columns in order of name; sums of two parts of the digests, so one aggregation and no sort."""
    text = F.concat_ws("|", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in sorted(df.columns)])
    d = F.md5(text.cast("binary"))
    part = lambda a: F.sum(F.conv(F.substring(d, a, 8), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(9).cast("string")).alias("hash"))


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Tables under one root: <root>/<name>, partitioned as asked."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name))

    def load(self, name: str, columns: Sequence[str] = ()) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def has(self, name: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # the manifest

    def manifest(self) -> DataFrame:
        """The newest row of each stage."""
        if not self.has("_manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(self.path("_manifest"))
        w = Window.partitionBy("stage").orderBy(F.desc("seq"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def mark(self, stage: str, done: bool, params: dict, outputs: Sequence[str] = (), info: dict | None = None) -> None:
        content = "+".join(content_hash(self.load(o)).first()["hash"] for o in outputs) if done else ""
        row = [(stage, done, params_hash(params), content, list(outputs), time.time_ns(), {k: str(v) for k, v in (info or {}).items()})]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(self.path("_manifest"))

    def done(self, stage: str, params: dict) -> bool:
        """Whether the stage's newest row says done, under equal parameters."""
        row = self.manifest().where(F.col("stage") == stage).first()
        return bool(row and row["done"] and row["params"] == params_hash(params))

    # states by iteration

    def checkpoint(self, name: str, state: DataFrame, iteration: int, params: dict, keep: int = 2) -> None:
        """Save a state; of the same parameters the newest `keep` stay."""
        tag = params_hash(params)[:12]
        state.write.mode("overwrite").parquet(self.path(f"{name}/{tag}-{iteration:08d}"))
        own = sorted(n for n in Store(self.spark, self.path(name)).names() if n.startswith(tag))
        for old in own[:-keep]:
            self.drop(f"{name}/{old}")

    def find_checkpoint(self, name: str, params: dict, most: int) -> tuple[int, DataFrame] | None:
        """The newest state of the same parameters at or before an iteration."""
        tag = params_hash(params)[:12]
        its = [int(n[len(tag) + 1 :]) for n in Store(self.spark, self.path(name)).names() if n.startswith(tag)]
        at = max((i for i in its if i <= most), default=None)
        return None if at is None else (at, self.load(f"{name}/{tag}-{at:08d}"))

    # frames

    def add_frame(self, name: str, key: int, frame: DataFrame) -> None:
        """Append a frame; one of the same key is replaced."""
        self.save(f"{name}/key={key:08d}", frame)

    def clear_frames(self, name: str, after: int) -> None:
        for n in Store(self.spark, self.path(name)).names():
            if n.startswith("key=") and int(n[4:]) > after:
                self.drop(f"{name}/{n}")


def with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the named columns, zero where it has none."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})
