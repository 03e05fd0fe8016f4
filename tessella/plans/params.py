"""Parameters of a run from a mapping or a text: unknown keys are refused, defaults fill the rest."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import Any, TypeVar, get_type_hints

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build(kind: type[T], given: dict[str, Any] | None, where: str = "") -> T:
    """A dataclass from a mapping, nested dataclasses included. Raises on keys that it does not have."""
    given = given or {}
    hints = get_type_hints(kind)
    unknown = sorted(set(given) - set(hints))
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(where + k for k in unknown)}")
    nested = {k: build(hints[k], v, f"{where}{k}.") if dataclasses.is_dataclass(hints[k]) else v for k, v in given.items()}
    return kind(**nested)


def load(spark: SparkSession, kind: type[T], path: str) -> T:
    """Parameters from a JSON (or, with PyYAML there, YAML) file on any path that Spark reads."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yml", ".yaml")):
        import yaml

        return build(kind, yaml.safe_load(text))
    return build(kind, json.loads(text))


def stamp(params: Any) -> str:
    """A hash of parameters, the same for equal ones."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(params), sort_keys=True, default=str).encode()).hexdigest()


def write_shared(df: DataFrame, path: str, mark: str) -> DataFrame:
    """Inputs that many jobs read: written once, with a mark of what they were made from."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").json(f"{path}/mark")
    return spark.read.parquet(f"{path}/data")


def read_shared(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Shared inputs, if they carry the mark; stale ones are refused."""
    found = spark.read.schema("mark string").json(f"{path}/mark").first()
    if found is None or found["mark"] != mark:
        raise ValueError(f"{path} was made from other parameters")
    return spark.read.parquet(f"{path}/data")
