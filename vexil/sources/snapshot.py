"""An index on disk: four Parquet tables and one row of settings, checked when it is loaded."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vexil.operators.config import IndexConfig
from vexil.operators.ivf import Index

TABLES = ("coarse", "codebook", "codes")


def save(index: Index, path: str) -> None:
    spark = index.codes.sparkSession
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"config": asdict(index.config), "dim": index.dim, "rotation": None if index.rotation is None else index.rotation.tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, expect: IndexConfig | None = None) -> Index:
    """Fails if the settings differ from those expected, or a table lacks a column."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    config = IndexConfig(**meta["config"])
    if expect is not None and expect != config:
        raise ValueError("the snapshot was made with other settings")
    tables: dict[str, DataFrame] = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}
    for name, need in (("coarse", {"stream_id", "list_id", "centroid"}), ("codebook", {"stream_id", "m", "list_id", "centroid"}), ("codes", {"stream_id", "pos", "list_id", "codes", "key_norm"})):
        if not need <= set(tables[name].columns):
            raise ValueError(f"{name} lacks {sorted(need - set(tables[name].columns))}")
    return Index(config, meta["dim"], rotation=None if meta["rotation"] is None else np.array(meta["rotation"]), **tables)
