"""Session-level helpers: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured text stays below this many bytes.
BROADCAST_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_billweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="billweave-src-"), "billweave_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(target)
    sc._billweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the project's parquet tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a folder of this machine serves a local session only.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have checkpoints removed once unused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir: executors must see each other's checkpoints")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="billweave-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, *text_columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after measuring a materialised ``df``; otherwise leave the join to shuffle.

    The size is that of the named text columns plus 32 bytes a row, counted over all rows.
    """
    cost = F.lit(32)
    for name in text_columns:
        cost = cost + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    size = df.agg(F.coalesce(F.sum(cost.cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least a task a core, for work that is much against its bytes; a wider one stays as it is."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
