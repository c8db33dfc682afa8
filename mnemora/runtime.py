"""Session helpers: table access, durable cut points, skew-proof lookups."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE; hence at most HOT_SHARE keys are.
HOT_SHARE = 500
#: No key is treated as hot below this many rows, where one task copes anyway.
HOT_LEAST = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session, as theirs may not find it where the driver does."""
    sc = spark.sparkContext
    if getattr(sc, "_mnemora_shipped", False):
        return
    root = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="mnemora-")) / "mnemora_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(to))  # Spark serves it to all executors
    sc._mnemora_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and there is one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mnemora-"))
    return sc.getCheckpointDir()


_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives the loss of executors.

    A checkpoint hands on what is known of its columns, and in a loop that knowledge grows with each round until planning takes longer
    than running; it is hence not gathered.
    """
    spark = df.sparkSession
    shared_dir(spark)
    was = spark.conf.get(_CONSTRAINTS, "true")
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(_CONSTRAINTS, was)


def hot_keys(df: DataFrame, key: str, rows: int | None = None, least: int | None = None) -> list:
    """Values of ``key`` that hold more than one in HOT_SHARE of all rows: at most HOT_SHARE values, whatever the size.

    ``rows`` bounds the row count from above if the caller knows it. Nulls never count as hot.
    """
    least = HOT_LEAST if least is None else least
    if rows is not None and rows <= least:
        return []
    rows = df.count() if rows is None else rows
    most = max(least, rows // HOT_SHARE)
    return [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > most).select(key).collect()]


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, least: int | None = None
) -> DataFrame:
    """Joins ``left`` to ``right``, in which ``key`` is unique, without sending a hot key's rows to one task.

    Hot keys of ``left`` (at most HOT_SHARE, see hot_keys) meet a broadcast of their rows of ``right``,
    of which there is one a key, so that the broadcast is bounded whatever the size; the others are shuffled.
    Both sides should be durable, as they are read twice when there are hot keys.
    """
    hot = hot_keys(left, key, rows, least)
    if not hot:
        return left.join(right, key, how)
    is_hot: Column = F.col(key).isin(hot)
    rare = left.where(~F.coalesce(is_hot, F.lit(False))).join(right.where(~is_hot), key, how)
    return rare.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
