"""Cutting the lineage of tables that iterations build on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="evidex-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later steps read the columns that they need."""
    path = f"{shared_folder(df).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """Keeps Arrow batches of wide rows small in the session of ``df``; the setting stays lowered, as plans are run later."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= size):
        conf.set(key, size)
    return df
