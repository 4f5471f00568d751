"""Helpers shared by the training-data operators.

Every operator reads its text column through :func:`text_or_empty` or treats
a null as the empty text itself, selects only the columns it needs (so extra
columns, whatever their names, never clash), and returns a fresh DataFrame.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where unset (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidex-checkpoint-"))
        folder = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def bounded_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """Keeps Arrow batches of texts small in the session of ``df``, by rows and by bytes: whole texts may be long.

    The setting stays lowered, as plans are run later; a session that wants larger batches
    sets it again after its plan is built, at the cost of memory.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, most)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table in the shared folder, where lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Like :func:`checkpointed` for wide rows: a compressed Parquet table in the shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For :func:`stored`: rows of megabytes.  Sizes are looked at after each row, not after the first hundred, so that
#: a row group, which writers hold in memory and readers take at once, has some of them only, however many a task writes.
HUGE_ROWS = {
    "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false",
}


def free_prefix(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` begins with it, in either case of letters."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(wanted.lower()) for c in names):
        wanted = f"_{wanted}"
    return wanted


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_bucket(id_col: str, modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def held_out(id_col: str) -> Column:
    return id_bucket(id_col) == F.lit(2)
