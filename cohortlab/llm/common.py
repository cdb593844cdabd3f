"""Shared pieces of the training-data operators.

Work that several actions read is written once as Parquet below the cluster's
shared checkpoint folder (`spark.checkpoint.dir`), so that a lost executor costs
a re-read and never a recomputation of a half-gone cache.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:8]
#: Words of the data contracts: runs of anything but space, tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; on a single machine that names none, a local one.

    On a cluster without spark.checkpoint.dir it raises: a local folder there is not shared.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cohortlab-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


_folders: set[str] = set()


def release() -> None:
    """Delete the tables this application has written to shared folders. Results that were
    not written or collected by then cannot be read any more; called when Python ends."""
    jvm = SparkContext._jvm
    while _folders and jvm:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        release()


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: short lineage, known size."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/cohortlab-{spark.sparkContext.applicationId}-{_RUN}"
    _folders.add(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a key table that is broadcast (about 60 bytes each).
BROADCAST_ROWS = 500_000


def sized(keys: DataFrame) -> DataFrame:
    """A materialised key table, marked for broadcast only if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def text_key(text_col: str) -> Column:
    """md5 of the text; null counts as the empty text."""
    return F.md5(text_or_empty(text_col).cast("binary"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_crc(id_col: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def source_key(col: str) -> Column:
    """A never-null key that sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(col).cast("string")), F.lit("1"))


def row_hash(seed: int, id_col: str, text_col: str) -> Column:
    """Hex digest of (seed, id, text): the order in which rows are taken or dealt."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit("|"), text_or_empty(text_col)).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
