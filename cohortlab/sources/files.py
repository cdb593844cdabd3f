"""Readers and writers: image folders, tables, archived exports, pipe tables, documents."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators.constraints import ConstraintViolation, accepted

#: Image suffixes, and how an archived export begins.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
SHEET_MARK = "<PARSED TEXT FOR SHEET"


def discover_images(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, path, length) of all images below root, suffix in any case; raises if
    there is none. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", f"^.*?{base.replace('.', '[.]')}/", "")
    found = files.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$")).select(relative.alias("relative_path"), "path", "length")
    if found.isEmpty():
        raise ConstraintViolation(f"no images under {root}")
    return found


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of the session, deleted when Python ends; on a
    single machine that names none, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cohortlab-files-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/cohortlab-files-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(gone)
    return path


def dataset_root(spark: SparkSession, root: str) -> str:
    """`root`, or the folder `images` below it: the one that has both split folders. Looked up
    through Spark's file systems, so that the root may be in any store."""
    jvm = spark.sparkContext._jvm
    paths = [root.rstrip("/"), root.rstrip("/") + "/images"]
    for path in paths:
        found = [jvm.org.apache.hadoop.fs.Path(f"{path}/{split}") for split in ("training", "testing")]
        store = found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if all(store.exists(p) and store.getFileStatus(p).isDirectory() for p in found):
            return path
    raise ConstraintViolation(f"no training and testing folders in {' or '.join(paths)}")


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header under an explicit schema: identifiers keep their leading zeros."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", escape='"')


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every cell as it stands in the file, as text: for exact comparisons."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", escape='"', multiLine=True)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, complete or not at all: the committer publishes files only at the end."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def archived_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole files -> (line number, line) of their CSV, header first.

    An export with a sheet mark loses that line, and its next line all up to the first '>'.
    """
    lines = F.split(F.col(text_col), "\r?\n")
    marked = F.startswith(F.col(text_col), F.lit(SHEET_MARK))
    accepted(texts, ~marked | F.contains(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), F.lit(">")), "malformed sheet prefix")
    head = F.regexp_replace(F.get(lines, F.lit(1)), "^[^>]*>", "")
    body = F.when(marked, F.concat(F.array(head), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))))).otherwise(lines)
    return texts.select(F.posexplode(body).alias("n", "line")).where(F.trim("line") != "")


def read_archived(texts: DataFrame, schema: str) -> DataFrame:
    """The data rows of archived exports under a schema; the header is not read."""
    rows = archived_lines(texts).where(F.col("n") > 0)
    return rows.select(F.from_csv("line", schema, {"mode": "FAILFAST", "escape": '"'}).alias("r")).select("r.*")


def read_archived_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_archived(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), schema)


def pipe_table(lines: DataFrame, columns: list[str], most: int = 8, line_col: str = "line") -> DataFrame:
    """Rows of a markdown table, lines that begin with a bar and a space, whose first cell is
    1 .. most; commas and percent signs go. Rows of another width are refused."""
    cells = F.transform(F.split(F.col(line_col), r"\|"), lambda c: F.regexp_replace(F.trim(c), "[,%]", ""))
    inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
    rows = lines.where(F.startswith(F.trim(F.col(line_col)), F.lit("| "))).select(inner.alias("c")).where(F.col("c")[0].isin([str(k) for k in range(1, most + 1)]))
    accepted(rows, F.size("c") == len(columns), "unexpected width of a pipe table")
    return rows.select(*[F.col("c")[i].alias(name) for i, name in enumerate(columns)])


def pipe_rows_of(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return pipe_table(spark.read.text(path).withColumnRenamed("value", "line"), columns)


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell, cell_type, source) of a notebook document."""
    doc = spark.read.json(path, multiLine=True, schema="cells array<struct<cell_type: string, source: array<string>>>")
    return doc.select(F.posexplode("cells").alias("cell", "c")).select("cell", "c.cell_type", F.array_join("c.source", "").alias("source"))


def to_document(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def identity(df: DataFrame) -> DataFrame:
    """Adds `identity`, the sha256 of each row as JSON with its fields in order of name."""
    return df.withColumn("identity", F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256))


def require_rows(df: DataFrame, n: int, what: str = "table") -> DataFrame:
    """`df`, after checking that it has n rows."""
    found = df.limit(n + 1).count()
    if found != n:
        raise ConstraintViolation(f"{what}: {'more' if found > n else found} rows instead of {n}")
    return df


def write_document(df: DataFrame, path: str) -> None:
    to_document(df).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


@dataclass(frozen=True)
class Settings:
    """Settings with defaults; the environment (upper-case names with a prefix) overrides them."""

    seed: int = 42
    resamples: int = 5000
    threshold: float = 0.5
    qualifying_trials: int = 30
    out: str = "outputs"
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "COHORTLAB_") -> Settings:
        found = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
        kinds = {"seed": int, "resamples": int, "threshold": float, "qualifying_trials": int, "out": str}
        known = {k: kind(found.pop(k)) for k, kind in kinds.items() if k in found}
        return cls(**known, extra=found)
