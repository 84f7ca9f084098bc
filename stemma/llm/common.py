"""Shared plumbing of the training-data operators.

Everything here is small and free of policy: where shared intermediate files go, how a
value column is kept apart from the caller's columns, and how rows of a hot key are spread
before a join.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts can be long, so batches hold few of them.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can weigh in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder of the cluster.

    One of this machine's own is made only where the setting is missing and everything runs in
    one process, as in tests; executors elsewhere could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="stemma-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI of the shared folder, on the driver or an executor."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def free_name(df: DataFrame | Iterable[str], stem: str) -> str:
    """A column name that no column of the frame has, in any case of letters."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id has no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def py_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def salt(columns: list[Column], salts: int) -> Column:
    """Spread the rows of one key over a number of buckets by their other columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def all_salts(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
