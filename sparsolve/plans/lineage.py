"""Where lineage is cut: reliable checkpoints in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..types import Matrix


def ensure_folder(spark: SparkSession) -> None:
    """spark.checkpoint.dir as the cluster names it; a temporary folder only where none is set on one machine (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="sparsolve-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def cut_matrix(a: Matrix) -> Matrix:
    return Matrix(cut(a.df), a.nrows, a.ncols)
