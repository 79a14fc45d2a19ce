"""Intermediate tables in the shared checkpoint folder.

Loops write their state here after each round. Unlike a cached DataFrame this
survives the loss of executors, cuts the lineage, and is computed once.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temp folder only where the
    driver is the only process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        return tempfile.gettempdir()
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


#: Rows of a table that may be broadcast.
SMALL_ROWS = 100_000
#: Whether Spark deletes the shuffle files of a query at its end, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    For narrow tables of one row per source or fetch; they are computed here, once.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


class Scratch:
    """Writes DataFrames below one folder per job and reads them back."""

    def __init__(self, spark: SparkSession, label: str = "job"):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/feedtriage-{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def save(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """Write and read back. ``n_rows`` and ``metrics`` (aggregates over the
        written rows) are gathered by the write itself, without another job. The shuffle
        files of the write go with its end.

        A task that runs again may count twice, so callers use these numbers as
        sizes or as zero/non-zero only.
        """
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        seen = Observation(f"{name}-{self._n}")
        exprs = [F.count(F.lit(1)).alias("n_rows")]
        exprs += [expr.alias(key) for key, expr in metrics.items()]
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.observe(seen, *exprs).write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        out.metrics = seen.get
        out.n_rows = out.metrics["n_rows"]
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path is not None and path.startswith(self.root + "/"):
            self._delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables saved so far but these, once no later plan reads the others."""
        kept = {df._scratch_path for df in tables}
        for path in self._paths:
            if path not in kept:
                self._delete(path)
        self._paths = [path for path in self._paths if path in kept]

    def clear(self) -> None:
        """Delete all tables of the job, once its results are written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(jvm_path, True)
