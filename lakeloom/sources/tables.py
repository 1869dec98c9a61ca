"""Table access and the scratch area of long plans.

``table`` reads one named Parquet table of a data directory.  ``Scratch``
writes intermediate tables to the folder the cluster shares
(``spark.checkpoint.dir``), so that a lost executor costs a re-read and never a
lost block, and so that iterative plans keep a short lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_rows(df: DataFrame, key: str, columns: list[str], latest: str | None = None) -> DataFrame:
    """One row per ``key`` holding ``columns``; rows with a null key are dropped.

    Repeated deliveries of a row agree in everything but the delivery time, so
    the first of a struct is enough; with ``latest`` the row of the greatest
    time wins.  The aggregate is partial on the map side.
    """
    rest = [c for c in columns if c != key]
    df = df.where(F.col(key).isNotNull())
    row = F.struct(*rest)
    # In a struct a missing time is the oldest; alone it would lose its row.
    pick = F.max_by(row, F.struct(latest)) if latest else F.first(row)
    return df.groupBy(key).agg(pick.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's; a temporary one only where all executors are in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="lakeloom-"))
        atexit.register(_remove_local)
    return _LOCAL[0]


def _remove_local() -> None:
    import shutil

    for d in _LOCAL:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Intermediate tables of one plan, written once and read as often as needed."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lakeloom/{what}-{uuid.uuid4().hex}"
        self.count = 0
        _SCRATCHES.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        # The schema is known, so that an empty table reads as an empty table.
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lakeloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that ``save`` returned once nothing reads it any more."""
        path = getattr(df, "_lakeloom_path", None)
        if path:
            self._delete(path)

    def size(self, df: DataFrame) -> int:
        """Bytes on disk of a saved table."""
        path = self._path(df._lakeloom_path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength()

    def clear(self) -> None:
        self._delete(self.root)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_SCRATCHES: list[Scratch] = []


def clear_scratch() -> None:
    """Remove the intermediate tables of all plans whose results are stored."""
    while _SCRATCHES:
        try:
            _SCRATCHES.pop().clear()
        except Exception:  # the session may be gone already
            pass
