"""Export and import of a repository's stored tables as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def export(tables: dict[str, DataFrame], path: str, by: str = "repo_name") -> None:
    """One folder per table, partitioned by repository, so one repository is read or replaced alone."""
    for name, df in tables.items():
        df.repartition(by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, name: str, repo: str | None = None, by: str = "repo_name") -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df if repo is None else df.where(df[by] == repo)
