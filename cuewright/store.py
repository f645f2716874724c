"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cuewright.streaming import shared_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: what follows doesn't run it once more,
    and files outlive any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
