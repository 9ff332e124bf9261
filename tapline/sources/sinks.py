"""Writers (A8-A14).  Every sink is an overwrite of a directory, so a retried
job (after executor loss) rewrites the same output instead of appending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                **options) -> str:
    w = df.write.mode("overwrite").format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    return write_table(df, path, "csv", header=str(header).lower(),
                       timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")


def save_model(pm, path: str) -> str:
    """Fitted pipeline (prep + model) as a directory."""
    pm.write().overwrite().save(path)
    return path


def load_model(path: str):
    """A5: read a saved pipeline back."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
