"""Result sinks: results stay DataFrames and are written by Spark writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ordertide.session import shuffles_dropped


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write a result table (records sink)."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode(mode).format(fmt).options(**options).save(path)


def write_model_result(result: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each DataFrame of a model result (metrics, predictions,
    importances, ...) under ``path/<name>``."""
    for name, df in result.items():
        if isinstance(df, DataFrame):
            write_result(df, f"{path.rstrip('/')}/{name}", fmt)
