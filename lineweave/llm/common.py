"""What the operators of this subpackage share: intermediate tables, size-checked broadcasts, reading inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.scratch import cut, drop_cut, shared_folder, ship

__all__ = ["cut", "drop_cut", "read", "shared_folder", "ship", "shuffle_partitions", "slices", "small_side", "text_or_empty"]

#: A side may be broadcast up to this many rows of two or three numbers (a few MB); beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks df for broadcast if it has at most BROADCAST_ROWS rows (counted, unless the count is given); else leaves it to a shuffle join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(parts: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in smaller ones, of at most ``rows`` rows and about ``size`` bytes where rows are alike, so that the
    Python objects made from one of them stay few however large the batches are; an empty batch stays one."""
    for part in parts:
        step = max(1, min(rows, size * part.num_rows // max(1, part.nbytes)))
        for at in range(0, max(1, part.num_rows), step):
            yield part.slice(at, step)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
