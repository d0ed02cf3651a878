"""What the operators of this subpackage share: cutting lineage, checked broadcasts, digests of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, narrow_batches, shared_dir  # noqa: F401

#: A side with at most this many (short) rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count of its (already written) rows stays within most."""
    return F.broadcast(df) if df.count() <= most else df


def id_text(column: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32(id as text) mod modulus, by which rows are held out."""
    return F.crc32(id_text(column).cast("binary")) % modulus


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
