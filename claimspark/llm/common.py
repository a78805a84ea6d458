"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import BATCH_BYTES, bounded_batches, materialize, shared_dir

__all__ = ["BATCH_BYTES", "WORD", "bounded_batches", "chunks", "in_training", "materialize", "merged", "shared_dir", "table", "text_of"]

#: A word of the contracts: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the data, so neither is ever broadcast.

    Spark takes a row of an exploded array for no more than a row of its parent, and a column of a written table for its
    share of the packed file, so it would collect tables on the driver that are 50 times the broadcast threshold.
    """
    return left.hint("merge").join(right, on, how)


def in_training(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt: crc32 of the identifier as text leaves 0 or 2 by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def chunks(texts: list[str], budget: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `budget` characters, so that work on a batch has bounded memory.

    One text is never divided: a longer one makes a range of its own.
    """
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > budget:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
