"""Tolerant parsing of dates, numbers and flags, and small numeric rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "dd-MM-yyyy"


def parse_date(c: Column) -> Column:
    """Day-first date; anything else is null."""
    return F.try_to_timestamp(c, F.lit(DATE_FORMAT)).cast("date")


def format_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, DATE_FORMAT), F.lit(""))


def to_number(c: Column) -> Column:
    """Number or null; never NaN, which Spark would sort above every number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_flag(c: Column) -> Column:
    upper = F.upper(c.cast("string"))
    return F.when(upper == "TRUE", True).when(upper == "FALSE", False)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def bucket_50(amount: Column) -> Column:
    """Nearest multiple of 50, halves to even."""
    return F.bround(amount / 50) * 50


def relative_difference(value: Column, base: Column) -> Column:
    return F.abs(value - base) / F.greatest(base, F.lit(1.0))


def cost_ratio(second: Column, largest: Column) -> Column:
    return F.try_divide(second, largest)


def is_true(predicate: Column) -> Column:
    """A null predicate counts as false."""
    return F.coalesce(predicate, F.lit(False))


def log_amount(amount: Column) -> Column:
    return F.log1p(F.coalesce(amount.cast("double"), F.lit(0.0)))


def bucket_label(value: Column, edges: Sequence[float]) -> Column:
    """`bin_i` for right-closed intervals between the distinct edges; null gives 'nan'."""
    label = F.lit(0)
    for edge in sorted(set(edges)):
        label = label + F.when(value > F.lit(float(edge)), 1).otherwise(0)
    return F.when(value.isNull(), "nan").otherwise(F.concat(F.lit("bin_"), label.cast("string")))


def fill_missing(df: DataFrame) -> DataFrame:
    """Numbers to 0, `_count` and `_distinct` to bigint, strings to ''. Other types stay."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name.endswith(("_count", "_distinct")):
            c = F.coalesce(to_number(c).cast("bigint"), F.lit(0).cast("bigint"))
        elif isinstance(field.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        columns.append(c.alias(field.name))
    return df.select(*columns)


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Empty text and the usual spellings of 'missing' become null, over all string columns."""
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(list(tokens)), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
