"""Lenient numbers: measurements, offsets, quartile bins and gap buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.contract import GAP_BUCKETS, QUARTILE_LABELS
from chartweave.functions.text import build_token

# A plain decimal number. Spark's own cast also takes "1.0d" and "5f".
_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def finite_number(value: Column, data_type: T.DataType | None = None) -> Column:
    """The finite double in ``value``, else null; nothing here ever raises.

    ``data_type`` is the type of ``value``; numeric columns then skip the text
    route. Booleans are not numbers.
    """
    if isinstance(data_type, T.BooleanType):
        return F.lit(None).cast("double")
    infinity = F.lit(float("inf"))
    if isinstance(data_type, T.NumericType):
        number = value.cast("double")
        return F.when((number < infinity) & (number > -infinity), number)
    text = value.cast("string")
    # A literal such as 1e999 is a number, but not a finite one.
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.nullif(F.nullif(number, infinity), -infinity)


def event_time(offset: Column, data_type: T.DataType | None = None) -> Column:
    """Minutes since admission as a double; an unusable offset gives null.

    Negative zero becomes zero, so that the two compare as one instant.
    """
    return finite_number(offset, data_type) + F.lit(0.0)


def quartile_bin(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Quartile label of a number; every edge belongs to the bin below it."""
    q1, q2, q3, q4 = QUARTILE_LABELS
    return (
        F.when(value.isNull() | p25.isNull(), F.lit(None).cast("string"))
        .when(value <= p25, F.lit(q1))
        .when(value <= p50, F.lit(q2))
        .when(value <= p75, F.lit(q3))
        .otherwise(F.lit(q4))
    )


def gap_token(minutes: Column) -> Column:
    """``TIME_GAP::<bucket>`` for a positive interval, else null."""
    bucket = F.when(minutes <= 0, F.lit(None).cast("string"))
    for upper, name in GAP_BUCKETS:
        reached = minutes.isNotNull() if upper is None else minutes <= upper
        bucket = bucket.when(reached, F.lit(name))
    return build_token("TIME_GAP", bucket)
