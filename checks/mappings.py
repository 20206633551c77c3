"""The driver's tables seen as source tables of the engine.

Two views, both made of row-local expressions:

``user_tables``   a stay is a user; text events and lab values, no vitals
``order_tables``  a stay is an order; wide vitals from line items, and labels
                  that conflict

Keys start at 0 and stay ids at 1, so a stay is key + 1. Offsets are minutes
since a fixed instant in the middle of the data, so that they take both signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators.outcomes import LabelRules

# 2024-01-15 00:00 and 1998-07-01 00:00, in microseconds.
USER_ORIGIN = 1_705_276_800_000_000
ORDER_ORIGIN = 899_251_200_000_000

# Outcome fields and words of the order view.
ORDER_RULES = LabelRules(
    fields=(("patient", "orderstatus"), ("vitalPeriodic", "linestatusid")),
    negative=("o",),
    positive=("f",),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def minutes_since(timestamp: str, origin: int) -> Column:
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    return F.floor((micros - origin) / 60_000_000).cast("double")


def stay(key: str) -> Column:
    return (F.col(key) + 1).alias(STAY_ID)


def user_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Patients from customers and labels, clinical tables from events.

    Labels are further patient rows of the same stay, so no join is needed.
    A text offset of "not recorded" stands where the value is below 1.
    """
    customers = read(spark, sf_dir, "customer").select(
        stay("c_custkey"),
        F.floor(F.abs("c_acctbal") / 100).cast("string").alias("age"),
        F.when(F.col("c_nationkey") < 10, "Female")
        .when(F.col("c_nationkey") < 20, " male ")
        .otherwise("Other")
        .alias("gender"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias(
            "hospitaladmitsource"
        ),
        F.col("c_mktsegment").alias("unittype"),
        F.lit(None).cast("string").alias("hospitaldischargestatus"),
        F.lit(None).cast("string").alias("unitdischargestatus"),
    )
    labels = read(spark, sf_dir, "labels").select(
        stay("doc_id"),
        *[F.lit(None).cast("string").alias(c) for c in customers.columns[1:5]],
        F.when(F.col("quality") == 1, "Alive").alias("hospitaldischargestatus"),
        F.when(F.col("toxic") == 1, "EXPIRED").otherwise("alive").alias("unitdischargestatus"),
    )
    events = read(spark, sf_dir, "events")
    offset = (
        F.when(F.col("value") < 1, F.lit("not recorded"))
        .otherwise(minutes_since("ts", USER_ORIGIN).cast("bigint").cast("string"))
    )
    text = F.concat_ws(" ", "event_type", "props")

    def source(event_type: str, text_column: str, offset_column: str) -> DataFrame:
        return events.where(F.col("event_type") == event_type).select(
            stay("user_id"), text.alias(text_column), offset.alias(offset_column)
        )

    return {
        "patient": customers.unionByName(labels),
        "diagnosis": source("error", "diagnosisstring", "diagnosisoffset"),
        "medication": source("purchase", "drugname", "drugstartoffset"),
        "infusionDrug": source("signup", "drugname", "infusionoffset"),
        "treatment": source("view", "treatmentstring", "treatmentoffset"),
        "lab": events.select(
            stay("user_id"),
            F.col("event_type").alias("labname"),
            F.col("value").alias("labresult"),
            offset.alias("labresultoffset"),
        ),
    }


def order_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Patients from orders, wide vitals and a second label from line items."""
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem")
    return {
        "patient": orders.select(stay("o_orderkey"), F.col("o_orderstatus").alias("orderstatus")),
        "diagnosis": orders.select(
            stay("o_orderkey"),
            F.col("o_orderpriority").alias("diagnosisstring"),
            minutes_since("o_orderdate", ORDER_ORIGIN).alias("diagnosisoffset"),
        ),
        "medication": lines.select(
            stay("l_orderkey"),
            F.concat_ws("-", F.lit("flag"), "l_returnflag", "l_linestatus").alias("drugname"),
            minutes_since("l_shipdate", ORDER_ORIGIN).alias("drugstartoffset"),
        ),
        "vitalPeriodic": lines.select(
            stay("l_orderkey"),
            minutes_since("l_shipdate", ORDER_ORIGIN).alias("observationoffset"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extended price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_linestatus").alias("linestatusid"),
        ),
    }
