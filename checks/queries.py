"""Registered queries: the engine's operators over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.functions.labels import outcome_label
from chartweave.functions.numbers import event_time, finite_number, gap_token, quartile_bin
from chartweave.functions.text import (
    age_bin,
    build_token,
    gender_part,
    normalize_text,
    token_family,
)
from chartweave.operators.categorical import extract_categorical_events, static_events
from chartweave.operators.numeric import (
    extract_numeric_events,
    fit_numeric_bins,
    lab_rows,
    measurement_rows,
)
from chartweave.operators.outcomes import excluded_stays, extract_outcomes
from chartweave.operators.quality import (
    is_prohibited_feature,
    outcome_violations,
    statistics_violations,
    stream_violations,
    token_violations,
)
from chartweave.operators.sequences import kept_sequences
from chartweave.operators.shared_storage import shared_folder
from chartweave.operators.statistics import exclusions
from chartweave.operators.tables import stay_universe
from chartweave.plans.build import StreamBuild, plan_event_streams, plan_long_streams, stream_positions
from chartweave.plans.prepare import prepare_streams
from chartweave.sources.csv_tables import load_tables, table_path
from chartweave.sources.stream_files import (
    read_event_streams_jsonl,
    write_event_streams_jsonl,
)
from checks import protocol, protocol_events
from checks.mappings import (
    ORDER_ORIGIN,
    ORDER_RULES,
    USER_ORIGIN,
    minutes_since,
    order_tables,
    read,
    stay,
    user_tables,
)

Query = Callable[[SparkSession, str], DataFrame]


def _text(array: Column) -> Column:
    return F.array_join(array, "|", "null")


def _times_text(times: Column) -> Column:
    return _text(F.transform(times, lambda time: time.cast("bigint").cast("string")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the driver's tables, whole."""

    def part(kind: str, table: str, key: str, text: str, number: Column) -> DataFrame:
        return read(spark, sf_dir, table).select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            number.cast("bigint").alias("part"),
            F.col(text).alias("text"),
        )

    zero = F.lit(0)
    return (
        part("document", "documents", "doc_id", "text", zero)
        .unionByName(part("conversation", "conversations", "conv_id", "text", F.col("turn")))
        .unionByName(part("benchmark", "benchmark", "item_id", "text", zero))
        .unionByName(part("page", "pages", "page_id", "html", zero))
        .unionByName(part("url", "pages", "page_id", "url", zero))
    )


# Scalar functions ---------------------------------------------------------------


def normalize_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = normalize_text(F.col("text"))
    return (
        _texts(spark, sf_dir)
        .withColumn("token", token)
        .select(
            "kind",
            "id",
            "part",
            F.md5("token").alias("token_md5"),
            F.length("token").cast("bigint").alias("token_length"),
            F.md5(normalize_text(F.col("text"), True)).alias("kept_unknown_md5"),
        )
    )


def age_bin_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    masked = F.when(balance < 0, F.lit("> 89")).otherwise(
        F.concat(F.lit(" "), F.floor(balance / 100).cast("string"), F.lit(" "))
    )
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        age_bin(F.floor(balance / 80)).alias("from_balance"),
        age_bin(masked).alias("masked"),
    )


def gender_part_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_nationkey")
    text = (
        F.when(key < 8, " Female").when(key < 16, "m").when(key < 20, "Unknown").when(key < 24, "???")
    )
    return read(spark, sf_dir, "customer").select("c_custkey", gender_part(text).alias("gender"))


def parse_number_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.regexp_replace("props", "[^0-9]", "")
    return read(spark, sf_dir, "events").select(
        "event_id",
        finite_number(digits).alias("plain"),
        finite_number(F.concat(digits, F.lit("d"))).alias("suffixed"),
        finite_number(F.concat(digits, F.lit("e1"))).alias("scientific"),
        finite_number(F.concat(F.lit("  -"), digits, F.lit(".5 "))).alias("padded"),
        finite_number(F.col("props")).alias("not_a_number"),
        finite_number(F.col("value").cast("string")).alias("from_value"),
    )


def event_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("value") < 1, "not recorded").otherwise(
        minutes_since("ts", USER_ORIGIN).cast("bigint").cast("string")
    )
    return read(spark, sf_dir, "events").select("event_id", event_time(text).alias("event_time"))


def quartile_bin_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = (F.lit(50.0), F.lit(100.0), F.lit(200.0))
    return read(spark, sf_dir, "events").select(
        "event_id", quartile_bin(F.col("value"), *edges).alias("bin")
    )


def outcome_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, labels = read(spark, sf_dir, "orders"), read(spark, sf_dir, "labels")
    number = F.col("quality") + F.col("toxic")
    text = F.when(F.col("toxic") == 1, " Died ").otherwise("SURVIVED")
    types = labels.select(number.alias("n")).schema
    return (
        orders.select(
            F.col("o_orderkey").alias("id"),
            F.lit("orderstatus").alias("field"),
            outcome_label(F.col("o_orderstatus"), negative=("o",), positive=("f",)).alias("label"),
        )
        .unionByName(
            labels.select(
                F.col("doc_id").alias("id"),
                F.lit("number").alias("field"),
                outcome_label(number, types["n"].dataType).alias("label"),
            )
        )
        .unionByName(
            labels.select(
                F.col("doc_id").alias("id"),
                F.lit("text").alias("field"),
                outcome_label(text).alias("label"),
            )
        )
    )


def gap_token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", gap_token(minutes_since("ts", USER_ORIGIN)).alias("token")
    )


def token_family_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = extract_categorical_events(user_tables(spark, sf_dir), representation="basic")
    return (
        events.groupBy("token")
        .agg(F.count("*").alias("events"))
        .select("token", token_family(F.col("token")).alias("family"), "events")
    )


def prohibited_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select(
        "kind", "id", "part", is_prohibited_feature(F.col("text")).alias("prohibited")
    )


# Events ---------------------------------------------------------------------------


def static_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_events(user_tables(spark, sf_dir)).drop("row_order")


def clinical_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = user_tables(spark, sf_dir)
    return extract_categorical_events(tables, representation="basic").drop("row_order")


def categorical_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = user_tables(spark, sf_dir)
    return extract_categorical_events(tables, representation="timegap_static").drop("row_order")


def categorical_events_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = order_tables(spark, sf_dir)
    return extract_categorical_events(tables, representation="timegap").drop("row_order")


def lab_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab_rows(user_tables(spark, sf_dir))


def vital_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement_rows(order_tables(spark, sf_dir))


# Numeric --------------------------------------------------------------------------


def _rounded(thresholds: DataFrame) -> DataFrame:
    edges = [F.round(edge, 6).alias(edge) for edge in ("p25", "p50", "p75")]
    return thresholds.select("measurement", *edges)


def fit_bins_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit_numeric_bins(user_tables(spark, sf_dir)))


def fit_bins_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit_numeric_bins(order_tables(spark, sf_dir)))


def fit_bins_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of measurements that are too large to rank in one task."""
    return _rounded(fit_numeric_bins(order_tables(spark, sf_dir), max_ranked_rows=0))


def _numeric(tables: dict[str, DataFrame]) -> DataFrame:
    return extract_numeric_events(tables, fit_numeric_bins(tables))[0]


def numeric_events_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric(user_tables(spark, sf_dir))


def numeric_events_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric(order_tables(spark, sf_dir))


def _counters(tables: dict[str, DataFrame], unfitted: str) -> DataFrame:
    thresholds = fit_numeric_bins(tables).where(F.col("measurement") != unfitted)
    return extract_numeric_events(tables, thresholds)[1]


def numeric_counters_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(user_tables(spark, sf_dir), "LAB::CLICK")


def numeric_counters_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(order_tables(spark, sf_dir), "VITAL::TAX")


# Outcomes -------------------------------------------------------------------------


def outcomes_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_outcomes(user_tables(spark, sf_dir))[0]


def outcomes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_outcomes(order_tables(spark, sf_dir), ORDER_RULES)[0]


def outcome_stats_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_outcomes(user_tables(spark, sf_dir))[1]


def outcome_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_outcomes(order_tables(spark, sf_dir), ORDER_RULES)[1]


def excluded_stays_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded_stays(order_tables(spark, sf_dir), ORDER_RULES)


# Streams --------------------------------------------------------------------------


def _users(
    spark: SparkSession, sf_dir: str, representation: str, minimum: int, **options: object
) -> StreamBuild:
    return plan_event_streams(user_tables(spark, sf_dir), representation, minimum, **options)


def _orders(
    spark: SparkSession, sf_dir: str, representation: str, minimum: int, **options: object
) -> StreamBuild:
    tables = order_tables(spark, sf_dir)
    return plan_event_streams(tables, representation, minimum, rules=ORDER_RULES, **options)


def _as_text(streams: DataFrame) -> DataFrame:
    return streams.select(
        STAY_ID,
        "representation",
        _text(F.col("events")).alias("events_text"),
        _times_text(F.col("event_times")).alias("times_text"),
        F.size("events").cast("bigint").alias("n_events"),
    )


def streams_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_users(spark, sf_dir, "basic", 1).streams)


def streams_timegap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_users(spark, sf_dir, "timegap", 1).streams)


def streams_timegap_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_users(spark, sf_dir, "timegap_static", 5).streams)


def streams_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_orders(spark, sf_dir, "timegap", 5).streams)


def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = plan_long_streams(user_tables(spark, sf_dir), "timegap", 1).positions
    return positions.where(token_family(F.col("token")) == "TIME_GAP")


def stream_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_long_streams(user_tables(spark, sf_dir), "timegap_static", 5).positions


def streams_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of hot stays: users with more than 100 values span several rows."""
    build = _users(spark, sf_dir, "timegap_static", 5, max_row_events=100)
    return stream_positions(build.streams)


def streams_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = _orders(spark, sf_dir, "timegap", 5, max_row_events=60)
    return stream_positions(build.streams)


def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = _users(spark, sf_dir, "timegap_static", 1).sequences
    return kept_sequences(sequences, 100).select(STAY_ID, "mortality", "n_events")


def stay_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusions(_users(spark, sf_dir, "timegap_static", 1).sequences, 100)


def stay_universe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stay_universe(user_tables(spark, sf_dir))


def _statistics_text(statistics: DataFrame) -> DataFrame:
    entries = F.sort_array(F.map_entries("token_family_counts"))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ",",
    )
    return statistics.withColumn("families_text", text).drop("token_family_counts")


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics_text(plan_long_streams(user_tables(spark, sf_dir), "timegap_static", 5).statistics)


def event_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = order_tables(spark, sf_dir)
    return _statistics_text(plan_long_streams(tables, "timegap", 5, rules=ORDER_RULES).statistics)


# Data quality ---------------------------------------------------------------------


def stream_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on two-event records whose second event is rarely valid."""
    status = F.col("o_orderstatus")
    price = F.col("o_totalprice")
    second_time = F.when(price >= 100000, F.floor(price / 1000).cast("double"))
    records = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(STAY_ID),
        F.array(build_token("DX", normalize_text(F.col("o_orderpriority"))), status).alias("events"),
        F.when(status == "O", "basic").when(status == "F", "timegap").otherwise("raw").alias(
            "representation"
        ),
        F.array(minutes_since("o_orderdate", ORDER_ORIGIN), second_time).alias("event_times"),
    )
    return stream_violations(records)


def token_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("lang") == "en", "DX").when(F.col("lang") == "de", "LAB")
    tokens = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(STAY_ID),
        F.concat(
            F.coalesce(family, F.col("lang")),
            F.when(F.col("source").endswith("1"), ":").otherwise("::"),
            F.col("text"),
        ).alias("token"),
    )
    return token_violations(tokens).select(STAY_ID, "rule", F.md5("detail").alias("detail_md5"))


def outcome_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias(STAY_ID), (F.col("quality") + F.col("toxic")).alias("mortality")
    )
    return outcome_violations(labels)


def stats_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, event counts in the place of statistics that should add up."""
    views = F.count_if(F.col("event_type") == "view")
    errors = F.count_if(F.col("event_type") == "error")
    statistics = (
        read(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_stays"),
            views.alias("kept_stays"),
            errors.alias("skipped_stays"),
            views.alias("min_sequence_length"),
            errors.alias("max_sequence_length"),
            F.avg("value").alias("median_sequence_length"),
            F.create_map(F.lit("DX"), errors, F.lit("LAB"), views).alias("token_family_counts"),
        )
    )
    return statistics_violations(statistics)


# Sources and sinks ----------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/chartweave/{name}-{uuid.uuid4().hex}"


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a table as CSV, load it with the engine's loader."""
    folder = _scratch(spark, "csv-source")
    read(spark, sf_dir, "orders").select(
        stay("o_orderkey"),
        F.col("o_orderpriority").alias("diagnosisstring"),
        minutes_since("o_orderdate", ORDER_ORIGIN).alias("diagnosisoffset"),
        F.col("o_orderstatus").alias("extra"),
    ).write.option("header", True).csv(table_path(folder, "diagnosis"))
    loaded = load_tables(spark, folder, ["diagnosis"])["diagnosis"]
    return loaded.withColumn("diagnosisoffset", event_time(F.col("diagnosisoffset")))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "streams-jsonl")
    streams = _users(spark, sf_dir, "timegap_static", 5).streams
    write_event_streams_jsonl(streams, path, min_events_per_stay=5)
    return _as_text(read_event_streams_jsonl(spark, path))


def prepare_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: CSV tables in, artifacts out, artifacts read back."""
    raw, out = _scratch(spark, "job-raw"), _scratch(spark, "job-out")
    tables = user_tables(spark, sf_dir)
    for name, frame in tables.items():
        frame.write.option("header", True).csv(table_path(raw, name))
    for name in ("apachePatientResult", "vitalPeriodic", "vitalAperiodic"):
        tables["patient"].select(STAY_ID).where(F.lit(False)).write.option("header", True).csv(
            table_path(raw, name)
        )
    prepare_streams(spark, raw, out)
    streams = read_event_streams_jsonl(spark, f"{out}/event_streams.jsonl")
    outcomes = spark.read.option("header", True).schema(f"{STAY_ID} bigint, mortality int").csv(
        f"{out}/outcomes.csv"
    )
    return streams.join(outcomes, STAY_ID).select(
        STAY_ID,
        "mortality",
        _text(F.col("events")).alias("events_text"),
        _times_text(F.col("event_times")).alias("times_text"),
    )


def queries() -> dict[str, Query]:
    return {
        "normalize_text": normalize_text_query,
        "age_bin": age_bin_query,
        "gender_part": gender_part_query,
        "parse_number": parse_number_query,
        "event_time": event_time_query,
        "quartile_bin": quartile_bin_query,
        "outcome_label": outcome_label_query,
        "gap_token": gap_token_query,
        "token_family": token_family_query,
        "prohibited_features": prohibited_features_query,
        "static_events": static_events_query,
        "clinical_events": clinical_events_query,
        "categorical_events": categorical_events_query,
        "categorical_events_orders": categorical_events_orders,
        "lab_measurements": lab_measurements,
        "vital_unpivot": vital_unpivot,
        "fit_bins_users": fit_bins_users,
        "fit_bins_orders": fit_bins_orders,
        "fit_bins_by_interval": fit_bins_by_interval,
        "numeric_events_users": numeric_events_users,
        "numeric_events_orders": numeric_events_orders,
        "numeric_counters_users": numeric_counters_users,
        "numeric_counters_orders": numeric_counters_orders,
        "outcomes_users": outcomes_users,
        "outcomes_orders": outcomes_orders,
        "outcome_stats_users": outcome_stats_users,
        "outcome_stats_orders": outcome_stats_orders,
        "excluded_stays_orders": excluded_stays_orders,
        "streams_basic": streams_basic,
        "streams_timegap": streams_timegap,
        "streams_timegap_static": streams_timegap_static,
        "streams_orders": streams_orders,
        "time_gaps": time_gaps,
        "stream_positions": stream_positions_query,
        "streams_split": streams_split,
        "streams_split_orders": streams_split_orders,
        "min_length_filter": min_length_filter,
        "stay_exclusions": stay_exclusions,
        "stay_universe": stay_universe_query,
        "event_stats": event_stats,
        "event_stats_orders": event_stats_orders,
        "stream_violations": stream_violations_query,
        "token_violations": token_violations_query,
        "outcome_violations": outcome_violations_query,
        "stats_violations": stats_violations,
        "csv_source": csv_source,
        "jsonl_roundtrip": jsonl_roundtrip,
        "prepare_job": prepare_job,
    } | protocol.queries() | protocol_events.queries()
