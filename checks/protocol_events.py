"""Registered queries of the protocol's own tokens, and their SQL twins.

A stay is a user of ``events``; its times are spread over 3,000 minutes, so that some lie outside the window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators import metrics, protocol, protocol_events
from checks.mappings import USER_ORIGIN, minutes_since, read, stay
from checks.protocol import _PREDICTIONS, _ranking_sql, prediction_rows

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources with null ids, unusable texts and names, missing times and ids in place of drug names."""
    events = read(spark, sf_dir, "events")
    value = F.col("value")
    events = events.select(
        "event_id",
        "event_type",
        "value",
        F.when(F.col("event_id") % 50 != 7, F.col("user_id") + 1).alias(STAY_ID),
        F.when(value >= 1, F.pmod(minutes_since("ts", USER_ORIGIN), F.lit(3000)) - 200).alias("minute"),
        F.concat(F.lit("  "), F.regexp_replace("props", '[{}":]', ""), F.lit("\t kind \n "), F.col("event_type")).alias("text"),
    )

    def source(kind: str, offset: str, *columns: Column) -> DataFrame:
        return events.where(F.col("event_type") == kind).select(STAY_ID, F.col("minute").alias(offset), *columns)

    customers = read(spark, sf_dir, "customer")
    age = F.floor(F.abs("c_acctbal") / 100)
    return {
        "patient": customers.select(
            stay("c_custkey"),
            F.when(age > 89, "> 89").when(age != 50, age.cast("string")).alias("age"),
            F.when(F.col("c_nationkey") < 10, " Female ").when(F.col("c_nationkey") < 20, "male").otherwise("other").alias("gender"),
            F.concat(F.lit("Nation \t "), F.col("c_nationkey").cast("string")).alias("unitadmitsource"),
            F.col("c_mktsegment").alias("unittype"),
        ),
        "diagnosis": source("error", "diagnosisoffset", F.when(value < 40, F.col("text")).otherwise("N/A").alias("diagnosisstring")),
        "medication": source(
            "purchase",
            "drugstartoffset",
            F.when(value >= 20, F.col("text")).alias("drugname"),
            F.when(value >= 5, F.floor("value").cast("int")).alias("drughiclseqno"),
        ),
        "infusionDrug": source("signup", "infusionoffset", F.col("text").alias("drugname")),
        "treatment": source("view", "treatmentoffset", F.col("text").alias("treatmentstring")),
        "lab": events.select(
            STAY_ID,
            F.when(F.col("event_id") % 11 != 3, F.concat("event_type", F.lit(" "), F.floor(F.col("event_id") / 10) % 3)).alias("labname"),
            F.when(value < 60, F.when(value < 50, value)).alias("labresult"),
            F.col("minute").alias("labresultoffset"),
            "event_id",
        ),
    }


def protocol_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol_events.static_tokens(_tables(spark, sf_dir)["patient"])


def protocol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source row with its token and the reason against it; medication ids in place of names."""
    return protocol_events.categorical_rows(_tables(spark, sf_dir))


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol_events.lab_values(_tables(spark, sf_dir)["lab"], ["event_id"])


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol_events.coverage_report(protocol_rows(spark, sf_dir), _labs(spark, sf_dir))


def _last_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.last_per_minute(_labs(spark, sf_dir).where("reason IS NULL"), ["event_id"])


def supported_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = read(spark, sf_dir, "customer").where("c_custkey % 10 < 7").select(stay("c_custkey"))
    return protocol_events.supported_bins(_last_labs(spark, sf_dir), training)


def binned_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol_events.binned(_last_labs(spark, sf_dir), supported_bins(spark, sf_dir))


def protocol_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of the text sources and of labs by name, in the protocol's order with its gaps."""
    texts = protocol_rows(spark, sf_dir).where("reason IS NULL").select(STAY_ID, "token", "event_time")
    labs = _last_labs(spark, sf_dir).select(STAY_ID, F.col("measurement").alias("token"), "event_time")
    return protocol_events.protocol_positions(protocol_static(spark, sf_dir), texts.unionByName(labs))


def density_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = read(spark, sf_dir, "orders").select(stay("o_orderkey"))
    return protocol_events.density_cohorts(stays, read(spark, sf_dir, "lineitem").select(stay("l_orderkey")))


def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.result_summary(prediction_rows(spark, sf_dir), "patient", by=["fold"])


def queries() -> dict[str, Query]:
    return {
        "protocol_static": protocol_static,
        "protocol_rows": protocol_rows,
        "coverage_report": coverage_report,
        "supported_bins": supported_bins,
        "binned_labs": binned_labs,
        "protocol_positions": protocol_positions,
        "density_cohorts": density_cohorts,
        "result_summary": result_summary,
    }


_STATIC = """
static_ AS (
  SELECT c_custkey + 1 AS stay, unnest([
    {'field': 0, 'token': 'STATIC::AGE_BIN::' || CASE WHEN age > 89 OR age >= 80 THEN '80_PLUS' WHEN age = 50 THEN 'UNKNOWN'
      WHEN age < 18 THEN '0_17' WHEN age < 40 THEN '18_39' WHEN age < 60 THEN '40_59' ELSE '60_79' END},
    {'field': 1, 'token': 'STATIC::GENDER::' || CASE WHEN c_nationkey < 10 THEN 'FEMALE' WHEN c_nationkey < 20 THEN 'MALE' ELSE 'UNKNOWN' END},
    {'field': 2, 'token': 'STATIC::UNIT_ADMIT_SOURCE::NATION_' || c_nationkey},
    {'field': 3, 'token': 'STATIC::UNIT_TYPE::' || upper(c_mktsegment)}], recursive := true)
  FROM (SELECT *, floor(abs(c_acctbal) / 100) AS age FROM customer))"""

def _edge(share: float) -> str:
    """Linear interpolation between neighbours, from the nearer one (the last bit depends on that)."""
    place = f"(support - 1) * {share}::DOUBLE"
    low, high, part = f"s[CAST(floor({place}) AS BIGINT) + 1]", f"s[CAST(ceil({place}) AS BIGINT) + 1]", f"({place} - floor({place}))"
    return f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} ELSE {high} - ({high} - {low}) * (1 - {part}) END"


_ROWS = f"""
seen AS (
  SELECT event_id, event_type, value, CASE WHEN event_id % 50 <> 7 THEN user_id + 1 END AS stay,
    CASE WHEN value >= 1 THEN ((m % 3000) + 3000) % 3000 - 200 END AS t,
    upper(regexp_replace(trim(regexp_replace(props, '[{{}}":]', '', 'g')), '\\s+', '_', 'g')) || '_KIND_' || upper(event_type) AS x
  FROM (SELECT *, floor((epoch_us(ts) - {USER_ORIGIN}) / 60000000.0) AS m FROM events)),
named AS (
  SELECT stay, t, CASE event_type WHEN 'error' THEN 'diagnosis' WHEN 'purchase' THEN 'medication'
      WHEN 'signup' THEN 'infusionDrug' ELSE 'treatment' END AS source,
    CASE event_type WHEN 'error' THEN CASE WHEN value < 40 THEN 'DX::' || x END
      WHEN 'purchase' THEN CASE WHEN value >= 20 THEN 'MED::' || x WHEN value >= 5 THEN 'MED::HICL::' || CAST(floor(value) AS INTEGER) END
      WHEN 'signup' THEN 'INFUSION::' || x ELSE 'TREATMENT::' || x END AS token
  FROM seen WHERE event_type IN ('error', 'purchase', 'signup', 'view')),
rows_ AS (
  SELECT *, CASE WHEN stay IS NULL THEN 'missing_stay' WHEN token IS NULL THEN 'unusable_text' WHEN t IS NULL THEN 'no_time'
    WHEN t NOT BETWEEN 0 AND 1440 THEN 'outside_window' END AS reason FROM named),
labs AS (
  SELECT *, CASE WHEN stay IS NULL THEN 'missing_stay' WHEN measurement IS NULL THEN 'unusable_name'
    WHEN v IS NULL THEN 'nonnumeric_value' WHEN t IS NULL THEN 'no_time' WHEN t NOT BETWEEN 0 AND 1440 THEN 'outside_window' END AS reason
  FROM (SELECT stay, t, event_id, CASE WHEN event_id % 11 <> 3 THEN 'LAB::' || upper(event_type) || '_' || ((event_id // 10) % 3) END AS measurement,
    CASE WHEN value < 50 THEN value END AS v FROM seen)),
last_ AS (
  SELECT stay, measurement, v, t FROM labs WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY stay, measurement, t ORDER BY event_id DESC) = 1),
sorted_ AS (
  SELECT measurement, list_sort(list(v)) AS s, count(*) AS support
  FROM last_ JOIN customer ON c_custkey + 1 = stay WHERE c_custkey % 10 < 7 GROUP BY measurement HAVING count(*) >= 50),
bins AS (SELECT measurement, {_edge(0.25)} AS p25, {_edge(0.5)} AS p50, {_edge(0.75)} AS p75, support FROM sorted_)"""

_PLACED = """
cohort AS (
  SELECT DISTINCT stay, t, token FROM (
    SELECT stay, t, token FROM rows_ WHERE reason IS NULL UNION ALL SELECT stay, t, measurement FROM last_)
  WHERE stay IN (SELECT stay FROM static_)),
lagged AS (
  SELECT *, row_number() OVER w AS place, lag(t) OVER w AS earlier FROM cohort
  WINDOW w AS (PARTITION BY stay ORDER BY t,
    list_position(['DX', 'LAB', 'VITAL', 'MED', 'INFUSION', 'TREATMENT'], split_part(token, '::', 1)), token)),
gapped AS (
  SELECT *, CASE WHEN t > earlier THEN 'TIME_GAP::' || CASE WHEN t - earlier <= 15 THEN '0_15M' WHEN t - earlier <= 60 THEN '16_60M'
    WHEN t - earlier <= 180 THEN '61_180M' WHEN t - earlier <= 360 THEN '181_360M' ELSE 'GT_360M' END END AS gap FROM lagged),
shifted AS (SELECT *, 3 + place + count(gap) OVER (PARTITION BY stay ORDER BY place) AS position FROM gapped)"""


def oracle_sql() -> dict[str, str]:
    stay_ = f"stay AS {STAY_ID}"
    return {
        "protocol_static": f"WITH {_STATIC} SELECT {stay_}, field, token FROM static_",
        "protocol_rows": f"WITH {_ROWS} SELECT {stay_}, source, token, t AS event_time, reason FROM rows_",
        "coverage_report": f"""WITH {_ROWS}
SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS rows
FROM (SELECT source, reason FROM rows_ UNION ALL SELECT 'lab', reason FROM labs) GROUP BY ALL""",
        "supported_bins": f"WITH {_ROWS} SELECT measurement, p25, p50, p75, support FROM bins",
        "binned_labs": f"""WITH {_ROWS}
SELECT {stay_}, t AS event_time, CASE WHEN p25 IS NULL THEN 'low_support' END AS reason,
  measurement || '::' || CASE WHEN p25 IS NULL THEN NULL WHEN v <= p25 THEN 'Q1' WHEN v <= p50 THEN 'Q2' WHEN v <= p75 THEN 'Q3' ELSE 'Q4' END AS token
FROM last_ LEFT JOIN bins USING (measurement)""",
        "protocol_positions": f"""WITH {_STATIC}, {_ROWS}, {_PLACED}
SELECT {stay_}, CAST(field AS BIGINT) AS position, token, 0.0::DOUBLE AS event_time FROM static_
UNION ALL SELECT stay, position, token, t FROM shifted
UNION ALL SELECT stay, position - 1, gap, t FROM shifted WHERE gap IS NOT NULL""",
        "density_cohorts": f"""
WITH sizes AS (
  SELECT o_orderkey + 1 AS stay, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders GROUP BY o_orderkey),
cuts AS (SELECT quantile_cont(n, 1 / 3.0::DOUBLE) AS low, quantile_cont(n, 2 / 3.0::DOUBLE) AS high FROM sizes)
SELECT {stay_}, n AS n_events, CASE WHEN n <= low THEN 'low' WHEN n <= high THEN 'medium' ELSE 'high' END AS density FROM sizes, cuts""",
        "result_summary": _summary_sql(),
    }


def _summary_sql() -> str:
    return f"""WITH {_PREDICTIONS}, weighted AS (SELECT *, 1 AS times FROM predictions), {_ranking_sql('weighted', 'fold')},
counts AS (
  SELECT fold, count(DISTINCT patient) AS patients, count(*) AS stays, count(*) FILTER (WHERE label = 1) AS positive_stays,
    count(*) FILTER (WHERE label = 0) AS negative_stays FROM predictions GROUP BY fold)
SELECT c.*, auroc, average_precision, note FROM counts c JOIN ranked r ON r.fold IS NOT DISTINCT FROM c.fold"""
