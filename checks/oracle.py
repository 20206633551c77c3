"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from checks import protocol, protocol_events

USER_ORIGIN = 1705276800000000
ORDER_ORIGIN = 899251200000000

_WHITE = r"E' \t\n\r\x0b\x0c'"
_UNKNOWN = "'', 'n/a', 'na', 'none', 'not available', 'not recorded', 'other', 'unknown'"
_FRAGMENTS = (
    "apache",
    "actualhospitalmortality",
    "actualicumortality",
    "predictedhospitalmortality",
    "predictedicumortality",
    "diedinhospital",
    "hospitaldischargestatus",
    "unitdischargestatus",
    "discharge",
    "lengthofstay",
    "los",
    "activeupondischarge",
)


def norm(x: str, unknown: str = "NULL") -> str:
    folded = f"lower(trim({x}, {_WHITE}))"
    joined = f"regexp_replace(upper(replace({folded}, 'ß', 'ss')), '[^A-Z0-9]+', '_', 'g')"
    return (
        f"CASE WHEN {folded} IN ({_UNKNOWN}) THEN {unknown} "
        f"ELSE nullif(trim({joined}, '_'), '') END"
    )


def number(x: str) -> str:
    plain = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"CASE WHEN regexp_full_match(trim({x}, {_WHITE}), '{plain}') "
        f"THEN TRY_CAST(trim({x}, {_WHITE}) AS DOUBLE) END"
    )


def age(x: str) -> str:
    years = f"TRY_CAST(trim({x}) AS DOUBLE)"
    low = f"CAST(floor({years} / 10) * 10 AS INTEGER)"
    return (
        f"CASE WHEN trim({x}) LIKE '>%89%' THEN '90_PLUS' WHEN {years} < 0 THEN NULL "
        f"WHEN {years} >= 90 THEN '90_PLUS' "
        f"WHEN {years} IS NOT NULL THEN {low} || '_' || ({low} + 10) END"
    )


def gender(x: str) -> str:
    part = norm(x, "'UNKNOWN'")
    return (
        f"CASE WHEN ({part}) IN ('F', 'FEMALE') THEN 'F' WHEN ({part}) IN ('M', 'MALE') THEN 'M' "
        f"WHEN ({part}) IS NOT NULL THEN 'UNKNOWN' END"
    )


def gap(x: str) -> str:
    return (
        f"CASE WHEN ({x}) <= 0 THEN NULL WHEN ({x}) <= 15 THEN 'TIME_GAP::LE_15M' "
        f"WHEN ({x}) <= 60 THEN 'TIME_GAP::15M_1H' WHEN ({x}) <= 180 THEN 'TIME_GAP::1H_3H' "
        f"WHEN ({x}) <= 360 THEN 'TIME_GAP::3H_6H' WHEN ({x}) <= 720 THEN 'TIME_GAP::6H_12H' "
        f"WHEN ({x}) <= 1440 THEN 'TIME_GAP::12H_24H' "
        f"WHEN ({x}) IS NOT NULL THEN 'TIME_GAP::GT_24H' END"
    )


def minutes(ts: str, origin: int) -> str:
    return f"CAST(floor((epoch_us({ts}) - {origin}) / 60000000.0) AS DOUBLE)"


def quartile(v: str, p25: str, p50: str, p75: str) -> str:
    return (
        f"CASE WHEN {v} <= {p25} THEN 'Q1' WHEN {v} <= {p50} THEN 'Q2' "
        f"WHEN {v} <= {p75} THEN 'Q3' WHEN {v} IS NOT NULL THEN 'Q4' END"
    )


def prohibited(x: str) -> str:
    plain = f"lower(replace(replace({x}, '_', ''), '-', ''))"
    return "(" + " OR ".join(f"contains({plain}, '{f}')" for f in _FRAGMENTS) + ")"


EVENT_TEXT = "event_type || ' ' || props"
EVENT_MINUTE = f"CASE WHEN value >= 1 THEN {minutes('ts', USER_ORIGIN)} END"

# The view of a stay as a user: patient rows, clinical rows, measurements.
USER_VIEW = f"""
patients AS (
  SELECT c_custkey + 1 AS stay, CAST(CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS VARCHAR) AS age,
    CASE WHEN c_nationkey < 10 THEN 'Female' WHEN c_nationkey < 20 THEN ' male '
      ELSE 'Other' END AS gender,
    'Nation ' || c_nationkey AS admitted, c_mktsegment AS unit,
    CAST(NULL AS VARCHAR) AS hospital, CAST(NULL AS VARCHAR) AS ward
  FROM customer
  UNION ALL
  SELECT doc_id + 1, NULL, NULL, NULL, NULL, CASE WHEN quality = 1 THEN 'Alive' END,
    CASE WHEN toxic = 1 THEN 'EXPIRED' ELSE 'alive' END
  FROM labels),
statics AS (
  SELECT DISTINCT stay, field, token FROM (
    SELECT stay, 0 AS field, 'STATIC::AGE_BIN::' || ({age('age')}) AS token FROM patients
    UNION ALL SELECT stay, 1, 'STATIC::GENDER::' || ({gender('gender')}) FROM patients
    UNION ALL SELECT stay, 2, 'STATIC::ADMISSION_SOURCE::' || ({norm('admitted', "'UNKNOWN'")})
      FROM patients
    UNION ALL SELECT stay, 3, 'STATIC::UNIT_TYPE::' || ({norm('unit', "'UNKNOWN'")}) FROM patients)
  WHERE token IS NOT NULL),
clinical AS (
  SELECT DISTINCT user_id + 1 AS stay,
    CASE event_type WHEN 'error' THEN 'DX' WHEN 'purchase' THEN 'MED'
      WHEN 'signup' THEN 'INFUSION' WHEN 'view' THEN 'TREATMENT' END
      || '::' || ({norm(EVENT_TEXT)}) AS token,
    {EVENT_MINUTE} AS t
  FROM events WHERE event_type IN ('error', 'purchase', 'signup', 'view')),
measured AS (
  SELECT user_id + 1 AS stay, 'LAB::' || ({norm('event_type')}) AS measurement,
    value, {EVENT_MINUTE} AS t
  FROM events),
raw_labels AS (
  SELECT stay, min(CASE WHEN hospital = 'Alive' THEN 0 END) AS a,
    min(CASE ward WHEN 'alive' THEN 0 WHEN 'EXPIRED' THEN 1 END) AS lo,
    max(CASE ward WHEN 'alive' THEN 0 WHEN 'EXPIRED' THEN 1 END) AS hi
  FROM patients GROUP BY stay),
states AS (
  SELECT stay, CASE WHEN a IS NOT NULL THEN a WHEN lo = hi THEN lo END AS mortality,
    a IS NULL AND lo <> hi AS conflict
  FROM raw_labels),
universe AS (SELECT stay FROM patients UNION SELECT user_id + 1 FROM events)
"""

# The view of a stay as an order.
ORDER_VIEW = f"""
lines AS (
  SELECT l_orderkey + 1 AS stay, *, {minutes('l_shipdate', ORDER_ORIGIN)} AS t FROM lineitem),
statics AS (SELECT 0 AS stay, 0 AS field, '' AS token WHERE FALSE),
clinical AS (
  SELECT DISTINCT o_orderkey + 1 AS stay, 'DX::' || ({norm('o_orderpriority')}) AS token,
    {minutes('o_orderdate', ORDER_ORIGIN)} AS t FROM orders
  UNION
  SELECT stay, 'MED::' || ({norm("'flag-' || l_returnflag || '-' || l_linestatus")}), t FROM lines),
measured AS (
  SELECT stay, 'VITAL::QUANTITY' AS measurement, l_quantity AS value, t FROM lines
  UNION ALL SELECT stay, 'VITAL::EXTENDED_PRICE', l_extendedprice, t FROM lines
  UNION ALL SELECT stay, 'VITAL::DISCOUNT', l_discount, t FROM lines
  UNION ALL SELECT stay, 'VITAL::TAX', l_tax, t FROM lines),
raw_labels AS (
  SELECT stay, max(a) AS a, min(b) AS lo, max(b) AS hi FROM (
    SELECT o_orderkey + 1 AS stay,
      CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS a, NULL AS b FROM orders
    UNION ALL
    SELECT stay, NULL, CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END FROM lines)
  GROUP BY stay),
states AS (
  SELECT stay, CASE WHEN a IS NOT NULL THEN a WHEN lo = hi THEN lo END AS mortality,
    a IS NULL AND lo <> hi AS conflict
  FROM raw_labels),
universe AS (SELECT stay FROM raw_labels)
"""

FITTED = """
thresholds AS (
  SELECT measurement, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
    quantile_cont(value, 0.75) AS p75
  FROM measured WHERE measurement IS NOT NULL AND value IS NOT NULL GROUP BY measurement),
numeric_events AS (
  SELECT DISTINCT stay, measurement || '::' || ({bin}) AS token, t
  FROM measured JOIN thresholds USING (measurement) WHERE value IS NOT NULL)
""".format(bin=quartile("value", "p25", "p50", "p75"))


def sequence(gaps: bool, static: bool) -> str:
    """Long form of the streams: stay, position, token, t."""
    gap_rows = (
        f"""UNION ALL
  SELECT stay, 1, 0, t, token, 0, {gap('t - before')} FROM timed WHERE t > before"""
        if gaps
        else ""
    )
    static_rows = (
        "UNION ALL SELECT stay, 0, field, NULL, token, 1, token FROM statics" if static else ""
    )
    return f"""
timed AS (
  SELECT *, lag(t) OVER (PARTITION BY stay ORDER BY t NULLS LAST, token) AS before
  FROM (SELECT * FROM clinical UNION SELECT * FROM numeric_events)),
merged(stay, section, field, t, sort_token, sub, token) AS (
  SELECT stay, 1, 0, t, token, 1, token FROM timed
  {gap_rows}
  {static_rows}),
placed AS (
  SELECT stay, token, t, row_number() OVER (
      PARTITION BY stay ORDER BY section, field, t NULLS LAST, sort_token, sub) - 1 AS position,
    count(*) OVER (PARTITION BY stay) AS n
  FROM merged)
"""


def kept(minimum: int) -> str:
    return f"""
kept AS (
  SELECT p.*, s.mortality FROM placed p JOIN states s USING (stay)
  WHERE s.mortality IS NOT NULL AND p.n >= {minimum})
"""


def streams(view: str, gaps: bool, static: bool, minimum: int, representation: str) -> str:
    return f"""
WITH {view}, {FITTED}, {sequence(gaps, static)}, {kept(minimum)}
SELECT stay AS patientunitstayid, '{representation}' AS representation,
  string_agg(token, '|' ORDER BY position) AS events_text,
  string_agg(coalesce(CAST(CAST(t AS BIGINT) AS VARCHAR), 'null'), '|' ORDER BY position)
    AS times_text,
  CAST(count(*) AS BIGINT) AS n_events
FROM kept GROUP BY stay
"""


def positions(view: str, gaps: bool, static: bool, minimum: int, where: str = "TRUE") -> str:
    return f"""
WITH {view}, {FITTED}, {sequence(gaps, static)}, {kept(minimum)}
SELECT stay AS patientunitstayid, CAST(position AS BIGINT) AS position, token, t AS event_time
FROM kept WHERE {where}
"""


def statistics(view: str, gaps: bool, static: bool, minimum: int) -> str:
    return f"""
WITH {view}, {FITTED}, {sequence(gaps, static)}, {kept(minimum)},
lengths AS (SELECT stay, count(*) AS n FROM kept GROUP BY stay),
families AS (
  SELECT f.family, count(k.token) AS tokens
  FROM (VALUES ('STATIC'), ('DX'), ('LAB'), ('VITAL'), ('MED'), ('INFUSION'), ('TREATMENT'),
    ('TIME_GAP')) f(family)
  LEFT JOIN kept k ON split_part(k.token, '::', 1) = f.family GROUP BY f.family)
SELECT (SELECT count(*) FROM universe) AS total_stays, count(*) AS kept_stays,
  (SELECT count(*) FROM universe) - count(*) AS skipped_stays,
  CAST(coalesce(min(n), 0) AS BIGINT) AS min_sequence_length,
  CAST(coalesce(max(n), 0) AS BIGINT) AS max_sequence_length,
  CAST(coalesce(median(n), 0) AS DOUBLE) AS median_sequence_length,
  (SELECT string_agg(family || '=' || tokens, ',' ORDER BY family) FROM families) AS families_text
FROM lengths
"""


def counters(view: str, unfitted: str) -> str:
    return f"""
WITH {view}, {FITTED},
classed AS (
  SELECT m.stay, m.t, m.measurement, m.value, h.p25,
    m.measurement || '::' || ({quartile('m.value', 'h.p25', 'h.p50', 'h.p75')}) AS token
  FROM measured m
  LEFT JOIN (SELECT * FROM thresholds WHERE measurement <> '{unfitted}') h
    ON h.measurement = m.measurement)
SELECT count(*) AS candidate_values,
  (SELECT count(*) FROM (SELECT DISTINCT stay, token, t FROM classed
    WHERE measurement IS NOT NULL AND value IS NOT NULL AND p25 IS NOT NULL)) AS emitted_events,
  count(*) FILTER (WHERE measurement IS NULL) AS skipped_missing_measurement,
  count(*) FILTER (WHERE measurement IS NOT NULL AND value IS NULL) AS skipped_nonnumeric_value,
  count(*) FILTER (WHERE measurement IS NOT NULL AND value IS NOT NULL AND p25 IS NULL)
    AS skipped_unfitted_measurement
FROM classed
"""


def fitted(view: str) -> str:
    return f"""
WITH {view}, {FITTED}
SELECT measurement, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75
FROM thresholds
"""


def numeric(view: str) -> str:
    return f"""
WITH {view}, {FITTED}
SELECT stay AS patientunitstayid, token, t AS event_time FROM numeric_events
"""


def outcomes(view: str) -> str:
    return f"""
WITH {view}
SELECT stay AS patientunitstayid, CAST(mortality AS INTEGER) AS mortality
FROM states WHERE mortality IS NOT NULL
"""


def outcome_statistics(view: str, candidates: str) -> str:
    return f"""
WITH {view}
SELECT count(*) AS candidate_stays, count(mortality) AS labelled_stays,
  count(*) FILTER (WHERE mortality IS NULL AND conflict IS NOT TRUE) AS unavailable_labels,
  count(*) FILTER (WHERE conflict) AS conflicting_labels
FROM states WHERE {candidates}
"""


STATIC_SQL = """SELECT stay AS patientunitstayid, 0 AS section, field, token,
  CAST(NULL AS DOUBLE) AS event_time FROM statics"""
CLINICAL_SQL = """SELECT stay AS patientunitstayid, 1 AS section, 0 AS field, token,
  t AS event_time FROM clinical WHERE token IS NOT NULL"""

TEXTS = """
SELECT 'document' AS kind, doc_id AS id, 0 AS part, text FROM documents
UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations
UNION ALL SELECT 'benchmark', item_id, 0, text FROM benchmark
UNION ALL SELECT 'page', page_id, 0, html FROM pages
UNION ALL SELECT 'url', page_id, 0, url FROM pages
"""

RECORDS = f"""
SELECT o_orderkey AS stay, o_orderpriority AS first_text,
  'DX::' || ({norm('o_orderpriority')}) AS first_token, o_orderstatus AS second_token,
  CASE o_orderstatus WHEN 'O' THEN 'basic' WHEN 'F' THEN 'timegap' ELSE 'raw' END AS representation,
  {minutes('o_orderdate', ORDER_ORIGIN)} AS first_time,
  CASE WHEN o_totalprice < 100000 THEN NULL ELSE floor(o_totalprice / 1000) END AS second_time
FROM orders
"""


def oracle_sql() -> dict[str, str]:
    u, o = USER_VIEW, ORDER_VIEW
    digits = "regexp_replace(props, '[^0-9]', '', 'g')"
    static_users = streams(u, True, True, 5, "timegap_static")
    return {
        # scalar functions
        "normalize_text": f"""
WITH texts AS ({TEXTS})
SELECT kind, id, CAST(part AS BIGINT) AS part, md5({norm('text')}) AS token_md5,
  CAST(length({norm('text')}) AS BIGINT) AS token_length,
  md5({norm('text', "'UNKNOWN'")}) AS kept_unknown_md5
FROM texts""",
        "age_bin": f"""
SELECT c_custkey, {age("CAST(CAST(floor(c_acctbal / 80) AS BIGINT) AS VARCHAR)")} AS from_balance,
  {age("CASE WHEN c_acctbal < 0 THEN '> 89' ELSE ' ' || CAST(floor(c_acctbal / 100) AS BIGINT) || ' ' END")} AS masked
FROM customer""",
        "gender_part": f"""
SELECT c_custkey, {gender("CASE WHEN c_nationkey < 8 THEN ' Female' WHEN c_nationkey < 16 THEN 'm' WHEN c_nationkey < 20 THEN 'Unknown' WHEN c_nationkey < 24 THEN '???' END")} AS gender
FROM customer""",
        "parse_number": f"""
SELECT event_id, {number(digits)} AS plain, {number(digits + " || 'd'")} AS suffixed,
  {number(digits + " || 'e1'")} AS scientific, {number("'  -' || " + digits + " || '.5 '")} AS padded,
  {number('props')} AS not_a_number, {number('CAST(value AS VARCHAR)')} AS from_value
FROM events""",
        "event_time": f"""
SELECT event_id, {EVENT_MINUTE} AS event_time FROM events""",
        "quartile_bin": f"""
SELECT event_id, {quartile('value', '50.0', '100.0', '200.0')} AS bin FROM events""",
        "outcome_label": """
SELECT o_orderkey AS id, 'orderstatus' AS field,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders
UNION ALL
SELECT doc_id, 'number', CASE quality + toxic WHEN 0 THEN 0 WHEN 1 THEN 1 END FROM labels
UNION ALL
SELECT doc_id, 'text', CASE toxic WHEN 1 THEN 1 WHEN 0 THEN 0 END FROM labels""",
        "gap_token": f"""
SELECT event_id, {gap(minutes('ts', USER_ORIGIN))} AS token FROM events""",
        "token_family": f"""
WITH {u}
SELECT token, split_part(token, '::', 1) AS family, count(*) AS events
FROM clinical GROUP BY token""",
        "prohibited_features": f"""
WITH texts AS ({TEXTS})
SELECT kind, id, CAST(part AS BIGINT) AS part, {prohibited('text')} AS prohibited FROM texts""",
        # events
        "static_events": f"WITH {u} SELECT stay AS patientunitstayid, field, token FROM statics",
        "clinical_events": f"WITH {u} SELECT * FROM ({CLINICAL_SQL})",
        "categorical_events": f"WITH {u} ({STATIC_SQL}) UNION ALL ({CLINICAL_SQL})",
        "categorical_events_orders": f"WITH {o} SELECT * FROM ({CLINICAL_SQL})",
        "lab_measurements": f"""
WITH {u} SELECT stay AS patientunitstayid, measurement, value, t AS event_time FROM measured""",
        "vital_unpivot": f"""
WITH {o} SELECT stay AS patientunitstayid, measurement, value, t AS event_time FROM measured""",
        # numeric
        "fit_bins_users": fitted(u),
        "fit_bins_orders": fitted(o),
        "fit_bins_by_interval": fitted(o),
        "numeric_events_users": numeric(u),
        "numeric_events_orders": numeric(o),
        "numeric_counters_users": counters(u, "LAB::CLICK"),
        "numeric_counters_orders": counters(o, "VITAL::TAX"),
        # outcomes
        "outcomes_users": outcomes(u),
        "outcomes_orders": outcomes(o),
        "outcome_stats_users": outcome_statistics(u, "TRUE"),
        "outcome_stats_orders": outcome_statistics(o, "TRUE"),
        "excluded_stays_orders": f"""
WITH {o}
SELECT stay AS patientunitstayid,
  CASE WHEN conflict THEN 'conflicting_labels' ELSE 'unavailable_labels' END AS reason
FROM states WHERE mortality IS NULL""",
        # streams
        "streams_basic": streams(u, False, False, 1, "basic"),
        "streams_timegap": streams(u, True, False, 1, "timegap"),
        "streams_timegap_static": static_users,
        "streams_orders": streams(o, True, False, 5, "timegap"),
        "time_gaps": positions(u, True, False, 1, "token LIKE 'TIME_GAP::%'"),
        "stream_positions": positions(u, True, True, 5),
        "streams_split": positions(u, True, True, 5),
        "streams_split_orders": positions(o, True, False, 5),
        "min_length_filter": f"""
WITH {u}, {FITTED}, {sequence(True, True)}, {kept(100)}
SELECT stay AS patientunitstayid, CAST(mortality AS INTEGER) AS mortality, CAST(n AS BIGINT) AS n_events
FROM kept GROUP BY ALL""",
        "stay_exclusions": f"""
WITH {u}, {FITTED}, {sequence(True, True)},
lengths AS (SELECT stay, count(*) AS n FROM placed GROUP BY stay)
SELECT v.stay AS patientunitstayid, CASE WHEN s.conflict THEN 'conflicting_label'
    WHEN s.mortality IS NULL THEN 'unavailable_label' ELSE 'too_few_events' END AS reason
FROM universe v LEFT JOIN states s USING (stay) LEFT JOIN lengths l USING (stay)
WHERE s.mortality IS NULL OR coalesce(l.n, 0) < 100""",
        "stay_universe": f"WITH {u} SELECT stay AS patientunitstayid FROM universe",
        "event_stats": statistics(u, True, True, 5),
        "event_stats_orders": statistics(o, True, False, 5),
        # data quality
        "stream_violations": f"""
WITH records AS ({RECORDS})
SELECT stay AS patientunitstayid, 'stay_id' AS rule, CAST(stay AS VARCHAR) AS detail
  FROM records WHERE stay <= 0
UNION ALL SELECT stay, 'token', second_token FROM records
UNION ALL SELECT stay, 'representation', representation FROM records WHERE representation = 'raw'
UNION ALL SELECT stay, 'event_times_order', '2' FROM records WHERE second_time < first_time""",
        "token_violations": """
WITH tokens AS (
  SELECT doc_id AS stay, CASE lang WHEN 'en' THEN 'DX' WHEN 'de' THEN 'LAB' ELSE lang END
      || CASE WHEN source LIKE '%1' THEN ':' ELSE '::' END
      || text AS token
  FROM documents)
SELECT stay AS patientunitstayid, 'token' AS rule, md5(token) AS detail_md5
FROM tokens WHERE NOT coalesce(length(token) > strpos(token, '::') + 1
  AND split_part(token, '::', 1) IN ('DX', 'LAB') AND contains(token, '::'), FALSE)""",
        "outcome_violations": """
SELECT doc_id AS patientunitstayid, 'stay_id' AS rule, CAST(doc_id AS VARCHAR) AS detail
  FROM labels WHERE doc_id <= 0
UNION ALL
SELECT doc_id, 'mortality', CAST(quality + toxic AS VARCHAR) FROM labels WHERE quality + toxic > 1""",
        "stats_violations": """
WITH users AS (
  SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS views,
    count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT 'stays_add_up' AS rule, CAST(total AS VARCHAR) AS detail FROM users
  WHERE total <> views + errors
UNION ALL SELECT 'lengths_in_order', CAST(views AS VARCHAR) FROM users WHERE views > errors
UNION ALL SELECT 'families', 'DX, LAB' FROM users""",
        # sources and sinks
        "csv_source": f"""
SELECT o_orderkey + 1 AS patientunitstayid, nullif(o_orderpriority, '') AS diagnosisstring,
  {minutes('o_orderdate', ORDER_ORIGIN)} AS diagnosisoffset, o_orderstatus AS extra
FROM orders""",
        "jsonl_roundtrip": static_users,
        "prepare_job": f"""
WITH {u}, {FITTED}, {sequence(True, True)}, {kept(5)}
SELECT stay AS patientunitstayid, CAST(mortality AS INTEGER) AS mortality,
  string_agg(token, '|' ORDER BY position) AS events_text,
  string_agg(coalesce(CAST(CAST(t AS BIGINT) AS VARCHAR), 'null'), '|' ORDER BY position)
    AS times_text
FROM kept GROUP BY stay, mortality""",
    } | protocol_events.oracle_sql() | protocol.oracle_sql(
        f"WITH {u}, {FITTED}, {sequence(True, True)}, {kept(5)}",
        f"WITH {o}, {FITTED}, {sequence(True, False)}, {kept(1)}",
        f"WITH {u}",
        gap("t - before"),
    )
