"""Registered queries of the evaluation protocol, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators import cohort, metrics, overlap, protocol, splits, vocabulary
from chartweave.operators.numeric import lab_rows
from chartweave.operators.shared_storage import write_through
from chartweave.plans.build import plan_event_streams, stream_positions
from checks.mappings import ORDER_ORIGIN, ORDER_RULES, USER_ORIGIN, minutes_since, order_tables, read, stay, user_tables

Query = Callable[[SparkSession, str], DataFrame]


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions: a patient is a customer, a site the customer's nation.

    Scores have ties and nulls, a third of the labels is unknown, one fold has one class, and one has
    no label and a null name.
    """
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    orders = read(spark, sf_dir, "orders").select(
        stay("o_orderkey"),
        F.col("o_custkey").alias("patient"),
        F.when(status == "F", 1).when(status == "O", 0).alias("label"),
        F.when(price >= 2000, F.floor(price / 250) / 1000.0).alias("score"),
        F.when((status == "F") & (price < 30000), "cheap")
        .when((status != "P") | (F.col("o_orderpriority") != "1-URGENT"), F.col("o_orderpriority"))
        .alias("fold"),
    )
    sites = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("site"))
    return orders.join(sites, "patient", "left")


_PREDICTIONS = """
predictions AS (
  SELECT o_orderkey + 1 AS stay, o_custkey AS patient, c_nationkey AS site,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label,
    CASE WHEN o_totalprice >= 2000 THEN floor(o_totalprice / 250) / 1000.0 END AS score,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice < 30000 THEN 'cheap'
      WHEN o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS fold
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def _ranking_sql(rows: str, by: str) -> str:
    """CTEs that end in ``ranked``: the ranking metrics of weighted rows, for each ``by``."""
    return f"""
counted AS (
  SELECT {by}, CASE WHEN label IS NOT NULL THEN score END AS score,
    sum(CASE WHEN label = 1 AND score IS NOT NULL THEN times ELSE 0 END) AS p,
    sum(CASE WHEN label = 0 AND score IS NOT NULL THEN times ELSE 0 END) AS n,
    sum(CASE WHEN label IS NULL OR score IS NULL THEN times ELSE 0 END) AS u
  FROM {rows} GROUP BY ALL),
stepped AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp
  FROM counted WINDOW w AS (PARTITION BY {by} ORDER BY score DESC NULLS LAST)),
summed AS (
  SELECT {by}, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
    CAST(sum(u) AS BIGINT) AS unusable, CAST(sum(n * (2 * (tp - p) + p)) AS DOUBLE) AS ordered,
    CAST(sum(CASE WHEN tp + fp > 0 THEN p * ((tp * 1000000000000000) // (tp + fp)) ELSE 0 END) AS DOUBLE) AS steps
  FROM stepped GROUP BY ALL),
ranked AS (
  SELECT {by}, positives, negatives, unusable,
    CASE WHEN positives > 0 AND negatives > 0
      THEN ordered / (2 * CAST(positives AS DOUBLE) * CAST(negatives AS DOUBLE)) END AS auroc,
    CASE WHEN positives > 0 AND negatives > 0
      THEN steps / (1000000000000000.0::DOUBLE * CAST(positives AS DOUBLE)) END AS average_precision,
    CASE WHEN NOT (positives > 0 AND negatives > 0) THEN 'one class' END AS note
  FROM summed)"""


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.ranking_metrics(prediction_rows(spark, sf_dir))
    return found.select("positives", "negatives", "unusable", "auroc", "note")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(prediction_rows(spark, sf_dir)).select("average_precision", "note")


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(prediction_rows(spark, sf_dir), by=["fold"])


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_metrics(prediction_rows(spark, sf_dir), 0.8, by=["fold"])


def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1_threshold(prediction_rows(spark, sf_dir), by=["fold"])


def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.positive_weight(prediction_rows(spark, sf_dir), by=["fold"])


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap_intervals(prediction_rows(spark, sf_dir), "patient")


def patient_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_split(prediction_rows(spark, sf_dir), "patient").select(STAY_ID, "patient", "part")


def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a split by order priority: patients are torn apart, one part has no class."""
    rows = prediction_rows(spark, sf_dir)
    part = (
        F.when(F.col("fold") == "cheap", "test").when(F.col("fold") == "2-HIGH", "validation").when(F.col("fold") < "5", "train")
    )
    return splits.split_violations(rows.withColumn("part", part), STAY_ID, "patient")


def site_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = splits.group_folds(prediction_rows(spark, sf_dir).drop("fold"), "site")
    return folded.groupBy("site", "fold").agg(F.count("*").alias("stays"), F.count_if(F.col("label") == 1).alias("positives"))


# Sequences: vocabulary, encoding, masking, cap, overlap ------------------------------


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Streams of the user view, and the part of each stay."""
    build = plan_event_streams(user_tables(spark, sf_dir), "timegap_static", 5)
    sequences = write_through(build.sequences, "sequences")
    build = type(build)(sequences, build.representation, build.min_events_per_stay)
    parts = splits.group_split(build.outcomes, STAY_ID, "mortality")
    return build.streams, parts.select(STAY_ID, "part")


def _positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Long form with the part of the stay, and the vocabulary of training stays."""
    streams, parts = _streams(spark, sf_dir)
    positions = write_through(stream_positions(streams).join(parts, STAY_ID), "positions")
    return positions, vocabulary.fit_vocabulary(positions.where("part = 'train'"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)[1]


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, entries = _positions(spark, sf_dir)
    encoded = vocabulary.encode(positions, entries).withColumnRenamed("token", "original")
    return vocabulary.decode(encoded, entries).select(STAY_ID, "position", "part", "original", "id", "token")


def unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, entries = _positions(spark, sf_dir)
    return vocabulary.unknown_share(vocabulary.encode(positions, entries), ["part"])


def _masked(positions: DataFrame, entries: DataFrame) -> DataFrame:
    encoded = vocabulary.encode(positions, entries)
    return vocabulary.mask_tokens(encoded, entries.count(), epoch=3, static=F.col("token").startswith("STATIC::"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _masked(*_positions(spark, sf_dir))
    return found.select(STAY_ID, "position", "id", "input_id", "target_id")


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, capped and padded: one row of 101 ids per stay."""
    streams, parts = _streams(spark, sf_dir)
    positions = stream_positions(protocol.cap_streams(streams, 100)).join(parts, STAY_ID)
    entries = vocabulary.fit_vocabulary(positions.where("part = 'train'"))
    rows = vocabulary.encoded_sequences(vocabulary.encode(positions, entries), ["part"])
    return vocabulary.padded(rows, 101).select(
        STAY_ID,
        "part",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids_text"),
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), "").alias("mask_text"),
    )


def length_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = protocol.cap_streams(_streams(spark, sf_dir)[0], 100)
    return stream_positions(capped)


def family_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, _ = _streams(spark, sf_dir)
    return protocol.retained_families(streams, protocol.cap_streams(streams, 100))


def rare_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: training streams against the others, n-grams of their whole sequences."""
    build = plan_event_streams(order_tables(spark, sf_dir), "timegap", 1, rules=ORDER_RULES)
    sequences = write_through(build.sequences, "sequences")
    build = type(build)(sequences, build.representation, build.min_events_per_stay)
    parts = splits.group_split(build.outcomes, STAY_ID, "mortality").select(STAY_ID, "part")
    streams = build.streams.join(parts, STAY_ID)
    return overlap.rare_overlap(streams.where("part = 'train'"), streams.where("part <> 'train'"))


def accuracy_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrupted input taken as a prediction of the original."""
    positions, entries = _positions(spark, sf_dir)
    rows = _masked(positions, entries).withColumnRenamed("input_id", "predicted_id")
    return overlap.accuracy_by_frequency(rows, entries, edges=(10, 20, 40))


# Events of the protocol ---------------------------------------------------------------


def hourly_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab_rows(user_tables(spark, sf_dir))
    return protocol.hourly_medians(rows, variables=None, bucket=720, window=(-5000, 14000))


def _repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5 + 1).alias(STAY_ID),
        F.col("event_type").alias("measurement"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        (minutes_since("ts", USER_ORIGIN) / 60).alias("event_time"),
        "event_id",
    )


def last_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.last_per_minute(_repeated_values(spark, sf_dir), ["event_id"])


def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.within_window(lab_rows(user_tables(spark, sf_dir)))


# Cohorts and reports -------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        stay("o_orderkey"), F.floor(F.col("o_totalprice") / 20).alias("unitdischargeoffset")
    )
    stays = prediction_rows(spark, sf_dir).join(orders, STAY_ID).withColumn("site", F.when(F.col("site") > 1, F.col("site")))
    lines = read(spark, sf_dir, "lineitem").select(stay("l_orderkey"))
    return cohort.eligibility(stays, lines, ids=[STAY_ID, "patient", "site"], min_events=3)


def cohort_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(STAY_ID, "n_events", "rule")


def cohort_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.exclusion_report(_judged(spark, sf_dir))


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _judged(spark, sf_dir).groupBy("site", "fold", "rule").agg(F.count("*").alias("stays"))
    return cohort.suppress_small_cells(counts, ["site", "fold"], "rule")


def strict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit(" "), F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select(
        stay("o_orderkey"), cohort.strict_label(status, negative=["o"], positive=["f"]).alias("label")
    )


def repeated_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(stay("l_orderkey"), "l_linestatus", "l_returnflag")
    return cohort.repeated_stays(lines, ["l_linestatus", "l_returnflag"])


def label_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        stay("l_orderkey"), F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_returnflag") != "A", 0).alias("line_label")
    )
    return cohort.label_agreement(prediction_rows(spark, sf_dir), lines, "label", "line_label")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        stay("l_orderkey"), minutes_since("l_shipdate", ORDER_ORIGIN).alias("event_time")
    )
    return cohort.table_profile(lines)


def queries() -> dict[str, Query]:
    return {
        "vocab": vocab,
        "encode": encode,
        "unknown_rate": unknown_rate,
        "masked": masked,
        "padded": padded,
        "length_cap": length_cap,
        "family_retention": family_retention,
        "rare_ngrams": rare_ngrams,
        "accuracy_by_frequency": accuracy_by_frequency,
        "hourly_median": hourly_median,
        "last_per_minute": last_per_minute,
        "window_filter": window_filter,
        "cohort_rules": cohort_rules,
        "cohort_exclusions": cohort_exclusions,
        "small_cells": small_cells,
        "strict_labels": strict_labels,
        "repeated_stays": repeated_stays,
        "label_crosscheck": label_crosscheck,
        "dataset_profile": dataset_profile,
        "auroc": auroc,
        "average_precision": average_precision,
        "fold_metrics": fold_metrics,
        "threshold_metrics": threshold_metrics,
        "f1_threshold": f1_threshold,
        "positive_weight": positive_weight,
        "bootstrap_ci": bootstrap_ci,
        "patient_split": patient_split,
        "split_checks": split_checks,
        "site_folds": site_folds,
    }


_PARTS = """
members AS (
  SELECT stay, max(mortality) AS stratum, md5('42:' || stay) AS place FROM kept GROUP BY stay),
parts AS (
  SELECT stay, CASE WHEN middle * 100 < 140 * whole THEN 'train' WHEN middle * 100 < 170 * whole THEN 'validation'
    ELSE 'test' END AS part
  FROM (
    SELECT stay, 2 * row_number() OVER (PARTITION BY stratum ORDER BY place, stay) - 1 AS middle,
      count(*) OVER (PARTITION BY stratum) AS whole
    FROM members))"""


def _vocabulary_sql(tokens: str) -> str:
    return f"""
entries AS (
  SELECT token, row_number() OVER (ORDER BY count DESC, token) + 3 AS id, count
  FROM (SELECT token, count(*) AS count FROM {tokens} JOIN parts USING (stay) WHERE part = 'train' GROUP BY token
    HAVING count(*) >= 5)
  UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[MASK]', '[CLS]']), unnest([0, 1, 2, 3]), NULL),
coded AS (
  SELECT k.stay, k.position, k.token, p.part, coalesce(e.id, 1) AS id
  FROM {tokens} k JOIN parts p USING (stay) LEFT JOIN entries e ON e.token = k.token)"""


_MASKED = """
drawn AS (SELECT *, md5('42:3:' || stay || ':' || position) AS h, (SELECT count(*) FROM entries) AS size FROM coded),
chosen AS (
  SELECT *, NOT starts_with(token, 'STATIC::') AND ('0x' || substr(h, 1, 8))::BIGINT < 644245094 AS picked,
    ('0x' || substr(h, 9, 8))::BIGINT AS kind, 4 + ('0x' || substr(h, 17, 15))::BIGINT % (size - 4) AS other
  FROM drawn),
corrupted AS (
  SELECT stay, position, id, CASE WHEN NOT picked THEN id WHEN kind < 3435973836 THEN 2 WHEN kind < 3865470566 THEN other
    ELSE id END AS input_id, CASE WHEN picked THEN id ELSE -100 END AS target_id
  FROM chosen)"""

# The longest kept stream of each stay: s static tokens, then k of its dynamic ones, evenly spread.
_CAPPED = """
long AS (SELECT stay FROM kept GROUP BY stay HAVING count(*) > 100),
dynamic AS (
  SELECT stay, list(t ORDER BY position) AS ts, list(token ORDER BY position) AS tokens, CAST(count(*) AS INTEGER) AS d
  FROM kept JOIN long USING (stay) WHERE split_part(token, '::', 1) NOT IN ('STATIC', 'TIME_GAP') GROUP BY stay),
fixed AS (
  SELECT stay, CAST(count(*) FILTER (WHERE token LIKE 'STATIC::%') AS INTEGER) AS s FROM kept JOIN long USING (stay) GROUP BY stay),
tried AS (
  SELECT stay, s, d, ts, least(d, 100 - s) AS k FROM dynamic JOIN fixed USING (stay)
  UNION ALL
  SELECT stay, s, d, ts, k - excess FROM (
    SELECT *, s + k + len(list_filter(range(1, k), lambda i:
      coalesce(ts[1 + ((i - 1) * (d - 1)) // (k - 1)] < ts[1 + (i * (d - 1)) // (k - 1)], FALSE))) - 100 AS excess
    FROM tried) WHERE excess > 0),
fitted_k AS (SELECT stay, min(k) AS k FROM tried GROUP BY stay),
picked_events AS (
  SELECT stay, i, tokens[1 + (i * (d - 1)) // (k - 1)] AS token, ts[1 + (i * (d - 1)) // (k - 1)] AS t
  FROM (SELECT f.stay, f.k, y.d, y.ts, y.tokens, unnest(range(f.k)) AS i FROM fitted_k f JOIN dynamic y USING (stay))),
stepped_events AS (SELECT *, lag(t) OVER (PARTITION BY stay ORDER BY i) AS before FROM picked_events),
placed_events AS (
  SELECT stay, 0 AS section, position AS i, 0 AS own, token, t FROM kept JOIN long USING (stay) WHERE token LIKE 'STATIC::%'
  UNION ALL SELECT stay, 1, i, 1, token, t FROM stepped_events
  UNION ALL SELECT stay, 1, i, 0, {gap}, t FROM stepped_events WHERE before < t),
capped AS (
  SELECT stay, row_number() OVER (PARTITION BY stay ORDER BY section, i, own) - 1 AS position, token, t FROM placed_events
  UNION ALL SELECT stay, position, token, t FROM kept ANTI JOIN long USING (stay))"""

_JUDGED = _PREDICTIONS + """,
judged AS (
  SELECT stay, label, CASE WHEN site > 1 THEN site END AS site, fold, coalesce(n, 0) AS n_events,
    CASE WHEN patient IS NULL OR NOT coalesce(site > 1, FALSE) THEN 'missing_id' WHEN label IS NULL THEN 'unknown_label'
      WHEN floor(o_totalprice / 20) < 1440 THEN 'left_early' WHEN coalesce(n, 0) < 3 THEN 'few_events' ELSE 'eligible'
    END AS rule
  FROM predictions JOIN orders ON o_orderkey + 1 = stay
  LEFT JOIN (SELECT l_orderkey + 1 AS stay, count(*) AS n FROM lineitem GROUP BY 1) USING (stay))"""


def _stream_sql(users: str, orders: str, gap: str) -> dict[str, str]:
    """Twins over the kept positions of the user view, and of the order view."""
    coded = f"{users}, {_PARTS}, {_vocabulary_sql('kept')}"
    capped = f"{users.replace('WITH', 'WITH RECURSIVE', 1)}, {_CAPPED.replace('{gap}', gap)}"
    return {
        "vocab": f"{coded} SELECT token, id, count FROM entries",
        "encode": f"""{coded}
SELECT stay AS patientunitstayid, CAST(position AS BIGINT) AS position, part, coded.token AS original, id,
  entries.token FROM coded JOIN entries USING (id)""",
        "unknown_rate": f"""{coded}
SELECT part, count(*) AS tokens, count(*) FILTER (WHERE id = 1) AS unknown,
  CAST(count(*) FILTER (WHERE id = 1) AS DOUBLE) / count(*) AS share FROM coded GROUP BY part""",
        "masked": f"""{coded}, {_MASKED}
SELECT stay AS patientunitstayid, CAST(position AS BIGINT) AS position, id, input_id, target_id FROM corrupted""",
        "accuracy_by_frequency": f"""{coded}, {_MASKED}
SELECT CASE WHEN count < 10 THEN 10 WHEN count < 20 THEN 20 WHEN count < 40 THEN 40 END AS stratum,
  count(*) AS predictions, count(*) FILTER (WHERE c.target_id = c.input_id) AS correct,
  CAST(count(*) FILTER (WHERE c.target_id = c.input_id) AS DOUBLE) / count(*) AS accuracy
FROM corrupted c LEFT JOIN entries e ON e.id = c.target_id WHERE target_id >= 0 GROUP BY 1""",
        "length_cap": f"""{capped}
SELECT stay AS patientunitstayid, CAST(position AS BIGINT) AS position, token, t AS event_time FROM capped""",
        "family_retention": f"""{capped},
before AS (SELECT split_part(token, '::', 1) AS family, count(*) AS original FROM kept GROUP BY 1),
after AS (SELECT split_part(token, '::', 1) AS family, count(*) AS retained FROM capped GROUP BY 1)
SELECT family, original, coalesce(retained, 0) AS retained FROM before LEFT JOIN after USING (family)""",
        "padded": f"""{capped}, {_PARTS}, {_vocabulary_sql('capped')},
rows_ AS (SELECT stay, part, list_concat([3], list(id ORDER BY position)) AS ids FROM coded GROUP BY stay, part)
SELECT stay AS patientunitstayid, part, array_to_string(list_resize(ids, 101, 0), ' ') AS ids_text,
  repeat('1', len(ids)) || repeat('0', 101 - len(ids)) AS mask_text FROM rows_""",
        "rare_ngrams": f"""{orders}, {_PARTS},
listed AS (
  SELECT stay, part = 'train' AS training, list(token ORDER BY position) AS e FROM kept JOIN parts USING (stay) GROUP BY ALL),
grams AS (
  SELECT training, size, e[i:i + size - 1] AS gram FROM (
    SELECT training, e, size, unnest(range(1, CAST(len(e) AS BIGINT) - size + 2)) AS i FROM listed, (SELECT unnest([3, 4, 5]) AS size))),
counted AS (
  SELECT size, gram, count(*) FILTER (WHERE training) AS learned, count(*) FILTER (WHERE NOT training) AS seen
  FROM grams GROUP BY ALL)
SELECT CAST(size AS INTEGER) AS size, count(*) FILTER (WHERE learned > 0) AS training_ngrams,
  count(*) FILTER (WHERE learned BETWEEN 1 AND 3) AS rare_ngrams, count(*) FILTER (WHERE seen > 0) AS held_out_ngrams,
  CAST(sum(seen) AS BIGINT) AS held_out_occurrences, count(*) FILTER (WHERE learned > 0 AND seen > 0) AS shared_ngrams,
  count(*) FILTER (WHERE learned BETWEEN 1 AND 3 AND seen > 0) AS shared_rare_ngrams,
  CAST(coalesce(sum(seen) FILTER (WHERE learned BETWEEN 1 AND 3), 0) AS BIGINT) AS shared_rare_occurrences
FROM counted GROUP BY size""",
    }


def _table_sql(users: str) -> dict[str, str]:
    return {
        "hourly_median": f"""{users},
valued AS (
  SELECT stay, measurement, floor((t + 5000) / 720) AS bucket, list_sort(list(value)) AS v
  FROM measured WHERE t BETWEEN -5000 AND 14000 AND measurement IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT stay AS patientunitstayid, measurement, (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2 AS value,
  CAST(least((bucket + 1) * 720 - 1 - 5000, 14000) AS DOUBLE) AS event_time FROM valued""",
        "window_filter": f"""{users}
SELECT stay AS patientunitstayid, measurement, value, t AS event_time FROM measured WHERE t BETWEEN 0 AND 1440""",
        "last_per_minute": f"""
SELECT user_id % 5 + 1 AS patientunitstayid, event_type AS measurement, value,
  floor((epoch_us(ts) - {USER_ORIGIN}) / 60000000.0) / 60 AS event_time
FROM events WHERE value >= 1
QUALIFY row_number() OVER (PARTITION BY user_id % 5, event_type,
  floor(floor((epoch_us(ts) - {USER_ORIGIN}) / 60000000.0) / 60) ORDER BY event_id DESC) = 1""",
        "cohort_rules": f"WITH {_JUDGED} SELECT stay AS patientunitstayid, n_events, rule FROM judged",
        "cohort_exclusions": f"""WITH {_JUDGED}
SELECT rule, coalesce(CAST(label AS VARCHAR), 'unknown') AS label, count(*) AS stays FROM judged GROUP BY ALL""",
        "small_cells": f"""WITH {_JUDGED},
cells AS (SELECT site, fold, rule, count(*) AS n FROM judged GROUP BY ALL),
ranked AS (
  SELECT *, min(n) OVER g < 10 AS small, row_number() OVER o AS place, sum(n) OVER o - n AS before
  FROM cells WINDOW g AS (PARTITION BY site, fold), o AS (PARTITION BY site, fold ORDER BY n, rule)),
merged AS (
  SELECT site, fold, CASE WHEN small AND (n < 10 OR before < 10 OR place <= 2) THEN 'OTHER' ELSE rule END AS rule, n
  FROM ranked)
SELECT site, fold, rule, CASE WHEN sum(n) >= 10 THEN CAST(sum(n) AS BIGINT) END AS stays, count(*) AS cells
FROM merged GROUP BY site, fold, rule""",
        "strict_labels": """
SELECT o_orderkey + 1 AS patientunitstayid, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders""",
        "repeated_stays": """
SELECT l_orderkey + 1 AS patientunitstayid, count(*) AS rows, count(DISTINCT l_linestatus || l_returnflag) > 1 AS conflicting
FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
        "label_crosscheck": f"""WITH {_PREDICTIONS},
lines AS (
  SELECT DISTINCT l_orderkey + 1 AS stay, CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_returnflag <> 'A' THEN 0 END AS other_label
  FROM lineitem)
SELECT label, other_label, count(*) AS stays FROM predictions LEFT JOIN lines USING (stay) GROUP BY ALL""",
        "dataset_profile": f"""
WITH per AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE epoch_us(l_shipdate) < {ORDER_ORIGIN}) AS negative
  FROM lineitem GROUP BY l_orderkey),
sizes AS (SELECT list_sort(list(n)) AS v, sum(n) AS n, sum(negative) AS negative FROM per)
SELECT CAST(n AS BIGINT) AS rows, len(v) AS stays, v[CAST(ceil(len(v) * 0.5) AS BIGINT)] AS median_rows,
  v[CAST(ceil(len(v) * 0.95) AS BIGINT)] AS p95_rows, v[len(v)] AS max_rows, CAST(negative AS BIGINT) AS negative_offsets
FROM sizes""",
    }


def oracle_sql(users: str, orders: str, view: str, gap: str) -> dict[str, str]:
    """Twins; ``users`` and ``orders`` are CTEs that end in kept positions, ``view`` those of the user view."""
    return _prediction_sql() | _stream_sql(users, orders, gap) | _table_sql(view)


def _prediction_sql() -> dict[str, str]:
    rows = f"WITH RECURSIVE {_PREDICTIONS}, weighted AS (SELECT *, 1 AS times, 0 AS pooled FROM predictions)"
    pooled = f"{rows}, {_ranking_sql('weighted', 'pooled')}"
    return {
        "auroc": f"{pooled} SELECT positives, negatives, unusable, auroc, note FROM ranked",
        "average_precision": f"{pooled} SELECT average_precision, note FROM ranked",
        "fold_metrics": f"{rows}, {_ranking_sql('weighted', 'fold')} SELECT * FROM ranked",
        "threshold_metrics": f"""{rows}, counts AS (
  SELECT fold, count(*) FILTER (WHERE label = 1 AND score >= 0.8) AS tp,
    count(*) FILTER (WHERE label = 0 AND score >= 0.8) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < 0.8) AS fn,
    count(*) FILTER (WHERE label = 0 AND score < 0.8) AS tn
  FROM predictions GROUP BY fold)
SELECT *, 2 * CAST(tp AS DOUBLE) / nullif(CAST(tp + fp + tp + fn AS DOUBLE), 0) AS f1,
  (CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2 AS balanced_accuracy
FROM counts""",
        "f1_threshold": f"""{rows}, {_ranking_sql('weighted', 'fold')},
scored AS (
  SELECT fold, score, 2 * CAST(tp AS DOUBLE) / CAST(tp + fp + sum(p) OVER (PARTITION BY fold) AS DOUBLE) AS f1,
    sum(p) OVER (PARTITION BY fold) AS positives
  FROM stepped)
SELECT fold, score AS threshold, f1 FROM scored WHERE positives > 0 AND score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, score DESC) = 1""",
        "positive_weight": """
WITH """ + _PREDICTIONS + """, counts AS (
  SELECT fold, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives
  FROM predictions GROUP BY fold)
SELECT *, CAST(negatives AS DOUBLE) / nullif(CAST(positives AS DOUBLE), 0) AS weight FROM counts""",
        "bootstrap_ci": f"""WITH {_PREDICTIONS},
members AS (
  SELECT patient, row_number() OVER (ORDER BY patient) - 1 AS number, count(*) OVER () AS groups
  FROM (SELECT DISTINCT patient FROM predictions WHERE patient IS NOT NULL)),
size AS (SELECT max(groups) AS groups FROM members),
draws AS (
  SELECT replicate, ('0x' || substr(md5('42:' || replicate || ':' || draw), 1, 15))::BIGINT % groups AS number
  FROM size, range(1000) r(replicate), (SELECT unnest(range((SELECT groups FROM size))) AS draw)),
picked AS (SELECT replicate, number, count(*) AS times FROM draws GROUP BY ALL),
grouped AS (SELECT patient, score, label, count(*) AS n FROM predictions GROUP BY ALL),
resampled AS (
  SELECT replicate, score, label, n * times AS times
  FROM grouped JOIN members USING (patient) JOIN picked USING (number)),
{_ranking_sql('resampled', 'replicate')},
found AS (
  SELECT 'auroc' AS metric, auroc AS value FROM ranked
  UNION ALL SELECT 'average_precision', average_precision FROM ranked),
listed AS (
  SELECT metric, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS v,
    count(*) FILTER (WHERE value IS NULL) AS skipped
  FROM found GROUP BY metric)
SELECT metric, v[CAST(greatest(ceil(len(v) * 0.025::DOUBLE), 1) AS BIGINT)] AS low,
  v[CAST(greatest(ceil(len(v) * 0.975::DOUBLE), 1) AS BIGINT)] AS high, len(v) AS used, skipped
FROM listed""",
        "patient_split": f"""WITH {_PREDICTIONS},
members AS (
  SELECT patient, max(label) AS stratum, count(*) AS n, md5('42:' || patient) AS place
  FROM predictions WHERE patient IS NOT NULL GROUP BY patient),
ranked AS (
  SELECT patient, n, sum(n) OVER (PARTITION BY stratum ORDER BY place, patient) - n AS before,
    sum(n) OVER (PARTITION BY stratum) AS whole
  FROM members)
SELECT stay AS patientunitstayid, patient, CASE WHEN (2 * before + n) * 100 < 140 * whole THEN 'train'
  WHEN (2 * before + n) * 100 < 170 * whole THEN 'validation' WHEN patient IS NOT NULL THEN 'test' END AS part
FROM predictions LEFT JOIN ranked USING (patient)""",
        "split_checks": f"""WITH {_PREDICTIONS},
parted AS (
  SELECT *, CASE WHEN fold = 'cheap' THEN 'test' WHEN fold = '2-HIGH' THEN 'validation'
    WHEN fold < '5' THEN 'train' END AS part
  FROM predictions)
SELECT 'group_in_two_parts' AS rule, CAST(patient AS VARCHAR) AS detail
FROM parted GROUP BY patient HAVING min(part) < max(part)
UNION ALL
SELECT 'stay_without_part', CAST(stay AS VARCHAR) FROM parted WHERE part IS NULL
UNION ALL
SELECT 'class_missing', p || ' ' || l
FROM (SELECT unnest(['train', 'validation', 'test']) AS p) a, (SELECT unnest([0, 1]) AS l) b
WHERE NOT EXISTS (SELECT 1 FROM parted WHERE part = p AND label = l)""",
        "site_folds": f"""WITH RECURSIVE {_PREDICTIONS},
sites AS (
  SELECT site, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p,
    row_number() OVER (ORDER BY count(*) DESC, site) AS i
  FROM predictions WHERE site IS NOT NULL GROUP BY site),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS all_n, CAST(greatest(sum(p), 1) AS BIGINT) AS all_p FROM sites),
placed AS (
  SELECT CAST(0 AS BIGINT) AS i, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS ns, [0, 0, 0, 0, 0]::BIGINT[] AS ps
  UNION ALL
  SELECT i, fold, list_transform(ns, lambda x, j: CASE WHEN j = fold + 1 THEN x + n ELSE x END),
    list_transform(ps, lambda x, j: CASE WHEN j = fold + 1 THEN x + p ELSE x END)
  FROM (
    SELECT s.i, s.n, s.p, q.ns, q.ps, CAST(list_position(
      list_transform(q.ns, lambda x, j: x * all_p + q.ps[j] * all_n),
      list_min(list_transform(q.ns, lambda x, j: x * all_p + q.ps[j] * all_n))) AS INTEGER) - 1 AS fold
    FROM placed q JOIN sites s ON s.i = q.i + 1, totals))
SELECT site, fold, n AS stays, p AS positives FROM placed JOIN sites USING (i)""",
    }
