"""Small invented tables with known results, and the rules spelled out in Python.

``expected_build`` computes everything from plain lists, one stay at a time. It
is the brute force that the Spark plans are compared with.
"""

from __future__ import annotations

import statistics
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("STATIC", "DX", "LAB", "VITAL", "MED", "INFUSION", "TREATMENT", "TIME_GAP")

STREAM_SCHEMAS = {
    "patient": "patientunitstayid bigint, age string, gender string, hospitaldischargestatus string",
    "diagnosis": "patientunitstayid bigint, diagnosisstring string, diagnosisoffset double",
    "medication": "patientunitstayid bigint, drugname string, drugstartoffset double",
    "lab": "patientunitstayid bigint, labname string, labresult string, labresultoffset double",
    "vitalPeriodic": "patientunitstayid bigint, observationoffset double, heartrate double, sao2 double",
}

# An own small ward: a copy, a time before admission, two events at one instant, a missing time, a
# missing age and a stay without a label.
WARD_ROWS = {
    "patient": [(7, "34", "Male", "Expired"), (8, "71", "Female", "Alive"), (9, None, "Male", "Alive"), (12, "58", "Female", "Unknown")],
    "diagnosis": [(7, "Stroke", -15.0), (7, "Stroke", -15.0), (7, "Anemia", 200.0), (8, "Gout", None), (9, "Burns", 5.0)],
    "medication": [(8, "Digoxin", 45.0), (7, "Insulin", 200.0), (8, "Heparin", 30.0)],
    "lab": [(9, "Lactate", "8.5", 5.0), (7, "Lactate", "2.5", 3000.0)],
}


def frames(spark: SparkSession, rows: dict, schemas: dict = STREAM_SCHEMAS) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(data, schemas[name]) for name, data in rows.items()}


def quantile(values: list[float], p: float) -> float:
    ordered = sorted(values)
    place = (len(ordered) - 1) * p
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    fraction = place - low
    step = ordered[high] - ordered[low]
    if fraction < 0.5:
        return ordered[low] + step * fraction
    return ordered[high] - step * (1 - fraction)


def quartile(value: float, edges: tuple[float, float, float]) -> str:
    return "Q" + str(1 + sum(value > edge for edge in edges))


def gap_name(minutes: float) -> str:
    for upper, name in (
        (15, "LE_15M"),
        (60, "15M_1H"),
        (180, "1H_3H"),
        (360, "3H_6H"),
        (720, "6H_12H"),
        (1440, "12H_24H"),
    ):
        if minutes <= upper:
            return name
    return "GT_24H"


def expected_build(rows: dict, representation: str, minimum: int):
    """Streams by stay, outcomes by stay, statistics; texts must be plain words."""
    measured = []
    for stay, name, value, time in rows.get("lab", []):
        measured.append((stay, f"LAB::{name.upper()}", float(value), time))
    for stay, time, heart, oxygen in rows.get("vitalPeriodic", []):
        measured.append((stay, "VITAL::HEARTRATE", heart, time))
        measured.append((stay, "VITAL::SAO2", oxygen, time))
    by_name = defaultdict(list)
    for _, name, value, _ in measured:
        if value is not None:
            by_name[name].append(value)
    edges = {n: tuple(quantile(v, p) for p in (0.25, 0.5, 0.75)) for n, v in by_name.items()}

    events = defaultdict(set)
    for table, family in (("diagnosis", "DX"), ("medication", "MED")):
        for stay, text, time in rows.get(table, []):
            events[stay].add((f"{family}::{text.upper()}", time))
    for stay, name, value, time in measured:
        if value is not None:
            events[stay].add((f"{name}::{quartile(value, edges[name])}", time))

    static, labels, stays = defaultdict(dict), defaultdict(set), set()
    for table in rows.values():
        stays.update(row[0] for row in table)
    for stay, age, gender, status in rows.get("patient", []):
        if age is not None:
            low = int(age) // 10 * 10
            static[stay][(0, f"STATIC::AGE_BIN::{low}_{low + 10}")] = None
        if gender is not None:
            static[stay][(1, f"STATIC::GENDER::{gender[0]}")] = None
        if status in ("Alive", "Expired"):
            labels[stay].add(int(status == "Expired"))

    streams, outcomes = {}, {}
    for stay in stays:
        if len(labels[stay]) != 1:
            continue
        sequence = []
        before = None
        timed = sorted(events[stay], key=lambda e: (e[1] is None, e[1] or 0.0, e[0]))
        for token, time in timed:
            if representation != "basic" and time is not None:
                if before is not None and time > before:
                    sequence.append((f"TIME_GAP::{gap_name(time - before)}", time))
                before = time
            sequence.append((token, time))
        if representation == "timegap_static":
            sequence = [(token, None) for _, token in sorted(static[stay])] + sequence
        if len(sequence) >= minimum:
            streams[stay] = sequence
            outcomes[stay] = next(iter(labels[stay]))
    lengths = [len(sequence) for sequence in streams.values()]
    families = dict.fromkeys(FAMILIES, 0)
    for sequence in streams.values():
        for token, _ in sequence:
            families[token.split("::")[0]] += 1
    summary = {
        "total_stays": len(stays),
        "kept_stays": len(streams),
        "skipped_stays": len(stays) - len(streams),
        "min_sequence_length": min(lengths, default=0),
        "max_sequence_length": max(lengths, default=0),
        "median_sequence_length": float(statistics.median(lengths)) if lengths else 0.0,
        "token_family_counts": families,
    }
    return streams, outcomes, summary


def collected(streams: DataFrame) -> dict[int, list[tuple[str, float | None]]]:
    """Streams by stay; ranges of one stay are put together in order."""
    parts = defaultdict(list)
    for row in streams.collect():
        chunk = int(row["metadata"].get("chunk", 0))
        start = int(row["metadata"].get("start", 0))
        parts[row["patientunitstayid"]].append(
            (chunk, start, list(zip(row["events"], row["event_times"], strict=True)))
        )
    whole = {}
    for stay, pieces in parts.items():
        sequence: list = []
        for chunk, (number, start, piece) in enumerate(sorted(pieces)):
            assert number == chunk and start == len(sequence)
            sequence += piece
        whole[stay] = sequence
    return whole
