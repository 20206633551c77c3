"""Column functions against the written rules."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.contract import UNKNOWN_TEXTS
from chartweave.functions.labels import decided_label, deciding_state, label_mask, outcome_label
from chartweave.functions.numbers import event_time, finite_number, gap_token, quartile_bin
from chartweave.functions.text import (
    age_bin,
    build_token,
    gender_part,
    normalize_name,
    normalize_text,
    token_family,
)


def apply(spark, values, function, sql_type="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {sql_type}")
    out = frame.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in out]


def spelled_out(text, preserve_unknown=False):
    folded = text.strip().casefold()
    if folded in UNKNOWN_TEXTS:
        return "UNKNOWN" if preserve_unknown else None
    return "_".join(re.findall("[A-Z0-9]+", folded.upper())) or None


@pytest.mark.parametrize("preserve", [False, True])
def test_every_character_normalizes_like_the_rule(spark, preserve):
    characters = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}b" for c in characters] + [f"{c}none{c}" for c in characters]
    got = apply(spark, texts, lambda v: normalize_text(v, preserve))
    want = [spelled_out(t, preserve) for t in texts]
    # Letters that the two Unicode versions in use case-map differently are
    # allowed to differ as long as nothing but ASCII remains.
    differing = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not differing, differing[:20]


@pytest.mark.parametrize(
    "text, plain, kept",
    [
        ("Norepinephrine 4 mg/250 mL", "NOREPINEPHRINE_4_MG_250_ML", "NOREPINEPHRINE_4_MG_250_ML"),
        (" Respiratory   failure ", "RESPIRATORY_FAILURE", "RESPIRATORY_FAILURE"),
        ("Propofol (mg/hr)", "PROPOFOL_MG_HR", "PROPOFOL_MG_HR"),
        ("\tUnknown ", None, "UNKNOWN"),
        ("n-a", "N_A", "N_A"),
        ("none\n", None, "UNKNOWN"),
        ("not  available", "NOT_AVAILABLE", "NOT_AVAILABLE"),
        ("", None, "UNKNOWN"),
        ("???", None, None),
        ("__", None, None),
        (None, None, None),
    ],
)
def test_normalize_examples(spark, text, plain, kept):
    assert apply(spark, [text], normalize_text) == [plain]
    assert apply(spark, [text], lambda v: normalize_text(v, True)) == [kept]
    if text is not None:
        assert normalize_name(text) == plain


def test_normalize_covers_whole_long_texts(spark):
    text = "Ab-" * 200_000 + "end"
    assert apply(spark, [text], normalize_text) == ["AB_" * 200_000 + "END"]


def test_age_bins(spark):
    cases = {
        "65": "60_70",
        " 0 ": "0_10",
        "9.99": "0_10",
        "89.5": "80_90",
        "90": "90_PLUS",
        "> 89": "90_PLUS",
        ">89": "90_PLUS",
        "1e1": "10_20",
        "6_5": "60_70",
        "inf": "90_PLUS",
        "-1": None,
        "-inf": None,
        "nan": None,
        "unknown": None,
        "> 90": None,
        "": None,
    }
    assert apply(spark, list(cases), age_bin) == list(cases.values())
    assert apply(spark, [None], age_bin) == [None]
    assert apply(spark, [65, 101, -3], age_bin, "bigint") == ["60_70", "90_PLUS", None]
    assert apply(spark, [64.5], age_bin, "double") == ["60_70"]


def test_gender(spark):
    texts = ["Female", " f ", "MALE", "m", "Other", "Unknown", "", "X", "???", None]
    want = ["F", "F", "M", "M", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", None, None]
    assert apply(spark, texts, gender_part) == want


def test_numbers_from_text(spark):
    cases = {
        "5.2": 5.2,
        " 5.2 ": 5.2,
        "\t7\n": 7.0,
        "+3": 3.0,
        "-4": -4.0,
        ".5": 0.5,
        "5.": 5.0,
        "1e3": 1000.0,
        "1.0d": None,
        "5f": None,
        "1_000": None,
        "0x10": None,
        "True": None,
        "nan": None,
        "inf": None,
        "-Infinity": None,
        "1e999": None,
        "-1e999": None,
        "": None,
        "> 5": None,
    }
    assert apply(spark, list(cases), finite_number) == list(cases.values())


def test_numbers_from_typed_columns(spark):
    double = T.DoubleType()
    values = [1.5, math.inf, -math.inf, math.nan, None]
    assert apply(spark, values, lambda v: finite_number(v, double), "double") == [
        1.5,
        None,
        None,
        None,
        None,
    ]
    boolean = T.BooleanType()
    assert apply(spark, [True], lambda v: finite_number(v, boolean), "boolean") == [None]
    assert apply(spark, [True], finite_number, "boolean") == [None]
    assert apply(spark, [3], lambda v: finite_number(v, T.LongType()), "bigint") == [3.0]


def test_event_times(spark):
    got = apply(spark, ["-10", "not recorded", "-0", "0", None, "2.5"], event_time)
    assert got == [-10.0, None, 0.0, 0.0, None, 2.5]
    assert math.copysign(1, got[2]) == 1.0


def test_quartile_edges_belong_to_the_lower_bin(spark):
    edges = [F.lit(v) for v in (1.0, 2.0, 3.0)]
    values = [0.0, 1.0, 1.5, 2.0, 3.0, 3.1, None]
    got = apply(spark, values, lambda v: quartile_bin(v, *edges), "double")
    assert got == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q4", None]


def test_gap_buckets(spark):
    values = [-1, 0, 0.5, 15, 15.1, 60, 61, 180, 360, 361, 720, 1440, 1441, None]
    values = [None if v is None else float(v) for v in values]
    names = [None, None, "LE_15M", "LE_15M", "15M_1H", "15M_1H", "1H_3H", "1H_3H", "3H_6H"]
    names += ["6H_12H", "6H_12H", "12H_24H", "GT_24H", None]
    want = [None if n is None else f"TIME_GAP::{n}" for n in names]
    assert apply(spark, values, gap_token, "double") == want


def test_labels(spark):
    texts = ["Alive", " EXPIRED ", "died", "Survived", "0", "1", "1.0", "2", "Unknown", None]
    assert apply(spark, texts, outcome_label) == [0, 1, 1, 0, 0, 1, None, None, None, None]
    double = T.DoubleType()
    got = apply(spark, [0.0, 1.0, 2.0, 0.5, None], lambda v: outcome_label(v, double), "double")
    assert got == [0, 1, None, None, None]
    boolean = T.BooleanType()
    assert apply(spark, [True], lambda v: outcome_label(v, boolean), "boolean") == [None]
    assert apply(spark, ["ſurvived"], outcome_label) == [0]


def test_the_first_field_with_a_label_decides(spark):
    # per field: rows of labels; state of the stay
    cases = [
        ([[0], [1]], 1),
        ([[1], [0, 1]], 2),
        ([[0, 1], [1]], 3),
        ([[], [1]], 2),
        ([[None], [0, 1], [1]], 3),
        ([[], []], None),
    ]
    for fields, state in cases:
        rows = [
            tuple(label if i == rank else None for i in range(3))
            for rank, labels in enumerate(fields)
            for label in labels
        ] or [(None, None, None)]
        frame = spark.createDataFrame(rows, "a int, b int, c int")
        mask = label_mask([(i, F.col(c)) for i, c in enumerate("abc")])
        got = frame.agg(F.bit_or(mask).alias("m")).select(
            deciding_state(F.col("m"), 3).alias("s")
        )
        assert got.first()["s"] == state
        label = got.select(decided_label(F.col("s")).alias("l")).first()["l"]
        assert label == {1: 0, 2: 1}.get(state)


def test_tokens(spark):
    assert apply(spark, ["SEPSIS", None], lambda v: build_token("DX", v)) == ["DX::SEPSIS", None]
    assert apply(spark, ["LAB::NA::Q1", "DX"], token_family) == ["LAB", "DX"]
