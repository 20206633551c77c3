"""The data contract: names, word lists and value tables every operator shares.

Fixed values. Everything in this module has to equal what existing inputs and
outputs use (column names, table names, token families, word lists, bucket
names), so it is stated here once, as plain text, and nowhere else.
"""

from __future__ import annotations

STAY_ID = "patientunitstayid"

# Source tables in load order; each is one CSV called "<name>.csv".
SOURCE_TABLES = (
    "patient",
    "apachePatientResult",
    "diagnosis",
    "lab",
    "medication",
    "infusionDrug",
    "treatment",
    "vitalPeriodic",
    "vitalAperiodic",
)

# Token families.
EVENT_FAMILIES = (
    "STATIC",
    "DX",
    "LAB",
    "VITAL",
    "MED",
    "INFUSION",
    "TREATMENT",
    "TIME_GAP",
)

TOKEN_SEPARATOR = "::"

# What a stream contains besides its clinical events.
REPRESENTATIONS = ("basic", "timegap", "timegap_static")

# Categorical sources: table, token family, text column, offset column.
CATEGORICAL_SOURCES = (
    ("diagnosis", "DX", "diagnosisstring", "diagnosisoffset"),
    ("medication", "MED", "drugname", "drugstartoffset"),
    ("infusionDrug", "INFUSION", "drugname", "infusionoffset"),
    ("treatment", "TREATMENT", "treatmentstring", "treatmentoffset"),
)

# Long numeric source: table, family, name column, value column, offset column.
LAB_SOURCE = ("lab", "LAB", "labname", "labresult", "labresultoffset")

# Wide numeric sources: every column that is not an id or an offset is measured.
VITAL_TABLES = ("vitalPeriodic", "vitalAperiodic")
VITAL_FAMILY = "VITAL"
VITAL_OFFSET = "observationoffset"

# Static context: column, token name, in token order.
STATIC_FIELDS = (
    ("age", "AGE_BIN"),
    ("gender", "GENDER"),
    ("hospitaladmitsource", "ADMISSION_SOURCE"),
    ("unittype", "UNIT_TYPE"),
)

# Outcome fields in order of precedence: table, column.
OUTCOME_FIELDS = (
    ("patient", "hospitaldischargestatus"),
    ("apachePatientResult", "actualhospitalmortality"),
    ("patient", "unitdischargestatus"),
    ("apachePatientResult", "actualicumortality"),
)
NEGATIVE_LABELS = ("0", "alive", "survived")
POSITIVE_LABELS = ("1", "dead", "died", "expired")

# Folded texts that mean "not known".
UNKNOWN_TEXTS = (
    "",
    "n/a",
    "na",
    "none",
    "not available",
    "not recorded",
    "other",
    "unknown",
)

# Quartile labels and the probabilities of their inner edges.
QUARTILE_LABELS = ("Q1", "Q2", "Q3", "Q4")
QUARTILE_PROBABILITIES = (0.25, 0.5, 0.75)

# Fixed values of the 24-hour protocol: static columns and their token names, age groups (exclusive upper
# edge in years), gap buckets (inclusive upper edge in minutes), families in order within a minute.
PROTOCOL_STATIC = (
    ("age", "AGE_BIN"),
    ("gender", "GENDER"),
    ("unitadmitsource", "UNIT_ADMIT_SOURCE"),
    ("unittype", "UNIT_TYPE"),
)
AGE_GROUPS = ((18, "0_17"), (40, "18_39"), (60, "40_59"), (80, "60_79"), (None, "80_PLUS"))
PROTOCOL_GAPS = ((15, "0_15M"), (60, "16_60M"), (180, "61_180M"), (360, "181_360M"), (None, "GT_360M"))
FAMILY_ORDER = ("DX", "LAB", "VITAL", "MED", "INFUSION", "TREATMENT")

# Gap buckets: inclusive upper edge in minutes, name; the last one is open.
GAP_BUCKETS = (
    (15, "LE_15M"),
    (60, "15M_1H"),
    (180, "1H_3H"),
    (360, "3H_6H"),
    (720, "6H_12H"),
    (1440, "12H_24H"),
    (None, "GT_24H"),
)

# Fragments that must not occur in the name of a feature column.
PROHIBITED_FEATURE_FRAGMENTS = (
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
    "length_of_stay",
    "los",
    "activeupondischarge",
)

# CSV cells read as null (exact, case-sensitive).
NULL_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Artifacts of the preparation job and its defaults.
STREAMS_ARTIFACT = "event_streams.jsonl"
OUTCOMES_ARTIFACT = "outcomes.csv"
STATS_ARTIFACT = "event_stats.json"
DEFAULT_REPRESENTATION = "timegap_static"
DEFAULT_MIN_EVENTS = 5
