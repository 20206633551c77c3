"""CSV source, JSON lines, and the preparation job end to end."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

import prepare_streams as command
from chartweave import (
    SOURCE_TABLES,
    extract_categorical_events,
    extract_outcomes,
    load_tables,
    prepare_streams,
    read_event_streams_jsonl,
    streams_from_records,
    table_path,
    write_event_streams_jsonl,
    write_outcomes_csv,
)
from golden import collected


def write(folder: Path, table: str, text: str) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    Path(table_path(str(folder), table)).write_text(text, encoding="utf-8")


def test_reads_all_tables_in_order(spark, tmp_path):
    for name in SOURCE_TABLES:
        write(tmp_path, name, "patientunitstayid\n101\n")
    tables = load_tables(spark, str(tmp_path))
    assert list(tables) == list(SOURCE_TABLES)
    assert all([r["patientunitstayid"] for r in t.collect()] == [101] for t in tables.values())


def test_subset_keeps_order_columns_and_repeats(spark, tmp_path):
    write(tmp_path, "diagnosis", "x,patientunitstayid,diagnosisstring\n1,101,sepsis\n2,101,\"a \"\"b\"\", c\"\n")
    tables = load_tables(spark, str(tmp_path), ["diagnosis"])
    assert list(tables) == ["diagnosis"]
    assert tables["diagnosis"].columns == ["x", "patientunitstayid", "diagnosisstring"]
    assert [tuple(r) for r in tables["diagnosis"].collect()] == [
        ("1", 101, "sepsis"),
        ("2", 101, 'a "b", c'),
    ]


@pytest.mark.parametrize(
    "table, text, error, words",
    [
        ("diagnosis", None, FileNotFoundError, "diagnosis.csv"),
        ("lab", "labname\ncreatinine\n", ValueError, "lab.*patientunitstayid"),
        ("medication", "", ValueError, "medication.*empty"),
        ("InfusionDrug", None, ValueError, "unknown table.*InfusionDrug"),
    ],
)
def test_bad_tables(spark, tmp_path, table, text, error, words):
    if text is not None:
        write(tmp_path, table, text)
    with pytest.raises(error, match=words):
        load_tables(spark, str(tmp_path), [table])


def test_header_only_and_short_rows(spark, tmp_path):
    write(tmp_path, "treatment", "patientunitstayid\n")
    write(tmp_path, "diagnosis", "patientunitstayid,diagnosisstring\n5\n\n6,x\n")
    tables = load_tables(spark, str(tmp_path), ["treatment", "diagnosis"])
    assert tables["treatment"].count() == 0
    assert tables["treatment"].columns == ["patientunitstayid"]
    assert [tuple(r) for r in tables["diagnosis"].collect()] == [(5, None), (6, "x")]


def test_long_rows_are_an_error(spark, tmp_path):
    write(tmp_path, "diagnosis", "patientunitstayid,diagnosisstring\n5,a\n6,b,c\n")
    with pytest.raises(ValueError, match="more fields than its header"):
        load_tables(spark, str(tmp_path), ["diagnosis"])
    lazy = load_tables(spark, str(tmp_path), ["diagnosis"], id_type="bigint", check_rows=False)
    with pytest.raises(Exception, match="more fields than its header"):
        lazy["diagnosis"].collect()


def test_line_breaks_inside_cells_need_multiline(spark, tmp_path):
    write(tmp_path, "diagnosis", 'patientunitstayid,diagnosisstring\n5,"a\nb"\n6,"c ""d"""\n')
    with pytest.raises(ValueError, match="multiline=True"):
        load_tables(spark, str(tmp_path), ["diagnosis"])
    whole = load_tables(spark, str(tmp_path), ["diagnosis"], multiline=True)["diagnosis"]
    assert sorted(tuple(r) for r in whole.collect()) == [(5, "a\nb"), (6, 'c "d"')]


def test_part_files_must_share_a_header(spark, tmp_path):
    folder = tmp_path / "diagnosis.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("patientunitstayid,diagnosisoffset\n5,60\n")
    (folder / "part-1.csv").write_text("patientunitstayid,diagnosisoffset\n6,70\n")
    assert load_tables(spark, str(tmp_path), ["diagnosis"])["diagnosis"].count() == 2
    (folder / "part-2.csv").write_text("diagnosisoffset,patientunitstayid\n70,7\n")
    with pytest.raises(ValueError, match="differ in header"):
        load_tables(spark, str(tmp_path), ["diagnosis"])


def test_whole_ids_written_with_a_point(spark, tmp_path):
    write(tmp_path, "patient", "patientunitstayid,gender\n101.0,Male\n102.,Female\n")
    write(tmp_path, "diagnosis", "patientunitstayid,diagnosisstring\n101,a\n")
    tables = load_tables(spark, str(tmp_path), ["patient", "diagnosis"])
    assert sorted(r[0] for r in tables["patient"].select("patientunitstayid").collect()) == [101, 102]
    assert tables["patient"].join(tables["diagnosis"], "patientunitstayid").count() == 1


def test_null_cells(spark, tmp_path):
    cells = ["N/A", "None", "NULL", "nan", "<NA>", "none", "n/a ", "Null"]
    write(tmp_path, "patient", "patientunitstayid,gender\n" + "".join(f"1,{c}\n" for c in cells))
    frame = load_tables(spark, str(tmp_path), ["patient"])["patient"]
    assert [r["gender"] for r in frame.collect()] == [None] * 5 + ["none", "n/a ", "Null"]


def test_text_ids_and_numeric_labels(spark, tmp_path):
    write(tmp_path, "patient", "patientunitstayid,hospitaldischargestatus\n1,1.0\n2,0.0\n3,\n")
    numeric = load_tables(spark, str(tmp_path), ["patient"])
    assert dict(map(tuple, extract_outcomes(numeric)[0].collect())) == {1: 1, 2: 0}
    write(tmp_path / "b", "patient", "patientunitstayid,hospitaldischargestatus\na,1.0\n2,Alive\n")
    mixed = load_tables(spark, str(tmp_path / "b"), ["patient"])
    assert dict(map(tuple, extract_outcomes(mixed)[0].collect())) == {"2": 0}


def test_patient_rows_keep_their_file_order(spark, tmp_path):
    write(tmp_path, "patient", "patientunitstayid,age,gender\n1,80,Male\n1,30,\n1,80,Female\n")
    tables = load_tables(spark, str(tmp_path), ["patient"])
    events = extract_categorical_events(tables, representation="timegap_static")
    rows = events.orderBy("row_order", "field").collect()
    assert [r["token"] for r in rows] == [
        "STATIC::AGE_BIN::80_90",
        "STATIC::GENDER::M",
        "STATIC::AGE_BIN::30_40",
        "STATIC::GENDER::F",
    ]


STREAM = (
    "patientunitstayid {}, events array<string>, representation string, "
    "event_times array<double>, metadata map<string,string>"
)


def test_round_trip(spark, tmp_path):
    rows = [
        ("stay-1", ["STATIC::GENDER::F", "DX::SEPSIS"], "timegap_static", [None, 10.0], {"source": "x"}),
        ("stay-2", ["DX::A"], "basic", None, {}),
    ]
    path = str(tmp_path / "streams.jsonl")
    streams = spark.createDataFrame(rows, STREAM.format("string"))
    write_event_streams_jsonl(streams, path)
    back = read_event_streams_jsonl(spark, path, id_type="string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    lines = [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]
    first = json.loads(lines[0])
    assert list(first) == ["event_times", "events", "metadata", "patientunitstayid", "representation"]
    assert first["event_times"] == [None, 10.0]


def test_writer_sorts_by_text_and_rejects_invalid(spark, tmp_path):
    schema = STREAM.format("bigint")
    rows = [(i, ["DX::A"], "basic", [1.0], {}) for i in (1001, 101, 99)]
    path = str(tmp_path / "a")
    write_event_streams_jsonl(spark.createDataFrame(rows, schema), path)
    lines = [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]
    assert [json.loads(line)["patientunitstayid"] for line in lines] == [1001, 101, 99]
    bad = spark.createDataFrame([(1, ["DX"], "basic", [1.0], {})], schema)
    with pytest.raises(Exception, match="invalid event stream: token"):
        write_event_streams_jsonl(bad, str(tmp_path / "b"))


@pytest.mark.parametrize(
    "line, words",
    [
        ("{not json", r"json \(1\)"),
        ('{"patientunitstayid": true, "events": ["DX::A"], "representation": "basic"}', "invalid"),
        ('{"events": ["DX::A"], "representation": "basic"}', "stay_id"),
        ('{"patientunitstayid": 1, "representation": "basic"}', "min_events"),
        ('{"patientunitstayid": 1, "events": ["DX::A", 42], "representation": "basic"}', "token"),
        ('{"patientunitstayid": 1, "events": ["DX::A"]}', "representation"),
    ],
)
def test_bad_lines(spark, tmp_path, line, words):
    good = '{"patientunitstayid": 1, "events": ["DX::A"], "representation": "basic"}'
    (tmp_path / "s.jsonl").write_text(f"{good}\n\n   \n{line}\n")
    with pytest.raises(ValueError, match=words):
        read_event_streams_jsonl(spark, str(tmp_path / "s.jsonl"))


def test_defaults_and_missing_fields(spark, tmp_path):
    good = '{"patientunitstayid": 1, "events": ["DX::A"], "representation": "basic"}'
    (tmp_path / "s.jsonl").write_text(f"{good}\n\n")
    row = read_event_streams_jsonl(spark, str(tmp_path / "s.jsonl")).first()
    assert row["event_times"] is None and row["metadata"] == {}
    with pytest.raises(ValueError, match="missing: events, representation"):
        streams_from_records(spark.createDataFrame([(1,)], "patientunitstayid long"))


def test_outcomes_have_a_header_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "patientunitstayid long, mortality int")
    for ordered in (True, False):
        path = tmp_path / str(ordered)
        write_outcomes_csv(empty, str(path), ordered=ordered)
        text = "".join(p.read_text() for p in path.glob("part-*"))
        assert text.strip() == "patientunitstayid,mortality"


def raw_tables(folder: Path) -> None:
    for name in SOURCE_TABLES:
        write(folder, name, "patientunitstayid\n")
    write(folder, "patient", "patientunitstayid,age,gender,hospitaldischargestatus\n101,65,Female,Alive\n")
    write(folder, "diagnosis", "patientunitstayid,diagnosisoffset,diagnosisstring\n101,0,Sepsis\n101,60,Acidosis\n")


def test_job(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "nested" / "out"
    raw_tables(raw)
    assert prepare_streams(spark, str(raw), str(out)) == (1, 0)
    assert {p.name for p in out.iterdir()} == {"event_streams.jsonl", "outcomes.csv", "event_stats.json"}
    streams = read_event_streams_jsonl(spark, str(out / "event_streams.jsonl"))
    assert streams.first()["representation"] == "timegap_static"
    assert [t for t, _ in collected(streams)[101]] == [
        "STATIC::AGE_BIN::60_70",
        "STATIC::GENDER::F",
        "DX::SEPSIS",
        "TIME_GAP::15M_1H",
        "DX::ACIDOSIS",
    ]
    outcomes = "".join(p.read_text() for p in (out / "outcomes.csv").glob("part-*"))
    assert outcomes == "patientunitstayid,mortality\n101,0\n"
    text = "".join(p.read_text() for p in (out / "event_stats.json").glob("part-*"))
    statistics = json.loads(text)
    assert statistics["kept_stays"] == 1
    assert list(statistics) == sorted(statistics)
    assert list(statistics["token_family_counts"]) == sorted(statistics["token_family_counts"])

    # A second run replaces the artifacts, also by empty ones.
    assert prepare_streams(spark, str(raw), str(out), "basic", 100) == (0, 1)
    text = "".join(p.read_text() for p in (out / "event_streams.jsonl").glob("part-*"))
    assert text == ""
    outcomes = "".join(p.read_text() for p in (out / "outcomes.csv").glob("part-*"))
    assert outcomes.strip() == "patientunitstayid,mortality"


def test_job_fails_before_writing(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(FileNotFoundError, match="patient.csv"):
        prepare_streams(spark, str(tmp_path / "missing"), str(out))
    raw_tables(tmp_path / "raw")
    with pytest.raises(ValueError, match="positive integer"):
        prepare_streams(spark, str(tmp_path / "raw"), str(out), min_events_per_stay=0)
    with pytest.raises(ValueError, match="representation"):
        prepare_streams(spark, str(tmp_path / "raw"), str(out), representation="other")
    assert not out.exists()


def test_command(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw_tables(raw)
    assert command.main(["--raw_dir", str(raw), "--out_dir", str(out)]) == 0
    printed = capsys.readouterr().out
    assert json.loads(printed.splitlines()[-1]) == {"streams": 1, "skipped_stays": 0}
    other = tmp_path / "other"
    for arguments, words in (
        (["--min_events_per_stay", "0"], "min_events_per_stay"),
        (["--raw_dir", str(tmp_path / "none")], "patient.csv"),
    ):
        base = ["--raw_dir", str(raw), "--out_dir", str(other)]
        assert command.main(base + arguments) == 2
        assert words in capsys.readouterr().err
    with pytest.raises(SystemExit):
        command.main([*base, "--representation", "raw"])
    assert not other.exists()


def test_command_reads_cells_with_line_breaks(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw_tables(raw)
    source = raw / "diagnosis.csv"
    header = source.read_text().splitlines()[0].split(",")
    cells = {"patientunitstayid": "101", "diagnosisstring": '"chest\npain"', "diagnosisoffset": "5"}
    source.write_text(source.read_text().rstrip("\n") + "\n" + ",".join(cells.get(c, "") for c in header) + "\n")
    base = ["--raw_dir", str(raw), "--out_dir", str(out), "--min_events_per_stay", "1"]
    assert command.main(base) == 2
    assert "multiline" in capsys.readouterr().err
    options = ["--multiline", "--unordered", "--id_type", "string", "--skip_row_checks"]
    assert command.main([*base, *options]) == 0
    text = "".join(f.read_text() for f in (out / "event_streams.jsonl").glob("part-*"))
    assert "DX::CHEST_PAIN" in text
