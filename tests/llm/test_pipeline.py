"""The corpus pipeline on a small written fixture: every stage against brute force on its own input."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
from chartweave.llm import queries
from chartweave.llm.shared import write_through
from test_training_data import brute_components, near_rows

SPACE = re.compile("[\x20\x09-\x0d]+")


def documents():
    dice = random.Random(12)
    rows = [(i, text) for i, text in near_rows() if i is not None]
    rows += [(900, rows[-1][1] + " \t\n"), (901, "12 34 !?"), (902, rows[-1][1].replace(" ", "\n"))]
    rows += [(1000 + i, " ".join(dice.choices("spam cheap pills offer now win".split(), k=30)) + f" x{i}") for i in range(20)]
    rows += [(2000, "long " + " ".join(f"word{i}" for i in range(30_000)))]
    langs = ["en", "de", None]
    return [(i, t, langs[n % 3], "web" if n % 3 else "hot", len(t or ""), "own") for n, (i, t) in enumerate(rows)]


def counted(frame):
    out = {}
    for row in frame.collect():
        out[tuple(row)] = out.get(tuple(row), 0) + 1
    return out


def test_stages_one_by_one(spark, tmp_path):
    rows = documents()
    columns = "doc_id long, text string, lang string, source string, n_chars int, kept string"
    docs = spark.createDataFrame(rows, columns)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 1000), int(i >= 1000 and i < 2000)) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    tables = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(write_through(stage(spark, tables[-1], str(tmp_path)), name.replace(" ", "-")))
    start, spoken, exact, near, mixed, packed = tables
    assert all(t.columns == start.columns for t in tables[:-1])

    # Language: only texts without a letter go.
    want = {r: n for r, n in counted(start).items() if any(c.isalpha() for c in r[1] or "")}
    got = counted(spoken)
    assert got == want and not any(r[0] == 901 for r in got)

    # Exact copies: the longest text, then the smallest id.
    groups = {}
    for row in got:
        groups.setdefault(SPACE.sub("", row[1]), []).append(row)
    want = {min(g, key=lambda r: (-len(r[1]), r[0])): 1 for g in groups.values()}
    got = counted(exact)
    assert got == want

    # Near copies: one of each component by shingles of five words at 0.8.
    ids = {i: own for i, _, own in brute_components([(r[0], r[1]) for r in got], 5)}
    kept = counted(near)
    assert set(kept) <= set(got) and len(kept) == len(set(ids.values()))
    assert {ids[r[0]] for r in kept} == set(ids.values())

    # Mixing thins toxic and low documents, never copies or changes one.
    left = counted(mixed)
    assert set(left) <= set(kept) and set(left.values()) == {1}
    clean = {r for r in kept if r[0] < 1000 and len(r[1].split()) > 8}
    assert clean and clean <= set(left)

    # Packing: every document once, slots within the token budget and the bucket's length.
    words = {r[0]: len([w for w in SPACE.split(r[1]) if w]) for r in left}
    batches = {}
    for row in packed.collect():
        assert words.pop(row["doc_id"]) == row["n_tokens"] <= row["padded_to"]
        batches.setdefault(row["batch_id"], []).append(row)
    assert not words and sorted(batches) == list(range(len(batches)))
    for members in batches.values():
        assert len({m["padded_to"] for m in members}) == 1
        assert sorted(m["slot"] for m in members) == list(range(len(members)))

    assert counted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "padded_to")) == counted(
        packed.select("doc_id", "n_tokens", "padded_to")
    )


def test_folds_and_thresholds_of_registered_queries(spark, tmp_path):
    dice = random.Random(4)
    good, low = "the house and the tree of a long road".split(), "BUY!! 99 $$$ cheap ## now 00".split()
    rows = [(i, " ".join(dice.choices(low if i % 3 == 0 else good, k=40)), "en" if i % 3 else "de") for i in range(60)]
    rows += [(None, "the house of a long road", "en"), (70, None, "en"), (71, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 != 0), 0) for i in range(60)] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def fold(i, folds):
        return None if i is None else zlib.crc32(str(i).encode()) % folds

    found = queries.op7_quality(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or -1 for r in found) == sorted(r[0] or -1 for r in rows)
    for r in found:
        assert r["held_out"] is (fold(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 60)

    found = queries.op8_language(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] is (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] in (70, 71):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == ("en" if r["doc_id"] % 3 else "de")
