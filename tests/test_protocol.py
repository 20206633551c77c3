"""Vocabulary, masking, cap, protocol events, cohort rules and overlap against brute force."""

from __future__ import annotations

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chartweave.contract import GAP_BUCKETS, STAY_ID
from chartweave.operators import cohort, overlap, protocol, running, vocabulary

POSITIONS = f"{STAY_ID} long, position long, token string"
STREAMS = f"{STAY_ID} long, events array<string>, representation string, event_times array<double>, metadata map<string,string>"


def token_rows(seed: int, stays: int = 30):
    """A third of all tokens are one; some are null or rare, or look like special ones."""
    dice = random.Random(seed)
    names = ["DX::COMMON"] * 10 + [f"MED::M{i}" for i in range(15)] + ["STATIC::X", None, "[PAD]"]
    return [(s, p, dice.choice([*names, f"LAB::RARE{dice.randrange(60)}"])) for s in range(stays) for p in range(dice.randint(0, 40))]


@pytest.fixture(params=[200_000, 6])
def entries_broadcast(request, monkeypatch):
    monkeypatch.setattr(vocabulary, "MAX_BROADCAST_ENTRIES", request.param)
    monkeypatch.setattr(running, "RANGE_ROWS", 10**6 if request.param > 6 else 4)


def brute_vocabulary(rows):
    counts = Counter(t for _, _, t in rows if t and t not in vocabulary.SPECIAL_TOKENS)
    kept = sorted((t for t, n in counts.items() if n >= 5), key=lambda t: (-counts[t], t))
    return {t: i for i, t in enumerate([*vocabulary.SPECIAL_TOKENS, *kept])}


def test_vocabulary_and_back(spark, entries_broadcast):
    rows = token_rows(1)
    frame = spark.createDataFrame(rows, POSITIONS)
    for partitions in (1, 5):
        entries = vocabulary.fit_vocabulary(frame.repartition(partitions))
        assert {r.token: r.id for r in entries.collect()} == (ids := brute_vocabulary(rows))
    unseen = [*rows, (99, 0, "LAB::NEVER"), (99, 1, None)]
    encoded = vocabulary.encode(spark.createDataFrame(unseen, POSITIONS), entries)
    assert sorted((r[STAY_ID], r.position, r.id) for r in encoded.collect()) == [
        (s, p, ids.get(t, vocabulary.UNK)) for s, p, t in sorted(unseen, key=lambda r: r[:2])
    ]
    back = vocabulary.decode(encoded.drop("token"), entries).collect()
    names = {(s, p): t for s, p, t in unseen}
    for r in back:
        own = names[r[STAY_ID], r.position]
        assert r.token == (own if own in ids else "[UNK]")
    share = vocabulary.unknown_share(encoded).first()
    assert (share.tokens, share.unknown) == (len(unseen), sum(t not in ids for _, _, t in unseen))


def test_empty_vocabulary(spark):
    none = spark.createDataFrame([], POSITIONS)
    assert [r.id for r in vocabulary.fit_vocabulary(none).orderBy("id").collect()] == [0, 1, 2, 3]
    assert vocabulary.unknown_share(none.withColumn("id", F.lit(1))).first().share is None


def brute_mask(stay, position, number, static, size, epoch):
    digest = hashlib.md5(f"42:{epoch}:{stay}:{position}".encode()).hexdigest()
    pick, kind, other = (int(digest[a:b], 16) for a, b in ((0, 8), (8, 16), (16, 31)))
    if number in (0, 3) or static or pick >= int(0.15 * 2**32):
        return number, -100
    if kind < int(0.8 * 2**32):
        return 2, number
    return (4 + other % (size - 4) if kind < int(0.9 * 2**32) else number), number


def test_masking(spark):
    dice = random.Random(2)
    rows = [(s, p, dice.choice([0, 1, 3, *range(4, 40)]), dice.random() < 0.2) for s in range(150) for p in range(80)]
    frame = spark.createDataFrame(rows, f"{STAY_ID} long, position long, id long, fixed boolean")
    results = []
    for epoch, partitions in ((0, 1), (0, 7), (1, 3)):
        found = vocabulary.mask_tokens(frame.repartition(partitions), 40, epoch, static=F.col("fixed")).collect()
        got = sorted((r[STAY_ID], r.position, r.input_id, r.target_id) for r in found)
        assert got == [(s, p, *brute_mask(s, p, n, static, 40, epoch)) for s, p, n, static in rows]
        results.append(got)
    assert results[0] != results[2]
    selected = [g for g in results[0] if g[3] != -100]
    able = sum(not static and n not in (0, 3) for _, _, n, static in rows)
    assert abs(len(selected) / able - 0.15) < 0.02
    assert abs(sum(g[2] == 2 for g in selected) / len(selected) - 0.8) < 0.05
    assert all(0 <= g[2] < 40 for g in results[0])


def test_padded_sequences(spark):
    rows = [(1, 0, 7), (1, 1, 8), (2, 0, 9)]
    frame = spark.createDataFrame(rows, f"{STAY_ID} long, position long, id long")
    found = vocabulary.padded(vocabulary.encoded_sequences(frame), 4).orderBy(STAY_ID).collect()
    assert [(r.ids, r.attention_mask) for r in found] == [([3, 7, 8, 0], [1, 1, 1, 0]), ([3, 9, 0, 0], [1, 1, 0, 0])]
    with pytest.raises(Exception, match="more than 2 ids"):
        vocabulary.padded(vocabulary.encoded_sequences(frame), 2).collect()


# Cap ----------------------------------------------------------------------------------


def with_gaps(events):
    """Tokens and times, a gap token before each event that is later than the one before."""
    out, last = [], None
    for token, time in events:
        if None not in (last, time) and time > last:
            name = next(n for upper, n in GAP_BUCKETS if upper is None or time - last <= upper)
            out.append((f"TIME_GAP::{name}", time))
        out.append((token, time))
        last = time
    return out


def brute_cap(static, dynamic, most, gaps):
    """Tries each number of events downwards by the overflow, from the definition."""
    kept = max(min(2, len(dynamic)), min(len(dynamic), most - len(static)))
    while True:
        ranks = [int(i * (len(dynamic) - 1) / (kept - 1)) if kept > 1 else 0 for i in range(kept)]
        chosen = [dynamic[r] for r in ranks]
        out = [(t, None) for t in static] + (with_gaps(chosen) if gaps else chosen)
        if len(out) <= most or kept <= 2:
            return out
        kept = max(2, kept - (len(out) - most))


def test_cap(spark):
    dice = random.Random(4)
    streams, wanted = [], {}
    for stay in range(120):
        static = [f"STATIC::S{i}" for i in range(dice.choice([0, 1, 4]))]
        times = sorted(dice.choice([None, *range(0, 3000, dice.choice([1, 40, 700]))]) or 0.0 for _ in range(dice.randint(0, 60)))
        dynamic = [(f"DX::E{i}", float(t)) for i, t in enumerate(times)]
        if dynamic and dice.random() < 0.5:
            dynamic += [("MED::LATE", None)] * dice.randint(1, 5)
        gaps = dice.random() < 0.8
        whole = [(t, None) for t in static] + (with_gaps(dynamic) if gaps else dynamic)
        streams.append((stay, [t for t, _ in whole], "timegap" if gaps else "basic", [m for _, m in whole], {}))
        wanted[stay] = whole if len(whole) <= 20 else brute_cap(static, dynamic, 20, gaps)
    frame = spark.createDataFrame(streams, STREAMS).repartition(4)
    for r in protocol.cap_streams(frame, 20).collect():
        assert list(zip(r.events, r.event_times)) == wanted[r[STAY_ID]]
        assert len(r.events) <= 20
        original = [e for e in streams[r[STAY_ID]][1] if e.split("::")[0] not in ("STATIC", "TIME_GAP")]
        left = [e for e in r.events if e.split("::")[0] not in ("STATIC", "TIME_GAP")]
        assert left[:1] == original[:1] and left[-1:] == original[-1:]
    report = {r.family: (r.original, r.retained) for r in protocol.retained_families(frame, protocol.cap_streams(frame, 20)).collect()}
    assert report["STATIC"][0] == report["STATIC"][1] and report["DX"][0] > report["DX"][1]


def test_cap_keeps_ends_beside_many_static_tokens(spark):
    rows = [(1, [*["STATIC::S"] * 5, "DX::A", "DX::B", "DX::C"], "basic", [*[None] * 5, 1.0, 2.0, 3.0], {})]
    found = protocol.cap_streams(spark.createDataFrame(rows, STREAMS), 4).first()
    assert found.events == [*["STATIC::S"] * 5, "DX::A", "DX::C"]
    split = [(1, ["DX::A"], "basic", [1.0], {"chunks": "2"})]
    with pytest.raises(Exception, match="can't be capped"):
        protocol.cap_streams(spark.createDataFrame(split, STREAMS), 4).collect()


# Events ---------------------------------------------------------------------------------


def measured(seed, count=400):
    dice = random.Random(seed)
    value = lambda: dice.choice([None, float("nan"), float("inf"), *[dice.randrange(30) / 4 for _ in range(12)]])
    time = lambda: dice.choice([None, -1.0, 0.0, 59.0, 59.5, 60.0, 1439.0, 1440.0, 1440.5, dice.uniform(0, 200)])
    return [(dice.choice([1, 1, 2]), dice.choice(["VITAL::SAO2", "VITAL::HEARTRATE", "VITAL::OTHER", None]), value(), time(), i) for i in range(count)]


MEASURED = f"{STAY_ID} long, measurement string, value double, event_time double, line int"


def test_hourly_medians(spark):
    rows = measured(5)
    cells = defaultdict(list)
    for stay, name, value, time, _ in rows:
        if name in protocol.VITALS and value is not None and abs(value) < float("inf") and time is not None and 0 <= time <= 1440:
            cells[stay, name, int(time // 60)].append(value)
    wanted = [(*key[:2], statistics.median(v), min(60 * key[2] + 59, 1440)) for key, v in cells.items()]
    found = protocol.hourly_medians(spark.createDataFrame(rows, MEASURED).repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_last_per_minute(spark):
    rows = measured(6)
    last = {}
    for stay, name, value, time, line in rows:
        if None not in (name, value, time):
            last[stay, name, time // 1] = (value, time, line)
    wanted = sorted(str((stay, name, *v[:2])) for (stay, name, _), v in last.items())
    for partitions in (1, 6):  # whole and split files
        found = protocol.last_per_minute(spark.createDataFrame(rows, MEASURED).repartition(partitions), ["line"])
        assert sorted(str(tuple(r)) for r in found.collect()) == wanted


# Cohorts ----------------------------------------------------------------------------------


def test_eligibility_adds_up(spark):
    dice = random.Random(7)
    rows = [
        (i, dice.choice(["p", None, "q"]), dice.choice([1, 2, 3, None]), dice.choice([0, 1, None, 2]), dice.choice([None, 1439.0, 1440.0, 9000.0]))
        for i in range(200)
    ]
    events = [(dice.randrange(250),) for _ in range(1000)]
    counts = Counter(s for (s,) in events)

    def rule(r):
        if None in r[:3]:
            return "missing_id"
        if r[3] not in (0, 1):
            return "unknown_label"
        if r[4] is None or r[4] < 1440:
            return "left_early"
        return "few_events" if counts[r[0]] < 5 else "eligible"

    stays = spark.createDataFrame(rows, f"{STAY_ID} long, uniquepid string, hospitalid int, label int, unitdischargeoffset double")
    judged = cohort.eligibility(stays, spark.createDataFrame(events, f"{STAY_ID} long"))
    assert sorted((r[STAY_ID], r.rule) for r in judged.collect()) == [(r[0], rule(r)) for r in rows]
    report = cohort.exclusion_report(judged).collect()
    assert sum(r.stays for r in report) == len(rows)
    assert {(r.rule, r.label): r.stays for r in report} == Counter(
        (rule(r), str(r[3]) if r[3] in (0, 1) else "unknown") for r in rows
    )


def test_small_cells_cannot_be_recovered(spark):
    dice = random.Random(8)
    cells = [(g, f"c{i}", dice.choice([0, 1, 3, 9, 10, 11, 40])) for g in range(60) for i in range(dice.randint(1, 6))]
    found = cohort.suppress_small_cells(spark.createDataFrame(cells, "g int, cell string, stays long"), ["g"], "cell").collect()
    for g in range(60):
        before = {c: n for h, c, n in cells if h == g}
        after = {r.cell: (r.stays, r.cells) for r in found if r.g == g}
        shown = {c: n for c, (n, _) in after.items()}
        if min(before.values()) >= 10:
            assert shown == before
            continue
        assert sum(k for _, k in after.values()) == len(before)
        assert all(n is None or n >= 10 for n in shown.values())
        if shown.get("OTHER") is not None:  # a published remainder covers two cells or more
            assert after["OTHER"][1] >= 2 and sum(shown.values()) == sum(before.values())
        assert all(before[c] == n for c, n in shown.items() if c != "OTHER")


def test_other_reports(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a")]
    found = cohort.repeated_stays(spark.createDataFrame(rows, f"{STAY_ID} long, x string"), ["x"]).collect()
    assert sorted(map(tuple, found)) == [(1, 2, True), (2, 2, False)]
    events = spark.createDataFrame([(1, -1.0), (1, None), (1, 2.0), (2, 0.0), (None, 1.0)], f"{STAY_ID} long, event_time double")
    assert tuple(cohort.table_profile(events).first()) == (5, 2, 1, 3, 3, 1)
    assert tuple(cohort.table_profile(events.where("false")).first()) == (0, 0, None, None, None, 0)


# Overlap ------------------------------------------------------------------------------------


def test_rare_overlap(spark):
    dice = random.Random(9)
    sides = [[[dice.choice("abcd") for _ in range(dice.randint(0, 12))] for _ in range(40)] for _ in range(2)]

    def grams(streams, k):
        return Counter(tuple(e[i : i + k]) for e in streams for i in range(len(e) - k + 1))

    frames = [spark.createDataFrame([(e,) for e in side], "events array<string>").repartition(3) for side in sides]
    for r in overlap.rare_overlap(*frames, sizes=(1, 3, 5, 30), max_count=2).collect():
        learned, seen = (grams(side, r.size) for side in sides)
        rare = {g for g, n in learned.items() if n <= 2}
        assert tuple(r)[1:] == (
            len(learned), len(rare), len(seen), sum(seen.values()), len(learned.keys() & seen.keys()),
            len(rare & seen.keys()), sum(seen[g] for g in rare),
        )


def test_accuracy_by_frequency(spark):
    entries = spark.createDataFrame([("[UNK]", 1, None), ("a", 4, 50), ("b", 5, 9)], "token string, id long, count long")
    rows = [(4, 4), (4, 5), (5, 5), (1, 4), (-100, 4), (None, 4), (77, 77)]
    found = overlap.accuracy_by_frequency(spark.createDataFrame(rows, "target_id long, predicted_id long"), entries).collect()
    assert sorted(map(str, map(tuple, found))) == ["(10, 1, 1, 1.0)", "(100, 2, 1, 0.5)", "(None, 2, 1, 0.5)"]
