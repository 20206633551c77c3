"""Repeated passages, ranked search and source divergence against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chartweave.llm import divergence, ranked_search, repeats

AWKWARD = [
    (None, None), (None, "x y z"), (1, ""), (2, None), (3, "one"), (4, "one"), (4, "one"), (5, " \t\n"),
    (6, "ONE \x0b one"), (7, "é ß  x 漢字 <|endoftext|> it's"), (8, "long " * 30_000), (9, "12 34 !!"),
    (10, "x" * 200_000), (11, "A1b2 \x1f c\x85d"),
]


def invented(seed: int, count: int, words: int = 60) -> list[tuple[int | None, str]]:
    """Documents that share passages and whole texts, with repeated and missing ids."""
    dice = random.Random(seed)
    terms = [f"w{i}" if i % 3 else f"Wört{i}" for i in range(words)]
    passages = [" ".join(dice.choices(terms, k=dice.randint(3, 25))) for _ in range(6)]
    out: list[tuple[int | None, str]] = []
    for i in range(count):
        parts = [" ".join(dice.choices(terms, k=dice.randint(0, 30))) for _ in range(3)]
        for _ in range(dice.randint(0, 3)):
            parts.insert(dice.randint(0, len(parts)), dice.choice(passages))
        text = dice.choice(["  ", "\n", " "]).join(parts)
        if out and dice.random() < 0.3:
            text = dice.choice(out)[1]
        out.append((dice.choice([i, i, i, i // 2, None]), text))
    dice.shuffle(out)
    return out


def table(spark, rows, extra="lang string, source string, row string, n int, at int, `Text_` string"):
    filled = [(i, t, "en", "s", "r", 1, 2, "x") for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {extra}").repartition(3)


def in_order(rows):
    return sorted(rows, key=str)


# Repeated passages ----------------------------------------------------------------


def brute_repeats(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    starts = defaultdict(set)
    for i, words in texts:
        for at in range(len(words) - window + 1):
            if i is not None:
                starts[tuple(words[at : at + window])].add(i)
    first = {key: min(ids) for key, ids in starts.items() if ids}
    out = []
    for i, words in texts:
        gone = set()
        for at in range(len(words) - window + 1):
            low = first.get(tuple(words[at : at + window]))
            if i is not None and low is not None and low < i:
                gone |= set(range(at, at + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return in_order(out)


@pytest.mark.parametrize("window, heavy", [(1, 10_000), (4, 10_000), (7, 0), (10, 3), (50, 10_000)])
def test_repeats(spark, monkeypatch, window, heavy):
    monkeypatch.setattr(repeats, "HEAVY_ROWS", heavy)
    rows = invented(window, 120) + (AWKWARD if window == 50 else AWKWARD[:10])
    rows.append((500, "long " * 40))
    found = repeats.remove_repeats(table(spark, rows), window=window).collect()
    assert in_order((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == brute_repeats(rows, window)
    for r in found:
        spans = list(zip(r.starts or [], r.ends or []))
        assert sum(e - s for s, e in spans) == r.n_removed
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # maximal: no two of them touch


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(table(spark, [(1, "x")]).where("false")).collect() == []


@pytest.mark.parametrize("window", [1, 2, 3, 9, 50])
def test_runs_cover_all_windows(window):
    """Each window is in one run, and equal windows have equal minimisers and hashes."""
    texts = [t.encode() for _, t in invented(7, 40)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = repeats._Words(np.frombuffer(b"".join(texts), np.uint8), starts)
    text, least, at, n = words.runs(window)
    spots = np.concatenate([np.arange(a, a + k) for a, k in zip(at, n)])
    lists = [t.split() for t in texts]
    flat = [w for one in lists for w in one]
    assert len(spots) == sum(max(0, len(one) - window + 1) for one in lists) == len(set(spots.tolist()))
    h, g = words.hashes(spots, spots + window)
    named = defaultdict(set)
    for spot, run, one, other in zip(spots, np.repeat(np.arange(len(n)), n), h, g):
        named[tuple(flat[spot : spot + window])].add((int(least[run]), int(one), int(other)))
    assert all(len(names) == 1 for names in named.values())
    assert len({next(iter(names))[1:] for names in named.values()}) == len(named)


# Ranked search --------------------------------------------------------------------


def words_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]


def brute_search(rows, items, k):
    bags = [(i, Counter(words_of(t))) for i, t in rows]
    bags = [(i, bag) for i, bag in bags if bag]
    count, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * count) // total
            score = 0
            for term in words_of(text):
                weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                score += weight * ((10**9 * bag[term]) // (1000 * bag[term] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(best, 1)]
    return in_order(out)


ITEMS = [(1, "w1 w2 Wört3 w1"), (2, None), (3, ""), (4, "nowhere"), (4, "ONE one 12"), (None, "漢字 é A1B2"), (6, "w5 w7 w8")]


@pytest.mark.parametrize("k, blocks, step", [(20, 1, 1 << 20), (3, 1, 7), (5, 8, 1)])
def test_ranked_search(spark, monkeypatch, k, blocks, step):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 64 // blocks)
    monkeypatch.setattr(ranked_search, "SCORES", step)
    monkeypatch.setattr(ranked_search, "SPREAD", step)
    rows = invented(11, 150) + AWKWARD
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    found = ranked_search.ranked_search(table(spark, rows), items, k=k).collect()
    assert in_order((r.item_id, r.rank, r.doc_id, r.score) for r in found) == brute_search(rows, ITEMS, k)


def test_a_hot_class_is_scored_once(spark, monkeypatch):
    """A third of all rows are one class; only its smallest members are expanded."""
    rows = [(i, "w1 w2") for i in range(200)] + [(1000 + i, f"w1 x{i}") for i in range(400)]
    items = spark.createDataFrame([(1, "w2 w1")], "item_id long, text string")
    found = ranked_search.ranked_search(table(spark, rows), items).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in found] == [(i + 1, i) for i in range(20)]


def test_searches_without_rows(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    docs = table(spark, AWKWARD[:7])
    assert ranked_search.ranked_search(docs.where("false"), items).collect() == []
    assert ranked_search.ranked_search(docs, items.where("false")).collect() == []


# Source divergence ----------------------------------------------------------------


def brute_divergence(rows, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        sources = sorted(s for g, s in groups if g == lang)

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 1)) // (total + len(kept)) for t in kept}

        of = {s: p(count[lang, s]) for s in sources}
        whole = p(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept)) for o in sources if o != s]
            terms = [
                (t, (of[s][t] - whole[t]) ** 2 // whole[t])
                for t in kept if count[lang, s][t] and of[s][t] > whole[t]
            ]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows():
    dice = random.Random(5)
    rows = [(t, dice.choice(["en", "de", None, ""]), dice.choice(["a", "b", "c", "ü", None])) for _, t in invented(3, 200)]
    rows += [(t, "xx", "only") for _, t in AWKWARD[:4]] + [(None, "xx", "other"), ("one", "yy", "single")]
    return rows + [(t, "en", "awkward") for _, t in AWKWARD]


@pytest.mark.parametrize("block, sources, held", [(16_384, 48, 1 << 19), (7, 2, 10), (1, 1, 0)])
def test_divergence(spark, monkeypatch, block, sources, held):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n int")
    found = divergence.source_divergence(docs.repartition(3), top=5).collect()
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found)
    assert got == brute_divergence(rows, 5)
    assert divergence.source_divergence(docs.where("false")).collect() == []


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.array([[1, 2, 3, 4], [1, 2, 3, 4], [0, 2, 3, 4]]), 64)
    trees = divergence.Trees(counts)
    assert trees.roots[0] == trees.roots[1] != trees.roots[2]
    assert sum(len(left) for left, _ in trees.levels) < 20  # 3 * 255 without sharing
    walk, mine, other, times = trees.together(0, np.array([1, 2]))
    assert sorted(zip(walk.tolist(), mine.tolist(), other.tolist(), times.tolist())) == [
        (w, c, 0 if w and c == 1 else c, 64) for w in (0, 1) for c in (1, 2, 3, 4)
    ]


def test_shares_beyond_64_bits():
    counts = np.array([0, 10**10, 5 * 10**12])
    assert divergence.shares(counts, 10**13).tolist() == [1 + 10**9 * (c + 1) // 10**13 for c in counts.tolist()]
