"""The training-data operators against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartweave.llm import (
    components,
    exact_dedup,
    html_text,
    language,
    mixing,
    near_dedup,
    packing,
    quality,
    token_codes,
    top_k,
    url_filter,
)
from chartweave.llm.queries import TOKENIZER

AWKWARD = [
    (None, None), (1, ""), (2, None), (3, "one"), (4, "one"), (4, "one"), (5, " \t\n"), (6, "ONE \x0b"),
    (7, "é ß \u2003x 漢字 <|endoftext|> it's"), (8, "long " * 30_000), (9, "12 34 !!"), (10, "a b c d e f g h i j k"),
]


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    table = [(i, t, "en", "x", 1, 2) for i, t in rows]
    return spark.createDataFrame(
        table, "doc_id long, text string, lang string, row string, label int, component_id long"
    ).repartition(3)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            up[top(j)] = top(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=str)


def near_rows():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = list(AWKWARD)
    for group in range(12):
        base = [dice.choice(words) for _ in range(dice.randint(8, 90))]
        for copy in range(dice.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(copy and dice.randint(0, max(1, len(own) // 12))):
                own[dice.randrange(len(own))] = dice.choice(words)
            rows.append((100 + 50 * group + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize(
    "leaf, levels, comparisons, kept",
    [(near_dedup.LEAF, near_dedup.MAX_LEVELS, near_dedup.COMPARISONS, near_dedup.KEPT_BYTES), (3, 2, 0, 0), (1, 1, 0, 0)],
)
def test_near_duplicates(spark, monkeypatch, leaf, levels, comparisons, kept):
    monkeypatch.setattr(near_dedup.similar_classes, "__defaults__", (leaf, levels))
    monkeypatch.setattr(near_dedup, "COMPARISONS", comparisons)
    monkeypatch.setattr(near_dedup, "KEPT_BYTES", kept)
    if not kept:
        monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(near_dedup, "BLOCK", 3)
    if levels == 1:  # no pivots: all links of crowded nodes are found inside blocks
        monkeypatch.setattr(near_dedup, "PIVOT_FROM", 10**9)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rows = near_rows()
    found = near_dedup.near_duplicates(docs_of(spark, rows), width=2).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == brute_components(rows, 2)
    # One leader for each component of documents with words, and every one without.
    with_words = {r.component_id for r in found if r.n_shingles}
    assert sum(r.leader for r in found if r.n_shingles) == len(with_words)
    assert all(r.leader for r in found if not r.n_shingles)


@pytest.mark.parametrize("levels", range(1, near_dedup.MAX_LEVELS + 1))
def test_trees_reach_the_target_at_every_depth(levels):
    first = near_dedup.tree_count(0.8)
    trees = first + near_dedup.more_trees(0.8, [(first, levels)])
    early = (1 - near_dedup.kept_by_tree(0.8, near_dedup.WIDE_LEVELS)) ** first if trees > first else 0
    assert early + (1 - near_dedup.kept_by_tree(0.8, levels)) ** trees <= 1 - near_dedup.TARGET_RECALL


def test_parity_bits_never_part_a_link():
    """They give a lower bound of the difference, over any two widths; at the threshold they keep a pair."""
    draw = np.random.default_rng(3)
    for size in (1, 2, 31, 33, 64, 500, 5_000):
        for other in {size, math.ceil(size * 0.8), size * 3 + 1}:
            common = draw.integers(0, min(size, other) + 1)
            pool = np.unique(draw.integers(0, 2**64, 4 * (size + other), dtype=np.uint64))
            draw.shuffle(pool)
            one = np.sort(pool[:size])
            two = np.sort(np.concatenate([one[:common], pool[size : size + other - common]]))
            ends = [np.frombuffer(near_dedup.parity_bits(h), np.uint64) for h in (one, two)]
            apart = len(np.setxor1d(one, two))
            assert near_dedup.least_apart(*ends) == near_dedup.least_apart(*ends[::-1]) <= apart
            linked = 100 * common >= 80 * (size + other - common)
            assert linked == (apart <= near_dedup._may_differ(np.int64(size + other), 80))
    assert len(near_dedup.parity_bits(np.empty(0, np.uint64))) == 8


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    """Pairs at the threshold in a group whose nodes are large down to the last level; no other link joins them."""
    monkeypatch.setattr(near_dedup.similar_classes, "__defaults__", (6, near_dedup.MAX_LEVELS))
    monkeypatch.setattr(near_dedup, "COMPARISONS", 0)
    monkeypatch.setattr(near_dedup, "PIVOT_FROM", 10**9)
    common = [f"c{i}" for i in range(38)]
    rows = []
    for i in range(240):
        own = [f"p{i // 2}x{j}" for j in range(2)] + [f"o{i}x{j}" for j in range(5)]
        rows.append((i, " ".join(common + own)))
    found = near_dedup.near_duplicates(docs_of(spark, rows), width=1).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i // 2 * 2 for i in range(240)}


def test_drop_near_duplicates_keeps_columns(spark):
    docs = docs_of(spark, near_rows())
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 4").count() + kept.where("doc_id = 3").count() == 1
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.vertex: r.label for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_duplicates(spark):
    rows = [*AWKWARD, *[(200 + i, "same  text") for i in range(40)], (199, "sametext")]
    found = exact_dedup.exact_duplicates(docs_of(spark, rows)).collect()
    bare = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        bare.setdefault(key, []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for key, members in bare.items():
        for m in members:
            digest = hashlib.sha256(key.encode()).hexdigest()
            want.append((m[3], min(members)[3], len(members), digest))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in found) == len(bare)
    assert exact_dedup.exact_duplicates(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


def test_token_codes(spark):
    path = public_tokenizers.path(TOKENIZER)
    found = sorted(token_codes.token_codes(docs_of(spark, AWKWARD), path).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(path)
    at = 0
    for row, (i, text) in zip(found, sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(row) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_codes.token_codes(docs_of(spark, AWKWARD).limit(0), path).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
def test_random_access(top):
    dice = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = dice.integers(0, top, n, endpoint=True, dtype=np.uint32)
        block = token_codes.Block(token_codes.encode_block(ids))
        places = dice.integers(0, n, 300) if n else np.empty(0, int)
        assert len(block) == n and (block.ids(places) == ids[places]).all()


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav>"
        "<div class='ad'>Buy now, buy now, buy now</div><article id=a1><h1>A &amp; B</h1><p><b>First  line<br>of the text,"
        " which goes on for some time.<p>Second &eacute; paragraph &quot;here&quot; is long too.<!-- no -->"
        "<div class='comments'><p>Nice article, thank you very much!</p></div></article><footer>&copy; x</footer>"
    )
    want = 'A & B\n\nFirst line of the text, which goes on for some time.\n\nSecond é paragraph "here" is long too.'
    pages = [(1, "http://a.org/x", page), (1, "http://a.org/x", page), (2, None, None), (3, "a.org", ""), (4, "http://a.org/", "plain <")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit(1))
    found = html_text.extract_main_text(frame).collect()
    got = sorted((r.page_id, r.text, r.n_chars) for r in found)
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain <", 7)]
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


def test_host_path_wins_over_own_best():
    short = "<body><div class=story><p>Short.</p></div><div class=box><p>" + "Much longer text. " * 20 + "</p></div></body>"
    assert html_text.main_text(short, "/body/div.story") == "Short."
    assert html_text.main_text(short, "/body/article").startswith("Much longer")


@pytest.mark.parametrize(
    ("attributes", "shown"),
    [
        ('style="overflow:hidden"', True),
        ('title="hidden gems"', True),
        ('title="my hidden gems', True),
        ('data-id="sidebar-1" data-class=menu', True),
        ('class="content has-sidebar"', True),
        ("class='with-left-sidebar no_menu'", True),
        ('class="a" class="menu"', True),
        ("hidden", False),
        ('style="x"hidden=""', False),
        ('data-x="id" ID = sidebar-1', False),
        ('class="content header-inner"', False),
        ('class="has-sidebar main-sidebar"', False),
        ("title='class=\"a\"' role=navigation", False),
    ],
)
def test_only_real_attributes_hide(attributes, shown):
    page = f"<body><div {attributes}><p>Long words of the article.</p></div><p>End.</p>"
    assert ("Long words of the article." in [t for _, t in html_text.blocks(page)]) == shown


PROSE = " ".join(f"Word {i} of the prose goes on." for i in range(8))
ITEMS = "".join(f"<li>Item {i} of a long list." for i in range(9))
CELLS = "".join(f"<tr><td>Cell {i} of<td>a long table." for i in range(9))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><p>Lead.</p><div class=content><p>{PROSE}</p></div></article>", ["Lead.", PROSE]),
        (f"<div><section class=intro><p>Intro.</p></section><section><p>{PROSE}</p></section></div>", ["Intro.", PROSE]),
        (
            f"<div><section><p>{PROSE}</p></section></div><div><section><a href=x>More of this</a></section></div>",
            [PROSE],
        ),
        (
            f"<div><p>First.</p><ul>{ITEMS}</ul><p>Last.</p></div>",
            ["First.", *(f"Item {i} of a long list." for i in range(9)), "Last."],
        ),
        (
            f"<div><p>First.</p><table>{CELLS}</table><p>Last.</p></div>",
            ["First.", *(t for i in range(9) for t in (f"Cell {i} of", "a long table.")), "Last."],
        ),
        (
            f"<table><tr><td><a href=x>Menu of a page</a><td><p>{PROSE}</p><p>End.</p></table>",
            [PROSE, "End."],
        ),
        (f"<div><h2>Head</h2><p>Lead.</p><div class=text><p>{PROSE}</p></div><p>Tail.</p></div>", ["Head", "Lead.", PROSE, "Tail."]),
        (f"<p>Short words.</p><ul>{'<li><a href=x>A link of a list</a>' * 9}</ul><div><p>{PROSE}</p></div>", [PROSE]),
        (f"<form id=aspnetForm><article><p>{PROSE}</p></article></form><footer>x</footer>", [PROSE]),
        (f"<form><div class=page-header><main><p>{PROSE}</p></main></div><p class=ad>Buy.</p></form>", [PROSE]),
        (f"<form><p>{PROSE}</p><p>Two.</p><p>Three.</p></form><nav><a href=x>Home</a></nav>", [PROSE, "Two.", "Three."]),
        (f"<div id=page-header-fixed><p>{PROSE}</p></div>", [PROSE]),
        (f"<div class=market-share-report><p>{PROSE}</p></div>", [PROSE]),
        # Parts beside stay out, however long, also where they hold articles of their own.
        (f"<article><p>Short.</p></article><section class=comments><article>{f'<p>{PROSE}' * 4}</article></section>", ["Short."]),
        (f"<div><p>Short.</p></div><div id=comments>{f'<p>{PROSE}' * 4}</div>", ["Short."]),
        (f"<div><p>{PROSE}</p></div><aside class=related><article><p>Other.</p></article></aside>", [PROSE]),
        ("<div class=cookie-notice><p>We use cookies.</p></div>", []),
        (f"<div><p>Words <span class=share>Share <b>this</b></span>go on.</p><p class=notice>{PROSE}</p></div>", ["Words go on."]),
    ],
)
def test_whole_articles(body, want):
    for page in (f"<html><body>{body}</body></html>", f"<body><div class=wrap>{body}</div></body>", body):
        assert html_text.main_text(page, None) == "\n\n".join(want)
    best = html_text.Page(f"<body>{body}").best()
    if want:  # the voted path leads to the same text
        assert html_text.main_text(f"<body>{body}", best.path()) == "\n\n".join(want)


def test_deep_pages_are_linear():
    n = 40_000
    tracemalloc.start()
    assert html_text.main_text("<div class=x1>" * n + f"<p>{PROSE}</p>" + "</div>" * n, None) == PROSE
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    began = time.process_time()
    many = html_text.main_text("<div>" * n + "<div class=k><p>a b</p></div>" * n, "/div" * n + "/div.k")
    assert many == "\n\n".join(["a b"] * n)
    html_text.main_text("<b>" * n + "<p>x</p></i>" * n, None)
    assert time.process_time() - began < 20  # seconds; what grows with the square takes minutes


def test_language_tasks_hold_features_of_a_bounded_sample(spark, monkeypatch):
    words = {"en": "the house and tree", "de": "das haus und baum", "fr": "la maison et arbre", "es": "una casa y el sol"}
    rows = [
        (i, " ".join(random.Random(i).choices(words[g].split(), k=400_000 if i < 4 else 12)), g)
        for i, g in enumerate(list(words) * 15)
    ]
    rows += [(100 + i, rows[4][1], "en") for i in range(300)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rank", F.lit("x"))
    seen = []

    def written(frame, name):
        seen.append(frame.toPandas())
        return spark.createDataFrame(seen[-1], frame.schema)

    monkeypatch.setattr(language, "write_through", written)
    monkeypatch.setattr(language, "FAMILY_ROWS", 8)
    model = language.fit_language_model(docs, "text", "lang", None, rows_each=5)
    (sample,) = seen
    assert set(sample.columns) == {"lang", "rank", "weights", "place"} and not sample.duplicated(["lang", "rank"]).any()
    assert sample.groupby("lang").size().to_dict() == dict.fromkeys(words, 5)
    assert {len(w) for w in sample["weights"]} == {language.WIDTH}
    names, _ = model.predict(language.features(pa.array([text for _, text, _ in rows])))
    assert names == [lang for _, _, lang in rows]


def test_urls(spark):
    urls = [
        "http://Blog.Example.net/en/1?x", "http://example.net/fr/1", "http://a.example.com/de/", "http://x.example.com/dex",
        "http://m.org/fr/2", "http://badexample.com/de/1", "http://q.net", "no scheme", None, "x://casino-win.com/a#/de/",
    ]
    train = [f"http://casino-win{i}.com/play" for i in range(30)] + [f"http://garden{i}.com/rose" for i in range(60)]
    rows = [(i, u, "<title>casino win garden</title>") for i, u in enumerate(urls + train)] + [(500, "http://casinowin.com/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(0))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert found[0] == ("blog.example.net", "/en/1", "example.net/en/", "allow")
    assert found[1][2:] == ("net/", "block") and found[2][2:] == ("example.com/de/", "block")
    assert found[3][2] is None and found[4][2:] == ("org/fr/", "allow") and found[5][2] is None
    assert found[6][:3] == ("q.net", "", None) and found[7][:3] == ("", "", None) and found[8][:3] == ("", "", None)
    assert found[9] == ("casino-win.com", "/a", None, "block")
    assert found[500][3] == "block" and found[60][3] == "allow"
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


def test_url_prior_counts_all_urls(spark, monkeypatch):
    train = [f"http://casino-win{i}.com/play" for i in range(10)] + [f"http://garden{i}.com/rose" for i in range(90)]
    rows = [(i, u, "<title>casino win garden</title>") for i, u in enumerate(train + train[:50])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(url_filter, "EXAMPLES", 10)
    model = url_filter.fit_url_model(frame)
    assert model.prior == pytest.approx(np.log(11 / 91))
    assert url_filter.fit_url_model(frame.limit(0)).prior == 0


def test_url_words_beyond_any_cap(spark):
    """Every word of the corpus counts for segmentation, in one model of all words."""
    digits = "bcdfghjklm"
    rare = ["".join(digits[int(d)] for d in str(i)) + "q" for i in range(100_000, 160_000)]
    rows = [(i, None, f"<title>{' '.join(rare[i::60] * 2)}</title>") for i in range(60)]
    rare_name = ["zzzebrawood", "zzoceanside", "zzmountains"]
    rows += [(100, f"http://{''.join(rare_name)}.m-b.com", f"<title>{' '.join(rare_name)}</title>")]
    rows += [(101, "http://Garden7ocean.é漢.b.com", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r.words for r in url_filter.fit_url_model(frame).hosts.collect()}
    assert found["".join(rare_name) + ".m-b.com"] == [*rare_name, "b"]
    counts = dict.fromkeys(rare, 2) | dict.fromkeys([*rare_name, *"garden ocean é漢 m".split(), *url_filter.SEEDS], 1) | {"b": 2, "com": 2}
    names = ["garden7ocean", "é漢", "b"]
    model = url_filter.Segmenter(counts)
    assert found["garden7ocean.é漢.b.com"] == [w for n in names for w in model.split(n)]


def test_long_host_names_are_split_whole(spark):
    name = "garden" * 50 + "casino"
    rows = [(i, f"http://{u}.com/", "<title>casino garden</title>") for i, u in enumerate([name, "garden-casino"])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r.words for r in url_filter.fit_url_model(frame).hosts.collect()}
    assert found[f"{name}.com"] == ["garden"] * 50 + ["casino"] and found["garden-casino.com"] == ["garden", "casino"]


def test_quality(spark):
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choice(["tree", "runs", "home", "of", "light"]) for _ in range(60)) + ".") for i in range(60)]
    rows += [(100 + i, " ".join("BUY!!" for _ in range(40))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100), None) for i, _ in rows] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_quality(docs_of(spark, rows + AWKWARD), labels, learn=F.col("doc_id") % 2 == 0).collect()
    assert len(found) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert all((r.score >= 0.3) == (r.doc_id < 100) for r in found if r.doc_id and r.doc_id > 10)
    assert quality.score_quality(docs_of(spark, rows).limit(0), labels).count() == 0


def test_languages(spark):
    said = {"en": "the house and this with that", "de": "das haus und nicht mit einer", "fr": "la maison avec des pour une", "es": "la casa con los para una"}
    dice = random.Random(2)
    rows = [
        (i, " ".join(dice.choice(said[g].split()) for _ in range(12)), g) for i, g in enumerate(list(said) * 30)
    ] + [(900, None, "en"), (901, "123 !?", "de"), (902, "", None), (903, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in language.identify_languages(docs, usable=F.col("doc_id") % 3 != 0).collect()}
    assert all(found[i].lang_pred == g for i, _, g in rows[:120])
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred in said
    assert language.drop_undetermined(docs).columns == docs.columns
    assert language.identify_languages(docs.limit(0)).count() == 0


def test_languages_of_copies_and_without_labels(spark):
    said = {"en": "the house and this with that", "de": "das haus und nicht mit einer", "fr": "la maison avec des pour une"}
    rows = [(i, said[g], g) for i, g in enumerate(list(said) * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify_languages(docs, rows_each=1).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: g for i, _, g in rows}
    some = docs.where("doc_id < 9").unionByName(spark.createDataFrame([(900, "12 !", "en")], docs.schema))
    kept = language.drop_undetermined(some.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(9))


def test_bucket_ends_are_optimal():
    dice = np.random.default_rng(4)
    for _ in range(20):
        m = int(dice.integers(1, 9))
        lengths = np.sort(dice.choice(60, m, replace=False))
        counts = dice.integers(1, 20, m)
        for buckets in (1, 2, 3):
            def waste(ends):
                return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

            ends = packing.bucket_ends(lengths, counts, buckets)
            best = min(
                waste([*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, m - 1))
            )
            assert ends[-1] == lengths[-1] and len(ends) <= buckets and waste(ends) == best


def test_packing(spark):
    found = packing.pack_batches(docs_of(spark, near_rows()), token_budget=200, buckets=4).collect()
    assert len(found) == len(near_rows()) and len({(r.batch_id, r.slot) for r in found}) == len(found)
    batches = {}
    for r in found:
        assert r.n_tokens <= r.padded_to
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and (len(own) == 1 or len(own) * own[0].padded_to <= 200)
    assert packing.pack_batches(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


def test_mixing(spark):
    dice = random.Random(5)
    rows = [(i, " ".join(dice.choice(["tree", "runs", "home", "light", "water"]) for _ in range(50))) for i in range(60)]
    rows += [(100 + i, "BUY!! NOW!! " * 25) for i in range(60)] + AWKWARD[:3]
    labels = spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in rows if i is not None] + [(None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    docs = docs_of(spark, rows)
    found = mixing.mixed_rates(docs, labels, {"good": 0.75, "low": 0.25, "toxic": 0.0}, most=4.0).collect()
    tokens = sum(r.n_tokens for r in found)
    for name, share in (("p_good", 0.75), ("p_low", 0.25)):
        assert abs(sum(r.rate * r.n_tokens * r[name] for r in found) / tokens - share) < 0.02
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in found)
    kept = mixing.mix(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert set(range(3, 60)) <= ids and sum(i is not None and i >= 100 for i in ids) < 60
    assert mixing.mixed_rates(docs.limit(0), labels).count() == 0
    assert mixing.mixed_rates(docs, labels.limit(0)).count() == len(rows)


def test_top_k(spark):
    dice = np.random.default_rng(6)
    rows = [(i, [float(x) for x in dice.integers(-3, 4, 6) / 256 * 9]) for i in range(90)]
    rows += [(7, rows[7][1]), (200, None), (201, [1.0, None, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.5]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = sorted(tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 7 == 0, k=4).collect())
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:91]]
    want = []
    for q, a in {i: v for i, v in ints if i % 7 == 0}.items():
        best = sorted((-int(a @ b), i) for i, b in ints if i != q)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == sorted(want)
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_top_k_of_huge_components_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 4)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 2)
    monkeypatch.setattr(top_k, "PIECE_ROWS", 2)
    dice = random.Random(8)
    sizes = [1e300, 1e15, 3e7, 1.0]
    rows = [(i % 25, [dice.choice((-1, 1)) * dice.choice(sizes) * dice.random() for _ in range(3)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 6 == 0, k=4).collect())
    top = 2**63 - 1

    def whole(x):
        return max(-top - 1, min(top, math.floor(256 * x) if abs(x) < 1e200 else int(math.copysign(2**64, x))))

    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in rows if i % 6 == 0}:
        # Both vectors of a query id are asked; all their results are one list.
        scored = [
            (-max(-top, min(top, sum(x * y for x, y in zip(a, b, strict=True)))), i)
            for j, a in ints if j == q for i, b in ints if i != q
        ]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:4])]
    assert found == sorted(want)
    assert any(abs(r[3]) == top for r in found)


def test_shingle_sets_match_words():
    texts = [t for _, t in near_rows()] + ["A\x0bB a\tb", "x" * 3_000_000]
    for width in (2, 5):
        sizes = [len(h) for h in near_dedup.shingle_sets(pa.array(texts).slice(1), width)]
        assert sizes == [len(shingles(t, width)) for t in texts[1:]]
