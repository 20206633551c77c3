"""URL verdicts: rules first, then host word segmentation and multinomial naive Bayes.

A unigram model of all words (counted by Spark over all page titles and URLs) splits the
names of a host into their likeliest words by Viterbi search. Each distinct name is split once, by
the counts of those words that it holds: its substrings are joined to the counts. Naive Bayes scores the words of the host
and the tokens of the path. It learns the likelihood of tokens from a bounded sample of URLs that seed words
mark: a URL is a positive example if a hyphen- or dot-separated part of its host is a
seed, so the model extends the seeds to words that occur with them, and the segmentation
extends it to names written together. The prior is the share of marked URLs among all distinct ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chartweave.llm.html_text import host_of
from chartweave.llm.shared import packed, write_through

#: (verdict, host, start of the path); the longest rule that fits a URL decides.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Parts of host names that mark unwanted sites.
SEEDS = (
    "adult ads bet bets betting casino escort gambling malware phishing pills poker porn spam track tracker viagra xxx"
).split()
#: Examples of each class for the tokens of naive Bayes, chosen by a hash of the URL.
EXAMPLES = 20_000
LONGEST_WORD = 24
#: Names of up to so many characters go with their substrings; of longer ones a digest does (no name has a dot).
LONGEST_NAME = 64
#: Substrings of names in one batch.
BATCH = 20_000
#: Characters of host names that may be broadcast with their scores; more are joined.
BROADCAST_CHARS = 8 << 20
_PREFIX = {"www", "m", "blog"}


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, site, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        text = F.when(fits, F.lit(site + start)).otherwise(text)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


class Segmenter:
    """Likeliest words of a concatenated name under a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """``total``: the sum of all counts, if ``counts`` has only some words."""
        self._total = math.log((sum(counts.values()) if total is None else total) + 1)
        self._cost = {w: self._total - math.log(n) for w, n in counts.items()}

    def _word(self, word: str) -> float:
        # Unknown words cost more the longer they are, in line with their number.
        return self._cost.get(word) or self._total + 2.5 * len(word)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = min(
                (best[s] + self._word(name[s:end]), s) for s in range(max(0, end - LONGEST_WORD), end)
            )
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def host_names(host: str) -> list[str]:
    """The hyphen-separated names of all parts of a host but its last one (the top-level domain)."""
    parts = re.split(r"[^a-z0-9\x80-\U0010ffff-]+", host)
    return [n for p in (parts[:-1] if len(parts) > 1 else parts) for n in p.split("-") if n and n not in _PREFIX]


def path_tokens(path: str) -> list[str]:
    words = re.findall(r"[^\W\d_]+|\d+", path.lower())
    return ["p:" + ("#" if w[0].isdigit() else w) for w in words]


class UrlModel:
    def __init__(self, hosts: DataFrame, rows: list, urls: dict[bool, int]) -> None:
        """``hosts``: the words of each host; ``rows``: counts of tokens in the sample; ``urls``:
        distinct URLs of each class in all rows."""
        self.hosts = hosts
        words = {r["token"] for r in rows}
        totals = {c: sum(r["n"] for r in rows if r["bad"] == c) for c in (False, True)}
        counts = {(r["bad"], r["token"]): r["n"] for r in rows}
        self.prior = math.log((urls.get(True, 0) + 1) / (urls.get(False, 0) + 1))
        base = math.log((totals[False] + len(words) + 1) / (totals[True] + len(words) + 1))
        self.weights = {
            w: base + math.log((counts.get((True, w), 0) + 1) / (counts.get((False, w), 0) + 1)) for w in words
        }


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [host_names(h) for h in batch.column("host").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(names, pa.list_(pa.string()))], names=["host", "names"]
        )


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word): the substrings of each name that may be words."""

    def pieces(name: str) -> Iterator[str]:
        for run in re.finditer(r"[^0-9]+", name):  # words have no digits
            for start in range(*run.span()):
                for end in range(start + 1, min(start + LONGEST_WORD, run.end()) + 1):
                    yield name[start:end]

    for batch in batches:
        for key, name in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist(), strict=True):
            own = pieces(name)
            while words := set(islice(own, BATCH)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(words)), pa.array(list(words))], names=["key", "word"]
                )


def _split(total: int):
    """(name, words): the likeliest words of each name, from the counts of those that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [
                Segmenter({f["word"]: f["n"] for f in found}, total).split(name)
                for name, found in zip(batch.column("name").to_pylist(), batch.column("found").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"]
            )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [
            [f"h:{w}" for w in words] + path_tokens(p)
            for words, p in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("bad"), pa.array(tokens, pa.list_(pa.string()))], names=["bad", "tokens"]
        )


def _weighed(weights: dict[str, float], column: str, result: str, tokens):
    """All columns, and as ``result`` the weight of the tokens of one; unknown tokens say nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sum((weights.get(t, 0.0) for t in tokens(x)), 0.0) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.float64())], names=[*batch.schema.names, result]
            )

    return run


def word_counts(rows: DataFrame, seeds=SEEDS) -> tuple[DataFrame, int]:
    """(word, n) of all words of hosts, paths and titles, and the sum of n."""
    words = F.split(F.lower(F.concat_ws(" ", "host", "path", "title")), r"[^\p{L}]+")
    counts = (
        rows.select(F.explode(words).alias("word"))
        .where((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = write_through(counts, "words")
    most = counts.agg(F.max("n")).first()[0] or 1
    # Seeds are ordinary words, however rare here.
    least = math.ceil(most / 1000)
    own = counts.sparkSession.createDataFrame([(s, least) for s in sorted(set(seeds))], "word string, n long")
    counts = counts.unionByName(own).groupBy("word").agg(F.max("n").alias("n"))
    return counts, counts.agg(F.sum("n")).first()[0] or 0


def host_words(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, words): the likeliest words of the names of each host, in order."""
    places = hosts.mapInArrow(_named, "host string, names array<string>").select(
        "host", F.posexplode_outer("names").alias("place", "name")
    )
    places = write_through(places, "host-names")
    # Substrings of a long name carry its digest, not the name.
    key = F.when(F.length("name") <= LONGEST_NAME, F.col("name")).otherwise(F.concat(F.sha2("name", 256), F.lit(".")))
    names = places.where(F.col("name").isNotNull()).select("name").distinct().select(key.alias("key"), "name")
    grams = names.mapInArrow(_substrings, "key string, word string").join(counts, "word")
    found = grams.select("key", F.lit(None).cast("string").alias("name"), F.struct("word", "n").alias("f")).unionByName(
        names.select("key", "name", F.lit(None).cast("struct<word:string,n:bigint>").alias("f"))
    )
    split = (
        found.groupBy("key")
        .agg(F.max("name").alias("name"), F.collect_set("f").alias("found"))
        .select("name", "found")
        .mapInArrow(_split(total), "name string, words array<string>")
    )
    # A place without names has no words; the others are put in order.
    parts = places.join(split, "name", "left").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts")
    )
    no_words = F.array().cast("array<string>")
    words = F.flatten(F.transform("parts", lambda p: F.coalesce(p["words"], no_words)))
    return parts.select("host", words.alias("words"))


def _small(table: DataFrame) -> DataFrame:
    chars = table.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    return F.broadcast(table) if chars <= BROADCAST_CHARS else table


def fit_url_model(pages: DataFrame, url: str = "url", markup: str = "html", seeds=SEEDS) -> UrlModel:
    """Count words and URLs over all pages, then learn tokens from at most EXAMPLES URLs of each class."""
    row = F.col("row")
    rows = packed(pages).select(
        host_of(row[url]).alias("host"),
        path_of(row[url]).alias("path"),
        F.regexp_extract(F.coalesce(row[markup].cast("string"), F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"),
    )
    counts, total = word_counts(rows, seeds)
    marked = F.col("host").rlike(rf"(^|[.-])({'|'.join(map(re.escape, seeds))})([.-])")
    urls = rows.select("host", "path", marked.alias("bad")).where(F.col("host") != "").distinct()
    urls = write_through(urls, "urls")
    shares = {r["bad"]: r["n"] for r in urls.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    hosts = write_through(host_words(urls.select("host").distinct(), counts, total), "host-words")
    hashed = urls.select("bad", F.struct(F.xxhash64("host", "path").alias("h"), "host", "path").alias("u"))
    picked = hashed.where(F.col("bad")).orderBy("u").limit(EXAMPLES).unionByName(
        hashed.where(~F.col("bad")).orderBy("u").limit(EXAMPLES)
    )
    sample = write_through(
        picked.select("bad", "u.host", "u.path")
        .join(_small(hosts), "host")
        .select("bad", "path", "words")
        .mapInArrow(_tokens, "bad boolean, tokens array<string>"),
        "url-tokens",
    )
    seen = sample.select("bad", F.explode("tokens").alias("token"))
    return UrlModel(hosts, seen.groupBy("bad", "token").agg(F.count(F.lit(1)).alias("n")).collect(), shares)


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", rules=RULES, seeds=SEEDS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    ``rule`` is the longest rule that fits (null: none) and decides; else the verdict is
    ``block`` if naive Bayes gives positive log odds (score). Null urls and such without
    ``://`` have an empty host and path and are judged by the prior. Repeated rows give a row
    each; other columns are ignored; an empty table gives an empty result.
    """
    model = fit_url_model(pages, url, markup, seeds)
    rows = packed(pages).select(
        F.col("row")[page_id].alias("page_id"), host_of(F.col("row")[url]).alias("host"), path_of(F.col("row")[url]).alias("path")
    )
    kind = dict(rows.dtypes)["page_id"]
    of_hosts = write_through(
        model.hosts.mapInArrow(
            _weighed(model.weights, "words", "own", lambda words: [f"h:{w}" for w in words]),
            "host string, words array<string>, own double",
        ).select("host", "own"),
        "host-scores",
    )
    judged = (
        rows.mapInArrow(
            _weighed(model.weights, "path", "rest", path_tokens),
            f"page_id {kind}, host string, path string, rest double",
        )
        .join(_small(of_hosts), "host", "left")
        .withColumn("score", F.lit(model.prior) + F.coalesce("own", F.lit(0.0)) + F.col("rest"))
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
