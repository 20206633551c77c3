"""The registered queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartweave.llm.divergence import source_divergence
from chartweave.llm.exact_dedup import exact_duplicates
from chartweave.llm.html_text import extract_main_text
from chartweave.llm.language import identify_languages
from chartweave.llm.mixing import mixed_rates
from chartweave.llm.near_dedup import near_duplicates
from chartweave.llm.packing import pack_batches
from chartweave.llm.quality import score_quality
from chartweave.llm.ranked_search import ranked_search
from chartweave.llm.repeats import remove_repeats
from chartweave.llm.token_codes import token_codes
from chartweave.llm.top_k import top_k
from chartweave.llm.url_filter import judge_urls

#: File name of the vocabulary in the folder of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_tokens", "p_good", "p_low", "p_toxic", "rate", "copies")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def _fold(folds: int) -> Column:
    """Null for a null id: such a row is neither learned from nor held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(_fold(folds) == fold, F.lit(False)).alias("held_out")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = score_quality(documents, labels, learn=_fold(5) != 0)
    return found.select(
        "doc_id",
        _held_out(5, 0),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_table(spark, sf_dir, "documents"), usable=_fold(4) != 2)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_batches(_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_token_codes": op2_token_codes,
        "op3_html_text": op3_html_text,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mixing": op5_mixing,
        "op6_url_filter": op6_url_filter,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_packing": op9_packing,
        "op10_top_k": op10_top_k,
        "op11_divergence": op11_divergence,
        "op12_repeats": op12_repeats,
        "op13_ranked_search": op13_ranked_search,
    }


_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s
  FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT i.a, i.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY 1, 2) i
  JOIN sizes p ON p.doc_id = i.a JOIN sizes q ON q.doc_id = i.b
  WHERE 100 * i.both >= 80 * (p.n + q.n - i.both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_OP4 = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), digests AS (SELECT doc_id, chars, sha256(bare) AS text_sha256 FROM plain)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM digests WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


_OP10 = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


_OP11 = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), counts AS MATERIALIZED (
  SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(w) AS term FROM words)
  GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY lang, term HAVING count(*) >= 3
), langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM words),
cells AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL) c
    USING (lang, source, term)
), sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 1)) // (s.n + l.v) AS p,
         1 + (1000000000 * (c.total + 1)) // (l.n + l.v) AS q
  FROM cells c JOIN sums s USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_OP12 = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS MATERIALIZED (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)
), firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT rid, i + k AS i
  FROM (SELECT w.rid, w.i, unnest(range(50)) AS k FROM windows w JOIN firsts f ON f.s = w.s AND w.doc_id > f.low)
), words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts),
kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, len(t.w) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (rid)
"""

_OP13 = r"""
WITH words AS MATERIALIZED (
  SELECT rid, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), counts AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS MATERIALIZED (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY rid),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
), asked AS (
  SELECT qid, item_id, term, count(*) AS times
  FROM (
    SELECT qid, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark))
  GROUP BY ALL
), scores AS (
  SELECT a.qid, a.item_id, c.rid, c.doc_id,
    CAST(sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * s.n * t.docs) // t.terms))))
      AS BIGINT) AS score
  FROM asked a JOIN counts c USING (term) JOIN weights w USING (term) JOIN sizes s ON s.rid = c.rid, totals t
  GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": _OP1,
        "op4_exact_dedup": _OP4,
        "op10_top_k": _OP10,
        "op11_divergence": _OP11,
        "op12_repeats": _OP12,
        "op13_ranked_search": _OP13,
    }
