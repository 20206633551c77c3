"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. Each
stage looks only at rows of groups that the stage before left with two rows or more.
Everything is DataFrame functions; every grouping merges map-side, so a group of
any size sends one row per task, and joins back to rows are plain equi-joins that adaptive
execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartweave.llm.shared import ROW_KEY, dropping, identified, located, restricted, without_space, write_through

#: Characters of the normalised text that the second stage hashes.
PREFIX_CHARS = 64


def _facts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = identified(docs)
    plain = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    bare = without_space(plain)
    return rows.select(
        "__file",
        "__row",
        F.col("row")[doc_id].alias("doc_id"),
        F.length(plain).cast("long").alias("chars"),
        F.length(bare).cast("long").alias("size"),
        F.xxhash64(F.substring(bare, 1, PREFIX_CHARS)).alias("prefix"),
    )


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that two rows or more have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of groups of equal texts: __file, __row, doc_id, keep_id, group_size, leader.

    Only groups of two rows or more are returned. The row with the most characters in
    the original text, then the smallest id, stays (null ids come last); ``leader`` is
    true for exactly one row of a group, also among repeated rows. Null texts equal
    empty ones. Other columns are ignored; an empty table gives an empty result.
    """
    docs = located(docs)
    facts = write_through(_facts(docs, text, doc_id), "lengths")
    by_length = facts.join(_shared(facts, "size"), "size", "left_semi")
    by_prefix = write_through(_shared(by_length, "size", "prefix"), "prefixes")
    # Full contents are hashed only for what is left; no text is shuffled.
    rows = identified(docs)
    bare = without_space(F.col("row")[text])
    survivors = restricted(
        rows.select(
            "__file",
            "__row",
            F.col("row")[doc_id].alias("doc_id"),
            F.length(F.coalesce(F.col("row")[text].cast("string"), F.lit(""))).cast("long").alias("chars"),
            F.length(bare).cast("long").alias("size"),
            F.xxhash64(F.substring(bare, 1, PREFIX_CHARS)).alias("prefix"),
            F.unhex(F.sha2(bare, 256)).alias("digest"),
        ),
        by_prefix,
        ["size", "prefix"],
    )
    full = write_through(survivors.select("__file", "__row", "doc_id", "chars", "size", "digest"), "digests")
    order = F.struct(
        (-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row"
    )
    groups = (
        full.groupBy("size", "digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
        .where("group_size > 1")
    )
    return full.join(groups, ["size", "digest"]).select(
        "__file",
        "__row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))).alias("leader"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts; same columns, any extra ones included."""
    docs = located(docs)
    dropped = exact_groups(docs, text, doc_id).where(~F.col("leader")).select("__file", "__row")
    return dropping(identified(docs), dropped, ROW_KEY).select("row.*")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows without an equal have themselves as keep_id and size 1. The digest (of the
    normalised text in UTF-8) is an output for every row, so a last map-only pass over the texts
    computes it; it decides nothing.
    """
    docs = located(docs)
    groups = exact_groups(docs, text, doc_id).drop("doc_id")
    rows = identified(docs).select(
        "__file",
        "__row",
        F.col("row")[doc_id].alias("doc_id"),
        F.sha2(without_space(F.col("row")[text]), 256).alias("text_sha256"),
    )
    single = F.col("group_size").isNull()
    return rows.join(groups, ["__file", "__row"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("leader", F.lit(True)).alias("kept"),
        "text_sha256",
    )
