"""Vocabulary, encoding and masked-event corruption of token sequences, in long form.

Long form is one row per position of a stay, as ``plans.build.stream_positions`` gives it. Nothing
here needs a whole stay in one task, except the last step that pads sequences of bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.contract import STAY_ID
from chartweave.operators.running import dense_ids
from chartweave.operators.shared_storage import write_through

#: The special tokens in the order of their ids, and the label of what is not predicted.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[MASK]", "[CLS]")
PAD, UNK, MASK, CLS = range(4)
NOT_PREDICTED = -100

MIN_COUNT = 5
MASKED_SHARE, MASK_SHARE, RANDOM_SHARE = 0.15, 0.8, 0.1
SEED = 42
#: Entries of a vocabulary that may be broadcast; of larger ones only the most frequent are.
MAX_BROADCAST_ENTRIES = 200_000


def fit_vocabulary(tokens: DataFrame, token: str = "token", min_count: int = MIN_COUNT) -> DataFrame:
    """``(token, id, count)``: the special tokens, then all with at least ``min_count`` occurrences.

    Ids are dense and go by count downwards, then token; they don't depend on order or partitioning.
    Special tokens have ids 0 to 3 and no count, also where they occur in the data; null tokens
    don't count. Pass training rows only.
    """
    counts = (
        tokens.where(F.col(token).isNotNull() & ~F.col(token).isin(*SPECIAL_TOKENS))
        .groupBy(F.col(token).alias("token"))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
    )
    numbered = dense_ids(counts, [F.col("count").desc(), F.col("token")], "id")
    special = tokens.sparkSession.createDataFrame(
        [(name, number, None) for number, name in enumerate(SPECIAL_TOKENS)], "token string, id bigint, count bigint"
    )
    found = numbered.select("token", (F.col("id") + len(SPECIAL_TOKENS)).alias("id"), "count")
    return write_through(special.unionByName(found), "vocabulary")


def _looked_up(rows: DataFrame, vocabulary: DataFrame, on: str, wanted: str) -> DataFrame:
    """``rows`` with a column of the vocabulary, null where it has none.

    The most frequent entries are broadcast, so that their many rows stay where they are. The rest, if
    there is one, is joined by a shuffle of the other rows.
    """
    entries = vocabulary.select(
        F.col(on).alias("__key"), F.col(wanted).alias("__found"), (F.col("id") < MAX_BROADCAST_ENTRIES).alias("__front")
    )
    front = entries.where("__front").drop("__front")
    marked = rows.join(F.broadcast(front), rows[on] == front["__key"], "left").drop("__key")
    if vocabulary.limit(MAX_BROADCAST_ENTRIES + 1).count() > MAX_BROADCAST_ENTRIES:
        # Only rows with a key that the front lacks travel; null keys would all meet in one task.
        tail = entries.where("NOT __front").drop("__front")
        settled = F.col("__found").isNotNull() | F.col(on).isNull()
        open_rows = marked.where(~settled).drop("__found")
        joined = open_rows.join(tail, open_rows[on] == tail["__key"], "left").drop("__key")
        marked = marked.where(settled).unionByName(joined)
    return marked.withColumnRenamed("__found", wanted)


def encode(positions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``positions`` (with a column ``token``) and its ``id``; unknown and null tokens are ``[UNK]``."""
    found = _looked_up(positions, vocabulary, "token", "id")
    return found.withColumn("id", F.coalesce("id", F.lit(UNK)).cast("bigint"))


def decode(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows with a column ``id`` (and no ``token``) and their ``token``; ids beyond the vocabulary give null."""
    return _looked_up(encoded, vocabulary, "id", "token")


def unknown_share(encoded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tokens, unknown, share)``: how much of each group is ``[UNK]``."""
    counts = encoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("id") == UNK).alias("unknown")
    )
    share = F.col("unknown").cast("double") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0))
    return counts.withColumn("share", share)


def _digits(text: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(text, start, length), 16, 10).cast("bigint")


def mask_tokens(
    encoded: DataFrame,
    vocabulary_size: int,
    epoch: int,
    seed: int = SEED,
    static: Column | None = None,
    share: float = MASKED_SHARE,
) -> DataFrame:
    """``encoded`` with ``input_id`` and ``target_id`` for masked-event modelling.

    Each position is selected on its own with the chance ``share``, but never ``[PAD]``, ``[CLS]`` or
    a row where ``static`` holds. Of the selected 80 % become ``[MASK]``, 10 % a random other entry of
    the vocabulary (any but the special ones), 10 % stay; the target is the original id there
    and -100 elsewhere. The draws are a hash of seed, epoch, stay and position, so they are the same
    for any partitioning and on a repeated task, and differ between epochs. Without an entry beside
    the special tokens, the random ones become ``[MASK]`` too.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(STAY_ID).cast("string"), F.col("position").cast("string"))
    never = F.col("id").isin(PAD, CLS)
    if static is not None:
        never = never | F.coalesce(static, F.lit(False))
    entries = vocabulary_size - len(SPECIAL_TOKENS)
    rows = encoded.withColumn("__draw", F.md5(key)).withColumn(
        "__masked", ~never & (_digits(F.col("__draw"), 1, 8) < F.lit(int(share * 2**32)))
    )
    kind = _digits(F.col("__draw"), 9, 8)
    random_id = F.lit(MASK) if entries <= 0 else F.lit(len(SPECIAL_TOKENS)) + _digits(F.col("__draw"), 17, 15) % entries
    replaced = (
        F.when(~F.col("__masked"), F.col("id"))
        .when(kind < int(MASK_SHARE * 2**32), F.lit(MASK))
        .when(kind < int((MASK_SHARE + RANDOM_SHARE) * 2**32), random_id)
        .otherwise(F.col("id"))
    )
    return rows.select(
        *encoded.columns,
        replaced.cast("bigint").alias("input_id"),
        F.when(F.col("__masked"), F.col("id")).otherwise(F.lit(NOT_PREDICTED)).cast("bigint").alias("target_id"),
    )


def encoded_sequences(encoded: DataFrame, carried: Sequence[str] = (), id_column: str = "id") -> DataFrame:
    """``(stay, *carried, ids)``: one row per stay, ``[CLS]`` and its ids in order of position.

    For streams of bounded length (``protocol.cap_streams``); ``carried`` are constant in a stay.
    """
    ordered = F.sort_array(F.collect_list(F.struct("position", F.col(id_column).alias("id"))))
    gathered = encoded.groupBy(STAY_ID, *carried).agg(ordered.alias("__ids"))
    ids = F.concat(F.array(F.lit(CLS).cast("bigint")), F.transform("__ids", lambda x: x["id"].cast("bigint")))
    return gathered.select(STAY_ID, *carried, ids.alias("ids"))


def padded(sequences: DataFrame, width: int) -> DataFrame:
    """``ids`` filled up with ``[PAD]`` to ``width``, and ``attention_mask``; longer ones are refused."""
    size = F.size("ids")
    fits = F.when(size > width, F.raise_error(F.lit(f"a sequence has more than {width} ids"))).otherwise(size)
    missing = F.lit(width) - fits.cast("int")
    filled = F.concat("ids", F.array_repeat(F.lit(PAD).cast("bigint"), missing))
    mask = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), missing))
    others = [c for c in sequences.columns if c != "ids"]
    return sequences.select(*others, filled.alias("ids"), mask.alias("attention_mask"))
