"""Binary labels and the bit masks that combine them per stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.contract import NEGATIVE_LABELS, POSITIVE_LABELS
from chartweave.functions.text import fold_text


def outcome_label(
    value: Column,
    data_type: T.DataType | None = None,
    negative: Sequence[str] = NEGATIVE_LABELS,
    positive: Sequence[str] = POSITIVE_LABELS,
) -> Column:
    """0 or 1 for an explicit label, else null.

    A numeric column counts only when it is exactly 0 or 1, a text column only
    when the folded text is in one of the word lists; booleans never count.
    """
    if isinstance(data_type, T.BooleanType):
        return F.lit(None).cast("int")
    if isinstance(data_type, T.NumericType):
        return F.when(value == 0, F.lit(0)).when(value == 1, F.lit(1))
    words = [(word, 0) for word in negative] + [(word, 1) for word in positive]
    labels = F.create_map(*[F.lit(part) for pair in words for part in pair])
    return F.try_element_at(labels, fold_text(value))


def label_mask(labels: Sequence[tuple[int, Column]]) -> Column:
    """Bit mask of the labels in one row: field ``i`` owns bits ``2i`` and ``2i+1``.

    The lower bit says that label 0 was seen, the higher one that label 1 was
    seen, so that ``bit_or`` over a stay tells, per field, whether it has no
    label, one label or a conflict. That merges map-side in four bytes per stay.
    """
    mask = F.lit(0)
    for rank, label in labels:
        mask = mask.bitwiseOR(F.coalesce((label + 1) * F.lit(4**rank), F.lit(0)))
    return mask


def deciding_state(mask: Column, fields: int) -> Column:
    """State of the first field that has any label: 1 is label 0, 2 is label 1.

    3 is a conflict, null means that no field has a label. Precedence ends at
    the first field with a label, so a conflict there hides the later fields and
    a conflict after it does not matter.
    """
    state = F.lit(None).cast("int")
    for rank in reversed(range(fields)):
        bits = F.shiftright(mask, 2 * rank).bitwiseAND(F.lit(3))
        state = F.when(bits != 0, bits).otherwise(state)
    return state


def decided_label(state: Column) -> Column:
    """Label of a deciding state; conflicts and absent labels give null."""
    return F.when(state == 1, F.lit(0)).when(state == 2, F.lit(1))
