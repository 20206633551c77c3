"""Text columns to token parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartweave.contract import AGE_GROUPS, TOKEN_SEPARATOR, UNKNOWN_TEXTS

# Every character that counts as white space when a text is stripped. Spark's
# plain trim() removes the space character only.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A whole text that means "not known".
_UNKNOWN = r"\A(" + "|".join(re.escape(text) for text in UNKNOWN_TEXTS) + r")\z"

# What counts as a number in an age: digits may be grouped by "_".
_DIGITS = r"\d+(_\d+)*"
_AGE_NUMBER = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})(e[+-]?{_DIGITS})?$"


def strip_text(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode white space included."""
    return F.btrim(text.cast("string"), F.lit(WHITE_SPACE))


def fold_text(text: Column) -> Column:
    """Strip and case-fold for comparison with a word list.

    ``lower`` leaves the long s alone although it folds to "s"; it is the only
    such letter that the word lists could contain.
    """
    return F.replace(F.lower(strip_text(text)), F.lit("\u017f"), F.lit("s"))


def normalize_text(text: Column, preserve_unknown: bool = False) -> Column:
    """Token part of a free text: upper case, other characters become one ``_``.

    A text that means "not known" gives null, or ``UNKNOWN`` when
    ``preserve_unknown`` is set; a text without letters or digits gives null.

    It is one chain in which every step is used once. Branches that repeat the
    text would make Spark evaluate the whole chain once per mention.
    """
    known = F.regexp_replace(
        fold_text(text), _UNKNOWN, "unknown" if preserve_unknown else ""
    )
    joined = F.regexp_replace(F.upper(known), "[^A-Z0-9]+", "_")
    return F.nullif(F.btrim(joined, F.lit("_")), F.lit(""))


def normalize_name(name: str) -> str | None:
    """``normalize_text`` for a column name, which is known before the plan runs."""
    folded = name.strip().casefold()
    if folded in UNKNOWN_TEXTS:
        return None
    return "_".join(re.findall("[A-Z0-9]+", folded.upper())) or None


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Apply ``use`` to a value that is costly and mentioned more than once."""
    return F.get(F.transform(F.array(value), use), 0)


def _years(folded: Column) -> Column:
    """Years in a folded age text; "> 89" and infinity count as 90."""
    return (
        F.when(folded.startswith(">") & folded.contains("89"), F.lit(90.0))
        .when(
            folded.rlike(_AGE_NUMBER),
            F.replace(folded, F.lit("_"), F.lit("")).try_cast("double"),
        )
        .when(folded.rlike(r"^\+?inf(inity)?$"), F.lit(90.0))
    )


def age_bin(age: Column) -> Column:
    """Ten-year bin such as ``60_70``; 90 and above, and "> 89", give ``90_PLUS``."""

    def label(years: Column) -> Column:
        decade = (F.floor(years / 10) * 10).cast("int")
        return F.when(years >= 90, F.lit("90_PLUS")).when(
            years >= 0, F.concat_ws("_", decade.cast("string"), (decade + 10).cast("string"))
        )

    return once(once(fold_text(age), _years), label)


def spaced_text(text: Column) -> Column:
    """The protocol's token part: upper case, runs of white space become one ``_``; unknown texts give null."""
    known = F.regexp_replace(fold_text(text), _UNKNOWN, "")
    return F.nullif(F.regexp_replace(F.upper(known), f"[{WHITE_SPACE}]+", "_"), F.lit(""))


def age_group(age: Column) -> Column:
    """The protocol's age group such as ``60_79``; "> 89" gives ``80_PLUS``, no usable age null."""

    def label(years: Column) -> Column:
        group = F.when(years < 0, F.lit(None).cast("string"))
        for upper, name in AGE_GROUPS:
            group = group.when(years.isNotNull() if upper is None else years < upper, F.lit(name))
        return group

    return once(once(fold_text(age), _years), label)


def gender_part(gender: Column) -> Column:
    """``F``, ``M`` or, for any other usable text, ``UNKNOWN``."""
    return once(
        normalize_text(gender, preserve_unknown=True),
        lambda part: F.when(part.isin("F", "FEMALE"), F.lit("F"))
        .when(part.isin("M", "MALE"), F.lit("M"))
        .when(part.isNotNull(), F.lit("UNKNOWN")),
    )


def build_token(*parts: str | Column) -> Column:
    """``FAMILY::...::VALUE``; a null part gives no token."""
    columns: list[Column] = []
    for part in parts:
        if columns:
            columns.append(F.lit(TOKEN_SEPARATOR))
        columns.append(F.lit(part) if isinstance(part, str) else part)
    return F.concat(*columns)


def token_family(token: Column) -> Column:
    """The part of a token before the first separator."""
    return F.split_part(token, F.lit(TOKEN_SEPARATOR), F.lit(1))
