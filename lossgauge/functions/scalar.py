"""Column helpers: markers, text cleaning, value maps, labels and years."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts pandas reads as missing by default (pandas 1.4 documentation).
MISSING_MARKERS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)


def blank_markers(col: Column, markers: Iterable[str] = MISSING_MARKERS) -> Column:
    """NULL where the text equals one of ``markers``."""
    return F.when(~col.isin(list(markers)), col)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_number(col: Column, markers: Iterable[str] = ("..",)) -> Column:
    """Text to double; markers, unreadable text and NaN become NULL instead of an ANSI error."""
    return nan_to_null(blank_markers(F.trim(col), markers).try_cast("double"))


def to_whole_number(col: Column) -> Column:
    return F.trim(col.cast("string")).try_cast("int")


def decimal_comma(col: Column) -> Column:
    """'3,8' to 3.8."""
    return F.regexp_replace(col, ",", ".").try_cast("double")


def clean_text(col: Column) -> Column:
    """Drop trailing blanks, the no-break space included (``trim`` leaves that one)."""
    return F.regexp_replace(col, "[\\s\\u00a0]+$", "")


def map_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace by a small in-code dictionary; a value without a rule stays as it is."""
    if not mapping:
        return col
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(literal, col), col)


def percent_label(share: Column, digits: int = 1) -> Column:
    """0.1225 to '12.2%', halves to the even digit."""
    scale = 10**digits
    return F.concat((F.rint(share * 100 * scale) / scale).cast("string"), F.lit("%"))


def ordinal_label(rank: Column) -> Column:
    """1 to '1st', 2 to '2nd', 11 to '11th'."""
    last, teens = rank % 10, (rank % 100).between(11, 13)
    suffix = (
        F.when(teens, "th")
        .when(last == 1, "st")
        .when(last == 2, "nd")
        .when(last == 3, "rd")
        .otherwise("th")
    )
    return F.concat(rank.cast("string"), suffix)


def year_of(col: Column) -> Column:
    return F.year(col)


def year_end(year: Column) -> Column:
    """The last day of a year, the label of a yearly resample."""
    return F.make_date(year, F.lit(12), F.lit(31))


def leading_year(text: Column) -> Column:
    """'2007 [YR2007]' to 2007: the first four characters as a number."""
    return F.substring(text, 1, 4).try_cast("int")


def first_item(items: Column) -> Column:
    """First element of an array, NULL if the array is empty."""
    return F.try_element_at(items, F.lit(1))
