"""Text normalisers as column expressions.

Only characters that NFKC or case folding may change need Python (there is no SQL form); rows
without any - ASCII, Han, Hangul, plain Cyrillic - reach the pandas UDF as NULL and cost nothing there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K

# Unicode white space plus the four separators Python also counts as white space.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = f"(?U){SPACE}+"
_EDGES = f"(?U)^{SPACE}+|{SPACE}+$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


@F.pandas_udf(StringType())
def _nfkc_of(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_casefold_of(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


# marked so that a filter on a key does not normalise every row a second time, below the exchange
# that deals the rows out
_nfkc, _nfkc_casefold = _nfkc_of.asNondeterministic(), _nfkc_casefold_of.asNondeterministic()


#: Shorter runs of unchanged characters are left to Python: a class of few ranges is tested faster.
_SHORTEST_RUN = 64


@lru_cache
def unsettled(fold: bool, most: int | None = None) -> str:
    """Pattern of a character that NFKC (``fold``: or case folding) may change, from the Unicode tables.

    ``most``: only so many of the longest runs of settled characters are left out.

    A character is settled if it is its own NFKC form and no sequence can change it: it is no mark
    and no second part of a composition. With ``fold`` its folded form must also be the lower-case
    letter the JVM gives, whatever its Unicode version.
    """
    seconds = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in range(0x10000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))

    def settled(c: int) -> bool:
        x = chr(c)
        if 0xD800 <= c < 0xE000 or c in seconds or unicodedata.combining(x) or unicodedata.normalize("NFKC", x) != x:
            return False
        plain = x.casefold() == x.lower() == x
        return not fold or plain or (c < 0x530 and c != 0x3A3 and len(x.lower()) == 1 and x.casefold() == x.lower())

    runs, start = [], None
    for c in range(0x80, 0x10001):
        if c < 0x10000 and settled(c):
            start = c if start is None else start
        elif start is not None:
            runs.append((start, c - 1))
            start = None
    longest = sorted((r for r in runs if r[1] - r[0] + 1 >= _SHORTEST_RUN), key=lambda r: r[0] - r[1])
    return "[^\\x00-\\x7F" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in longest[:most]) + "]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where branches name it again."""
    return F.transform(F.array(value), use)[0]


def _unsettled(text: Column, fold: bool) -> Column:
    """Whether NFKC (``fold``: or case folding) may change the text.

    Plain ASCII is told by one range, Han and Hangul by three; only other texts meet all ranges.
    """
    return text.rlike(unsettled(fold, 0)) & text.rlike(unsettled(fold, 2)) & text.rlike(unsettled(fold))


def nfkc(text: Column) -> Column:
    changed = _unsettled(text, False)
    return F.coalesce(F.when(~changed, text), _nfkc(F.when(changed, text)))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, _EDGES, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, "")


def normalize_title(title: Column) -> Column:
    """Identity key of a report title: NFKC, no white space, case folded."""
    changed = _unsettled(title, True)
    folded = F.coalesce(F.when(~changed, F.lower(title)), _nfkc_casefold(F.when(changed, title)))
    return without_spaces(folded)


def normalize_theme_name(name: Column) -> Column:
    """Identity key of a theme: NFKC, no white space, case kept."""
    return without_spaces(nfkc(F.coalesce(name, F.lit(""))))


def normalize_tag_name(name: Column) -> Column:
    """NFKC, white-space runs become one space, no space at the ends."""
    return strip(F.regexp_replace(nfkc(name), _SPACES, " "))


def _ends(name: Column, *suffixes: Column) -> Column:
    """Whether the name ends in one of the suffixes and has more than that."""
    return reduce(or_, (name.endswith(s) & (F.length(name) > F.length(s)) for s in suffixes))


def _strip_suffixes_once(name: Column) -> Column:
    return F.aggregate(
        F.array(*map(F.lit, K.COMPANY_SUFFIXES)),
        name,
        lambda acc, s: F.when(_ends(acc, s), F.substr(acc, F.lit(1), F.length(acc) - F.length(s))).otherwise(acc),
    )


def normalize_name(name: Column) -> Column:
    """Company key: NFKC, no white space, upper case, no ST mark, no legal-form suffixes.

    The suffix list is applied in order, pass after pass, never down to an empty name.
    Each pass that changes something removes at least two characters, which bounds the fold.
    Suffixes are compared, not searched for: no white space is left that a pattern would mind.
    """
    # every suffix ends in one of these
    endings = [F.lit(s) for s in ("公司", "集团", "控股")]

    def stripped(unmarked: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(unmarked) / 2).cast("int"))),
            unmarked,
            lambda acc, _: F.when(_ends(acc, *endings), _strip_suffixes_once(acc)).otherwise(acc),
        )

    def key(upper: Column) -> Column:
        return _let(
            F.regexp_replace(upper, K.ST_PREFIX, ""),
            lambda unmarked: F.when(unmarked == "", upper)
            .when(_ends(unmarked, *endings), stripped(unmarked))
            .otherwise(unmarked),
        )

    return _let(F.upper(without_spaces(nfkc(F.coalesce(name, F.lit(""))))), key)


def strip_highlight(text: Column) -> Column:
    """Drop the search highlighter's tags, then trim."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), K.HIGHLIGHT_TAG, ""))


def safe_filename(title: Column, chars: int | None = None) -> Column:
    """A title as a file name; ``chars`` cuts it, which may make two titles one name."""
    cleaned = F.regexp_replace(title, K.FILENAME_ILLEGAL, "_")
    if chars is not None:
        cleaned = F.left(cleaned, F.lit(chars))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("report"))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not start another line."""
    lines = F.split(text, LINE_BREAK, -1)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)
    ).otherwise(lines)
