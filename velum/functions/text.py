"""Text expressions that stay in the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(c: str) -> str:
    """The compatibility decomposition of a character without its combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    starts = [p for p, before in zip(points, [-2, *points], strict=False) if p != before + 1]
    ends = [p for p, after in zip(points, [*points[1:], -2], strict=True) if p != after - 1]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


#: Characters whose plain form differs from them and has an ASCII character: accented and full-width letters, ligatures, fractions.
FOLDS = {c: t for c in map(chr, range(0x80, sys.maxunicode + 1)) if (t := _plain(c)) != c and any(x.isascii() for x in t)}
FOLD_FROM = "".join(c for c, t in FOLDS.items() if len(t) == 1)
FOLD_TO = "".join(FOLDS[c] for c in FOLD_FROM)
#: Those of several characters, few in any text.
SPELT = json.dumps({c: t for c, t in FOLDS.items() if len(t) > 1})
#: Characters below these are told apart first, as nearly all are: testing a long class for each of them is slow.
LATIN = "(?=[^\\x00-\\x{24F}])"
SPELT_LOW = _ranges([ord(c) for c, t in FOLDS.items() if len(t) > 1 and ord(c) < 0x250])
SPELT_HIGH = _ranges([ord(c) for c, t in FOLDS.items() if len(t) > 1 and ord(c) >= 0x250])
#: One class, not an alternation of two.
SPELT_CLASS = f"[{SPELT_LOW}[[^\\x00-\\x{{24F}}]&&{SPELT_HIGH}]]"
MARKS = f"(?:{LATIN}" + _ranges([p for p in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(p))]) + ")"


def fold(c: Column) -> Column:
    """Characters as they decompose where that gives ASCII (all letters of ligatures too); combining marks dropped. ASCII texts are returned as they are."""
    table = F.from_json(F.lit(SPELT), "map<string,string>")
    first = lambda x: F.substring(x, 1, 1)
    pieces = F.transform(F.split(c, f"(?={SPELT_CLASS})"), lambda x: F.concat(F.coalesce(F.try_element_at(table, first(x)), first(x)), F.substring(x, 2, 1 << 30)))
    spelt = F.array_join(pieces, "")
    single = F.translate(F.when(c.rlike(SPELT_CLASS), spelt).otherwise(c), FOLD_FROM, FOLD_TO)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(single, MARKS + "+", ""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with costly columns that are computed once a row.

    They come out of a generator of one row: the optimizer copies an ordinary column's expression into every condition, lambda and
    column that uses it.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def normalise(c: Column) -> Column:
    """Lower-case ASCII letters and digits, anything else one space, trimmed."""
    return F.trim(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def tag(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", " "))


def slug(c: Column) -> Column:
    """Normalised with underscores, empty for what stands for a missing value."""
    out = normalise(c)
    return F.when(out.isin("", "na", "nan", "none", "null"), F.lit("")).otherwise(F.regexp_replace(out, " ", "_"))


def has_phrase(text: Column, phrase: Column | str) -> Column:
    """Whole-word occurrence of a normalised phrase in a normalised text."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def title_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\((\d{4})\)\s*$", 1).try_cast("int")


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\((\d{4})\)\s*$", ""))


def genres(c: Column) -> Column:
    """Pipe-joined genres as an array; none listed is empty."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "\\|"), lambda x: x != "")
    return F.when(c == "(no genres listed)", F.array().cast("array<string>")).otherwise(parts)


def joined(c: Column) -> Column:
    """An array as pipe-joined text for CSV; pipes inside become slashes."""
    return F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.replace(x, F.lit("|"), F.lit("/"))), "|")
